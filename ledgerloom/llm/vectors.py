"""Blocks of whole-number vectors: rows of a vector table packed as matrices, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Whole components reach up to this size, so that products and squares of a vector's components add up in 64 bits.
LARGEST = 1 << 26
BLOCK_SCHEMA = "part int, seq int, n int, width int, ids binary, known binary, mat binary"


def usable(vector: Column, factor: int) -> Column:
    """The vector is there, and no component is null, non-finite or larger than LARGEST when multiplied."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(LARGEST / factor)))
    return F.coalesce(vector.isNotNull() & good, F.lit(False))


def usable_vectors(df: DataFrame, factor: int) -> DataFrame:
    """(vec_id long, v array<double>) of the rows whose vector is usable."""
    picked = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return picked.filter(usable(F.col("v"), factor))


def _matrix(column: pa.Array, factor: int) -> np.ndarray:
    """floor(factor * component), one row for each vector; shorter vectors end in zeros."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False) * factor).astype(np.int32)
    if len(sizes) and (sizes == sizes[0]).all():
        return values.reshape(len(sizes), sizes[0])
    out = np.zeros((len(sizes), sizes.max(initial=0)), np.int32)
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = values
    return out


def _joined(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = max(m.shape[1] for _, _, m in parts)
    mats = [np.pad(m, ((0, 0), (0, width - m.shape[1]))) for _, _, m in parts]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate(mats)


def packed_blocks(vectors: DataFrame, factor: int, rows: int, vertical: bool) -> DataFrame:
    """Blocks of at most `rows` vectors, in the order of each partition's rows; (part, seq) names a block.
    `mat` holds 32-bit components, component by component if `vertical`, else vector by vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, waiting = TaskContext.get().partitionId(), 0, []

        def block() -> pa.RecordBatch:
            ids, known, mat = _joined(waiting)
            body = np.ascontiguousarray(mat.T if vertical else mat).tobytes()
            row = part, seq, len(ids), mat.shape[1], ids.tobytes(), known.tobytes(), body
            names = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]
            types = [pa.int32()] * 4 + [pa.binary()] * 3
            return pa.RecordBatch.from_pydict({n: pa.array([v], t) for n, v, t in zip(names, row, types)})

        for batch in batches:
            ids = pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False)
            known = pc.is_valid(batch.column(0)).to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                room = rows - sum(len(p[0]) for p in waiting)
                cut = slice(at, at + room)
                waiting.append((ids[cut], known[cut], _matrix(batch.column(1)[cut], factor)))
                at += room
                if sum(len(p[0]) for p in waiting) == rows:
                    yield block()
                    waiting, seq = [], seq + 1
        if waiting:
            yield block()

    return vectors.select("vec_id", "v").mapInArrow(run, BLOCK_SCHEMA)


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch one after the other, so that only one block is a Python value at a time."""
    for i in range(batch.num_rows):
        yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}
