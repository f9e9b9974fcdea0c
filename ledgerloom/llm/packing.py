"""Packed id matrices: best-fit-decreasing packing of documents into rows of one length.

Documents are turned into token ids and an end id. Longer ones are cut into rows and a rest, nothing is lost.
Within a block of documents the pieces are placed from the largest down, each into the fullest row that
still holds it, found by a segment tree over free capacities. Blocks are slices of a partition, so packing
needs no shuffle and its memory is bounded. Ids are 16 or 32 bits wide, as the vocabulary asks; an id that
does not fit its vocabulary is an error.

Defined cases: null and empty texts are the end id alone; ties keep the order of the rows; repeated rows
are packed each; a null id is a null in doc_ids; a text of any length is cut into rows; an empty table gives
no row; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import binary_files
from ledgerloom.llm.common import sliced

ROW = 2048
# Texts of a slice -> ids of each.
Encoder = Callable[[list[str | None]], list[np.ndarray]]
SCHEMA = (
    "doc_ids array<long>, offsets array<long>, cu_seqlens array<int>, n_tokens int, ids binary, positions binary"
)


def width_of(most: int) -> type:
    """The narrowest unsigned type that holds numbers up to `most`."""
    if most < 1 << 16:
        return np.uint16
    if most < 1 << 32:
        return np.uint32
    raise ValueError(f"ids up to {most} do not fit 32 bits")


class FreeCapacities:
    """Segment tree over free capacities 0..size: which rows have a given capacity, and the smallest
    capacity of at least n that some row has."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, row: int, capacity: int) -> None:
        self.rows[capacity].append(row)
        self._add(capacity, 1)

    def take(self, n: int) -> tuple[int, int] | None:
        """(row, its capacity), removed from the tree."""
        node = n + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return self.rows[capacity].pop(), capacity


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers; every size is at most `length`."""
    free, rows = FreeCapacities(length), []
    for piece in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = free.take(sizes[piece])
        row, capacity = found or (len(rows), length)
        if found is None:
            rows.append([])
        rows[row].append(piece)
        if capacity > sizes[piece]:
            free.put(row, capacity - sizes[piece])
    return rows


def _pack(doc_ids: list, encoded: list[np.ndarray], length: int, end: int, pad: int, vocabulary: int) -> pa.RecordBatch:
    kind, place = width_of(max(vocabulary - 1, end, pad)), width_of(length - 1)
    pieces = []
    for doc, ids in zip(doc_ids, encoded):
        if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < vocabulary:
            raise ValueError(f"document {doc} has an id outside the vocabulary of {vocabulary}")
        ids = np.append(ids, end).astype(kind)
        pieces += [(doc, at, ids[at : at + length]) for at in range(0, len(ids), length)]
    out: dict[str, list] = {name.split()[0]: [] for name in SCHEMA.split(", ")}
    for row in best_fit([len(p[2]) for p in pieces], length):
        taken = [pieces[i] for i in row]
        ends = np.cumsum([0] + [len(p[2]) for p in taken])
        ids, positions = np.full(length, pad, kind), np.zeros(length, place)
        for (_, _, part), at in zip(taken, ends):
            ids[at : at + len(part)] = part
            positions[at : at + len(part)] = np.arange(len(part))
        values = [p[0] for p in taken], [p[1] for p in taken], ends.tolist(), int(ends[-1]), ids.tobytes(), positions.tobytes()
        for name, value in zip(out, values):
            out[name].append(value)
    types = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_pydict({n: pa.array(v, t) for (n, v), t in zip(out.items(), types)})


def packed(docs: DataFrame, encode: Encoder, vocabulary: int, end: int, pad: int, length: int = ROW) -> DataFrame:
    """One row per matrix row: the documents and their offsets, cumulative segment lengths, ids and positions
    (little-endian, `length` each, of the widths that vocabulary and length ask; positions start again at
    every segment). `end` closes each document, `pad` fills up rows; both may be ids of the vocabulary or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield _pack(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), length, end, pad, vocabulary)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def write_matrix(rows: DataFrame, path: str, vocabulary: int, end: int, pad: int, length: int = ROW) -> None:
    """The ids of all rows as files of plain numbers, row after row, with a listing that tells their shape;
    beside it, in the folder `segments`, which documents the rows hold."""
    kept = rows.select("ids", "cu_seqlens", "doc_ids", "offsets")
    about = {"length": length, "type": np.dtype(width_of(max(vocabulary - 1, end, pad))).name, "end": end, "pad": pad}
    binary_files.write_files(kept.select("ids"), path, ".bin", about)
    kept.drop("ids").write.parquet(f"{path}/segments")


def read_matrix(path: str) -> Iterator[np.ndarray]:
    """The matrices of the files, one after the other."""
    found = binary_files.listing(path)
    about = found["about"]
    for one in found["files"]:
        yield np.frombuffer(binary_files.read_file(path, one["name"]), about["type"]).reshape(one["rows"], about["length"])
