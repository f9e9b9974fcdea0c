"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.scale import materialized

# Text is worked on in pieces of about this many bytes, so that a worker's memory does not follow the batch size.
SLICE_BYTES = 4 << 20
# Words remembered by a worker before its memory is emptied.
REMEMBERED = 1 << 19


def id_text(doc_id: str = "doc_id") -> Column:
    """The document id as text; a null id counts as the empty text."""
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


def fold(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo `modulus`."""
    return F.crc32(id_text(doc_id).cast("binary")) % modulus


def text_hash() -> Column:
    """64 bits of the row's own text, to find the row again by id and text."""
    return F.xxhash64(F.col("text").cast("string"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of `docs` that `gone` does not list, with all their columns. `gone` has text_hash and the
    columns of `docs` that tell rows apart besides it; nulls equal nulls."""
    own = [c for c in gone.columns if c != "text_hash"]
    listed = gone.select(*[F.col(c).alias(f"_gone_{c}") for c in gone.columns]).distinct()
    same = F.xxhash64(docs["text"].cast("string")) == listed["_gone_text_hash"]
    for c in own:
        same = same & docs[c].eqNullSafe(listed[f"_gone_{c}"])
    return docs.join(listed, same, "left_anti")


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut by rows so that `column` has about SLICE_BYTES in each; one row is never cut."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes) // SLICE_BYTES
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1), len(block)] if len(block) else [0]
        for lo, hi in zip(edges, edges[1:]):
            yield batch.slice(lo, hi - lo)


def as_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def map_slices(
    df: DataFrame, one: Callable[[pa.RecordBatch], dict[str, list | np.ndarray | pa.Array]], schema: str, column: str = "text"
) -> DataFrame:
    """mapInArrow over slices; `one` turns a slice into the columns of `schema`, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, column):
            yield pa.RecordBatch.from_pydict(one(batch))

    return df.mapInArrow(run, schema)


class WordHashes(dict):
    """Word -> 64-bit hash, filled as words come."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit mixing hash: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): label = smallest node reachable, for every node of an edge.

    Each round takes the smallest label among the neighbours, then follows the label once more,
    so the number of rounds grows with the logarithm of the longest path. Hot nodes only meet
    min(), which is pre-aggregated. Every round is a written table: lost executors cost one round.
    """
    both = materialized(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v")))
        .filter("u <> v")
        .distinct()
    )
    labels = materialized(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("label")))
    while True:
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels.node == near.u).select(
            "node", F.col("label").alias("before"), F.least("label", "near").alias("label")
        )
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("further"))
        labels = materialized(
            hooked.join(jump, hooked.label == jump.via, "left").select(
                "node", "before", F.least("label", F.coalesce("further", "label")).alias("label")
            )
        )
        if labels.filter("label <> before").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
