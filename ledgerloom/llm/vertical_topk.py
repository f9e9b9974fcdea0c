"""Exact top-k by inner product: columnar branch-and-bound over vertical blocks of vectors.

Vectors become whole numbers, floor(64 * component), and are packed into blocks stored component by
component. Scores are added up eight components at a time, the heaviest components first. What the other
components can still add is at most the product of the two remaining norms (Cauchy-Schwarz); a candidate
that cannot reach the query's k-th best score any more is dropped and the survivors are moved together, as
columns while many queries of the block need them, then as pairs. The k-th best score to beat comes from
the block in which the query itself lies. Each query block meets each candidate block once, in an equi join
on the candidates' cell; bounds only drop pairs that cannot rank, so the result is exact.

Cost: any exact search by this bound looks at every (query, candidate) pair at least through its first
components, so work grows with queries x candidates; the shuffle holds the queries once for each cell.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do those with
a component of 2^26 / 64 or more, whose scores might leave 64 bits; a shorter vector counts as ending in
zeros, so an empty one scores 0; equal scores go by smaller vec_id, an unknown vec_id last; a row without
vec_id is a candidate, not a query; of rows with one vec_id each is a query and a candidate of its own
(only the row itself is left out); fewer than k candidates are all returned; empty tables give no row; only
vec_id and embedding are read; vectors of any length work, in blocks of fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialized
from ledgerloom.llm.vectors import packed_blocks, rows_of, usable_vectors

FACTOR = 64
K = 20
EVERY = 20
BLOCK_ROWS = 8192
# Components added up before the bound is looked at again.
STEP = 8
# Queries scored together: bounds the matrix of partial scores.
QUERIES = 128
# Below this share of surviving pairs they are followed one by one.
SPARSE = 1 / 16
# Candidate blocks of one cell: queries are sent once to each cell.
BLOCKS_PER_CELL = 16
SPREAD = 256

QUERY_SCHEMA = "part int, seq int, n int, width int, ids binary, rows binary, least binary, mat binary"
FOUND_SCHEMA = "part int, seq int, row int, query_id long, vec_id long, score long"


def _exact(q: np.ndarray, x: np.ndarray) -> type:
    """Doubles add up whole numbers exactly below 2^53; beyond, 64-bit integers do."""
    top = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    return np.float64 if top < 1 << 53 else np.int64


def survivors(q: np.ndarray, x: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of all pairs that reach the query's `least`, and none that is not scored in full.

    q: queries x components; x: components x candidates; least: float, -inf for all.
    """
    width = min(q.shape[1], len(x))
    kind = _exact(q, x)
    cuts = [slice(i, min(i + STEP, width)) for i in range(0, width, STEP)]
    q, x = q[:, :width].astype(kind), x[:width].astype(kind)
    q_mass = np.array([np.square(q[:, c], dtype=np.float64).sum(1) for c in cuts]).reshape(len(cuts), len(q))
    x_mass = np.array([np.square(x[c], dtype=np.float64).sum(0) for c in cuts]).reshape(len(cuts), x.shape[1])
    order = np.argsort(-(q_mass.sum(1) * x_mass.sum(1)), kind="stable")
    q_rest, x_rest = q_mass.sum(0), x_mass.sum(0)
    columns = np.arange(x.shape[1])
    score = np.zeros((len(q), len(columns)), kind)
    alive = np.ones(score.shape, bool)
    done = 0

    def reaches(s, room, least):
        return s + room * (1 + 1e-9) + np.abs(s) * 1e-12 + 0.5 >= least

    while done < len(order) and alive.sum() > SPARSE * alive.size:
        c = cuts[order[done]]
        score += q[:, c] @ x[c]
        q_rest, x_rest = np.maximum(q_rest - q_mass[order[done]], 0), np.maximum(x_rest - x_mass[order[done]], 0)
        done += 1
        alive &= reaches(score, np.sqrt(q_rest)[:, None] * np.sqrt(x_rest), least[:, None])
        keep = alive.any(0)
        if keep.mean() < 0.8:
            score, alive, x, x_mass, x_rest, columns = score[:, keep], alive[:, keep], x[:, keep], x_mass[:, keep], x_rest[keep], columns[keep]
    qi, xi = np.nonzero(alive)
    s = score[qi, xi]
    for b in order[done:]:
        c = cuts[b]
        s = s + np.einsum("ij,ji->i", q[qi, c], x[c][:, xi])
        q_rest, x_rest = np.maximum(q_rest - q_mass[b], 0), np.maximum(x_rest - x_mass[b], 0)
        keep = reaches(s, np.sqrt(q_rest[qi] * x_rest[xi]), least[qi])
        qi, xi, s = qi[keep], xi[keep], s[keep]
    return qi, columns[xi], s.astype(np.int64)


def _first(qi: np.ndarray, s: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best: higher score, then smaller id, unknown ids last."""
    order = np.lexsort((ids, ~known, -s, qi))
    starts = np.flatnonzero(np.diff(qi[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order)))
    return order[rank < k]


def _vertical(row: dict, name: str = "mat") -> np.ndarray:
    width = row["q_width" if name == "q_mat" else "width"]
    return np.frombuffer(row[name], np.int32).reshape(width, -1)


def _queries(row: dict, every: int, k: int) -> dict | None:
    """The block's own queries, with the k-th best score each reaches inside the block."""
    ids, known, x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool), _vertical(row)
    mine = np.flatnonzero(known & (ids % every == 0)).astype(np.int32)
    if not len(mine):
        return None
    least = np.full(len(mine), -np.inf)
    if len(ids) > k:
        kind = _exact(x[:, mine].T, x)
        for at in range(0, len(mine), QUERIES):
            cut = mine[at : at + QUERIES]
            score = (x[:, cut].T.astype(kind) @ x.astype(kind)).astype(np.float64)
            score[np.arange(len(cut)), cut] = -np.inf
            least[at : at + QUERIES] = -np.partition(-score, k - 1, axis=1)[:, k - 1]
    same = {n: row[n] for n in ("part", "seq", "width")}
    return same | {"n": len(mine), "ids": ids[mine].tobytes(), "rows": mine.tobytes(), "least": least.tobytes(), "mat": x[:, mine].tobytes()}


def queries_of(blocks: DataFrame, every: int, k: int) -> DataFrame:
    names = [x.split()[0] for x in QUERY_SCHEMA.split(", ")]
    types = [pa.int32()] * 4 + [pa.binary()] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                if found := _queries(row, every, k):
                    yield pa.RecordBatch.from_pydict({n: pa.array([found[n]], t) for n, t in zip(names, types)})

    return blocks.mapInArrow(run, QUERY_SCHEMA)


def _ranked(row: dict, k: int) -> pa.RecordBatch:
    """The best candidates of one block for one block of queries."""
    q, x = np.ascontiguousarray(_vertical(row, "q_mat").T), _vertical(row)
    ids, known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool)
    q_ids, q_rows, least = (np.frombuffer(row[n], t) for n, t in (("q_ids", np.int64), ("q_rows", np.int32), ("q_least", np.float64)))
    home = (row["part"], row["seq"]) == (row["q_part"], row["q_seq"])
    out = []
    for at in range(0, len(q), QUERIES):
        qi, xi, s = survivors(q[at : at + QUERIES], x, least[at : at + QUERIES])
        qi = qi + at
        if home:
            other = q_rows[qi] != xi
            qi, xi, s = qi[other], xi[other], s[other]
        best = _first(qi, s, ids[xi], known[xi], k)
        out.append((qi[best], xi[best], s[best]))
    qi, xi, s = (np.concatenate(x) for x in zip(*out))
    n = len(qi)
    columns = [
        pa.array(np.full(n, row["q_part"], np.int32)), pa.array(np.full(n, row["q_seq"], np.int32)), pa.array(q_rows[qi]),
        pa.array(q_ids[qi]), pa.array(ids[xi], mask=~known[xi]), pa.array(s),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FOUND_SCHEMA.split(", ")])


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, factor: int = FACTOR, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows whose vec_id is divisible by `every`, against all rows."""
    blocks = materialized(packed_blocks(usable_vectors(vectors, factor), factor, block_rows, vertical=True))
    queries = materialized(queries_of(blocks, every, k))
    count = blocks.count()
    cells = max(1, min(count, SPREAD), -(-count // BLOCKS_PER_CELL))
    sent = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"),
        *[F.col(c).alias(f"q_{c}") for c in ("part", "seq", "ids", "rows", "least", "mat", "width")],
    ).repartition(cells, "cell")
    placed = blocks.withColumn("cell", F.pmod(F.xxhash64("part", "seq"), F.lit(cells)).cast("int")).repartition(cells, "cell")
    met = placed.join(sent, "cell").drop("cell", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                yield _ranked(row, k)

    best = Window.partitionBy("part", "seq", "row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = met.mapInArrow(run, FOUND_SCHEMA).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
