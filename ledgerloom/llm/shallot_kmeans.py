"""Exact centroid clustering with bounds that remember the second-nearest centroid.

Vectors become whole numbers, floor(1024 * component). For each vector a round keeps its centroid, the
second-nearest one, an upper bound of the distance to the first and a lower bound of the distance to all
others. Centroid moves loosen the bounds; where they (or half the gap to the next centroid) still separate,
no distance is computed. Otherwise the search starts from the closer of the two remembered centroids and
walks that one's neighbours outwards. A centroid can only matter inside the ball of radius (distance to the
start) + (second-best distance so far) around the start, and the ball shrinks with every better find. Bounds
are doubles with slack and only decide what is looked at; whatever survives is compared by whole squared
distances, ties by smaller number, so every round equals the plain one.

Vectors lie in blocks in a table bucketed by block; the bounds of a round are a second table bucketed alike,
so a round joins them without a shuffle. Sums change only by the vectors that changed their centroid, are
added up in each block, and only the k x 64 totals reach the driver. A lost executor costs one round.

Defined cases: vectors that are null, of another length or with a null or non-finite component are left out,
and so are those with a component of 2^26 / 1024 or more; a row without vec_id is clustered but starts no
centroid; rows with one vec_id are clustered each, and start centroids in the order of hash, then vector;
fewer kept vectors than centroids give that many centroids; equal centroids share nothing, the smaller number
wins; an empty table gives no row; only vec_id and embedding are read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.vectors import packed_blocks, rows_of, usable_vectors
from ledgerloom.session import shared_folder

FACTOR = 1024
WIDTH = 64
CENTROIDS = 8
ROUNDS = 10
BLOCK_ROWS = 4096
ROWS_PER_BUCKET = 8192
MOST_BUCKETS = 10_000

BOUND_SCHEMA = "block long, near binary, second binary, upper binary, lower binary, change array<long>"
BOUNDS = (("near", np.int32), ("second", np.int32), ("upper", np.float64), ("lower", np.float64))


def _squared(x: np.ndarray, centers: np.ndarray, which: np.ndarray) -> np.ndarray:
    return np.square(x.astype(np.int64) - centers[which]).sum(1)


def gaps(centers: np.ndarray) -> np.ndarray:
    """Distances between centroids."""
    return np.sqrt(np.square(centers[:, None] - centers[None]).sum(2).astype(np.float64))


def nearest(
    x: np.ndarray, centers: np.ndarray, start: np.ndarray, other: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nearest, second, squared distances of both) by a shrinking ball around the closer of two centroids."""
    n, k, rows = len(x), len(centers), np.arange(len(x))
    between = gaps(centers)
    d0, d1 = _squared(x, centers, start), _squared(x, centers, other)
    swap = (d1 < d0) | ((d1 == d0) & (other < start))
    a, b = np.where(swap, other, start), np.where(swap, start, other)
    da, db = np.where(swap, d1, d0), np.where(swap, d0, d1)
    if k == 1:
        return a, a, da, da
    home, known = a.copy(), b.copy()
    reach = np.sqrt(da.astype(np.float64))
    outwards = np.argsort(between, axis=1, kind="stable")
    inside = np.ones(n, bool)
    for step in range(k):
        j = outwards[home, step]
        inside &= between[home, j] <= (reach + np.sqrt(db.astype(np.float64))) * (1 + 1e-9) + 1e-6
        if not inside.any():
            break
        look = rows[inside & (j != home) & (j != known)]
        d, c = _squared(x[look], centers, j[look]), j[look]
        first = (d < da[look]) | ((d == da[look]) & (c < a[look]))
        beats = ~first & ((d < db[look]) | ((d == db[look]) & (c < b[look])))
        up, mid = look[first], look[beats]
        b[up], db[up] = a[up], da[up]
        a[up], da[up] = c[first], d[first]
        b[mid], db[mid] = c[beats], d[beats]
    return a, b, da, db


def assigned(x: np.ndarray, centers: np.ndarray, moved: np.ndarray, bounds: dict | None) -> dict:
    """The bounds of the next round. `moved`: how far each centroid went since the bounds were made."""
    n, k = len(x), len(centers)
    if bounds is None:
        zero = np.zeros(n, np.int32)
        look = np.arange(n)
        new = {"near": zero, "second": np.minimum(zero + 1, k - 1).astype(np.int32), "upper": np.zeros(n), "lower": np.zeros(n)}
    else:
        new = {name: bounds[name].copy() for name, _ in BOUNDS}
        fastest = np.array([np.delete(moved, c).max(initial=0.0) for c in range(k)])
        new["upper"] += moved[new["near"]]
        new["lower"] -= fastest[new["near"]]
        between = gaps(centers)
        np.fill_diagonal(between, np.inf)
        apart = np.maximum(new["lower"], between.min(1)[new["near"]] / 2) * (1 - 1e-9) - 1e-6
        look = np.flatnonzero(~(new["upper"] < apart))
        exact = np.sqrt(_squared(x[look], centers, new["near"][look]).astype(np.float64))
        new["upper"][look] = exact
        look = look[~(exact < apart[look])]
    a, b, da, db = nearest(x[look], centers, new["near"][look], new["second"][look])
    new["near"][look], new["second"][look] = a, b
    new["upper"][look] = np.sqrt(da.astype(np.float64))
    new["lower"][look] = np.sqrt(db.astype(np.float64)) if k > 1 else np.inf
    return new


def change_of_sums(x: np.ndarray, before: np.ndarray | None, after: np.ndarray, k: int) -> np.ndarray:
    """k x (components + 1): what the vectors that changed their centroid add to its sums and its count."""
    out = np.zeros((k, x.shape[1] + 1), np.int64)
    moved = np.arange(len(x)) if before is None else np.flatnonzero(before != after)
    rows = np.concatenate([x[moved], np.ones((len(moved), 1), x.dtype)], axis=1).astype(np.int64)
    np.add.at(out, after[moved], rows)
    if before is not None:
        np.subtract.at(out, before[moved], rows)
    return out


def _bucketed(df: DataFrame, buckets: int) -> tuple[str, str]:
    """Writes the frame bucketed by block; the name it has in the catalog, and its folder."""
    path, name = shared_folder(df.sparkSession), f"bounds_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "block").sortBy("block").option("path", path).format("parquet").saveAsTable(name)
    return name, path


def _next_bounds(vectors: DataFrame, bounds: DataFrame | None, centers: np.ndarray, moved: np.ndarray) -> DataFrame:
    k = len(centers)
    names = [x.split()[0] for x in BOUND_SCHEMA.split(", ")]
    types = [pa.int64()] + [pa.binary()] * 4 + [pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                x = np.frombuffer(row["mat"], np.int32).reshape(row["n"], -1)
                old = {n: np.frombuffer(row[n], t) for n, t in BOUNDS} if "near" in row else None
                new = assigned(x, centers, moved, old)
                sums = change_of_sums(x, old and old["near"], new["near"], k)
                values = [row["block"], *[new[n].astype(t).tobytes() for n, t in BOUNDS], sums.ravel()]
                yield pa.RecordBatch.from_pydict({n: pa.array([v], t) for n, v, t in zip(names, values, types)})

    rows = vectors if bounds is None else vectors.join(bounds.drop("change"), "block")
    return rows.mapInArrow(run, BOUND_SCHEMA)


def _sums(bounds: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Totals of the blocks' changes: one whole number for each centroid and component."""
    each = bounds.select(F.posexplode("change").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v"))
    out = np.zeros(shape, object)
    for at, v in each.collect():
        out[at // shape[1], at % shape[1]] = int(v)
    return out


def _first_centers(kept: DataFrame, count: int, factor: int, width: int) -> np.ndarray:
    hashed = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    rows = kept.filter("vec_id is not null").orderBy(hashed, "v").limit(count).select("v").collect()
    return np.floor(np.array([r.v for r in rows], np.float64).reshape(len(rows), width) * factor).astype(np.int64)


def _unpacked(vectors: DataFrame, bounds: DataFrame, centers: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                x, near = np.frombuffer(row["mat"], np.int32).reshape(row["n"], -1), np.frombuffer(row["near"], np.int32)
                ids, known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool)
                columns = [pa.array(ids, mask=~known), pa.array(near), pa.array(_squared(x, centers, near))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    rows = vectors.join(bounds.select("block", "near"), "block")
    return rows.mapInArrow(run, "vec_id long, cluster int, distance long")


def clusters(
    df: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, factor: int = FACTOR, width: int = WIDTH, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    spark: SparkSession = df.sparkSession
    kept = usable_vectors(df, factor).filter(F.size("v") == width)
    centers = _first_centers(kept, count, factor, width)
    if not len(centers):
        empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], empty)
    buckets = min(MOST_BUCKETS, -(-kept.count() // ROWS_PER_BUCKET))
    block = (F.col("part").cast("long") * F.lit(1 << 31) + F.col("seq")).alias("block")
    packed = packed_blocks(kept, factor, block_rows, vertical=False).select(block, "n", "ids", "known", "mat").repartition(buckets, "block")
    tables = []

    def stored(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The bucketed table to join, and its files to read after the name is gone."""
        name, path = _bucketed(rows, buckets)
        tables.append(name)
        return spark.table(name), spark.read.parquet(path)

    try:
        vectors, vector_files = stored(packed)
        sums, moved, bounds = np.zeros((len(centers), width + 1), object), np.zeros(len(centers)), None
        for turn in range(rounds + 1):
            bounds, bound_files = stored(_next_bounds(vectors, bounds, centers, moved))
            if turn == rounds:
                break
            sums = sums + _sums(bounds, sums.shape)
            before = centers
            centers = np.array([[s // row[-1] for s in row[:-1]] if row[-1] else list(old) for row, old in zip(sums, before)], np.int64)
            moved = np.sqrt(np.square(centers - before).sum(1).astype(np.float64))
        result_path = shared_folder(spark)
        _unpacked(vectors, bounds, centers).write.parquet(result_path)
    finally:
        for name in tables:
            spark.sql(f"drop table if exists {name}")
    result = spark.read.parquet(result_path)
    total = {r.cluster: int(r.d) for r in result.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}
    hashes = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centers]
    at = F.col("cluster") + 1
    return result.select(
        "vec_id", "cluster", "distance",
        F.element_at(F.array(*[F.lit(total.get(c, 0)).cast("long") for c in range(len(centers))]), at).alias("cluster_inertia"),
        F.lit(sum(total.values())).cast("long").alias("inertia"),
        F.element_at(F.array(*[F.lit(h) for h in hashes]), at).alias("centroid_sha256"),
    )
