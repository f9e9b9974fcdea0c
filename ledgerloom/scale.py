"""Building blocks that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import shared_folder

CHUNK = 1 << 16


def first_row(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """First row per key. `row_number() = 1` lets Spark cut each map partition to one
    row per key before the shuffle (WindowGroupLimit), so a hot key ships few rows."""
    return first_rows(df, keys, 1, *order).drop("_rank")


def first_rows(df: DataFrame, keys: Sequence[str], k: int, *order: Column, rank: str = "_rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def number_within(df: DataFrame, keys: Sequence[str], seq: str, out: str, chunk: int = CHUNK, many: bool = False) -> DataFrame:
    """row_number() per key ordered by a unique whole-number column, without one task per key.

    Rows are ranked inside (key, block of `seq`) and shifted by the count of the
    blocks before; only those counts meet in one window per key. `many`: keys are about as many as
    rows, so the counts of their blocks are not sent through the driver.
    """
    block = F.floor(F.col(seq) / chunk).alias("_block")
    names = [*keys, "_block"]
    sizes = df.select(*keys, block).groupBy(*names).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*names, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    local = F.row_number().over(Window.partitionBy(*names).orderBy(seq))
    ranked = df.withColumn("_block", F.floor(F.col(seq) / chunk)).withColumn("_local", local)
    return (
        join_null_safe(ranked, shuffled(shifts) if many else shifts, names)
        .withColumn(out, (F.col("_local") + F.col("_shift")).cast("long"))
        .drop("_block", "_local", "_shift")
    )


def join_null_safe(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    renamed = right.select(*[F.col(n).alias(f"_r_{n}") if n in names else F.col(n) for n in right.columns])
    on = [F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in names]
    return left.join(renamed, on, how).drop(*[f"_r_{n}" for n in names])


def tiles(lo: Column, hi: Column, size: int) -> Column:
    """Numbers of the tiles a closed interval touches."""
    return F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long"))


def rects_by_tile(
    rects: DataFrame,
    keys: Sequence[str],
    size: tuple[int, int],
    keep: Sequence[str],
    box: tuple[Column, Column, Column, Column],
    order: Sequence[str],
) -> DataFrame:
    """(keys, _tx, _ty, _rects): the distinct rectangles touching each tile, in order.

    `box` = (x0, y0, x1, y1). Points then need one equi join on their own tile, which
    spreads a hot page over its tiles; the join has one row per tile on this side, so
    AQE may split a skewed point side freely.
    """
    x0, y0, x1, y1 = box
    tiled = (
        rects.select(*keys, *keep, F.explode(tiles(x0, x1, size[0])).alias("_tx"), y0.alias("_y0"), y1.alias("_y1"))
        .select(*keys, *keep, "_tx", F.explode(tiles(F.col("_y0"), F.col("_y1"), size[1])).alias("_ty"))
    )
    entry = F.struct(*order, *[c for c in keep if c not in order])
    return tiled.groupBy(*keys, "_tx", "_ty").agg(F.sort_array(F.collect_set(entry)).alias("_rects"))


def with_rects(
    points: DataFrame, tiled: DataFrame, keys: Sequence[str], x: Column, y: Column, size: tuple[int, int]
) -> DataFrame:
    """Left join of points to the rectangles of their tile (column `_rects`)."""
    placed = points.withColumn("_tx", F.floor(x / size[0]).cast("long")).withColumn(
        "_ty", F.floor(y / size[1]).cast("long")
    )
    # The tile's row first: the join sorts by its keys in order, and book and sheet begin alike in many rows.
    return placed.join(tiled, ["_ty", "_tx", *keys], "left").select(*points.columns, "_rects")


def lead_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, chunk: Column, out: str) -> DataFrame:
    """lead(value) per key, without one task per key.

    `chunk` must not decrease along `order`. Rows look ahead inside their chunk; the last
    row of a chunk takes the first value of the next one.
    """
    names = [*keys, "_chunk"]
    cut = df.withColumn("_chunk", chunk).withColumn("_value", value)
    firsts = cut.groupBy(*names).agg(F.min_by("_value", F.struct(*order)).alias("_first"))
    following = F.lead("_first").over(Window.partitionBy(*keys).orderBy("_chunk"))
    nexts = firsts.select(*names, following.alias("_next"))
    local = F.lead("_value").over(Window.partitionBy(*names).orderBy(*order))
    looked = cut.withColumn("_local", local)
    return (
        looked.join(nexts, names)
        .withColumn(out, F.coalesce("_local", "_next"))
        .drop("_chunk", "_value", "_local", "_next")
    )


def shuffled(df: DataFrame) -> DataFrame:
    """Rows made by an explode, to be joined by a shuffle. The planner takes them for as few as they were
    before, and would send them through the driver to every executor."""
    return df.hint("merge")


def materialized(df: DataFrame) -> DataFrame:
    """The frame as a written table in the cluster's shared folder: computed once, read by several
    consumers, with real size statistics, and not recomputed when an executor is lost."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
