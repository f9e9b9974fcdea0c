"""Region x code x period series: merge, upsert and reshape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions.number import num_lenient, num_of_double
from ledgerloom.functions.period import constant_period
from ledgerloom.scale import number_within

KEY = ("region", "code", "period")


def last_wins(rows: DataFrame, keys: Sequence[str], values: Sequence[str], order: Column) -> DataFrame:
    """Latest row per key. max_by combines on the map side, so hot keys stay cheap."""
    latest = F.max_by(F.struct(*values), order)
    return rows.groupBy(*keys).agg(latest.alias("_last")).select(*keys, "_last.*")


def merge_duplicates(rows: DataFrame, order: Column) -> DataFrame:
    """One row per (region, code, period) from sheets in which a code repeats.

    Per month the last non-empty value wins, the first non-empty name and row number
    win, and `own` is the value on the code's first row. The rows are shuffled once; names and
    row numbers of a code are then picked from its months, a few hundred rows at most.
    """
    first_filled = lambda c: F.min(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("_o", c)))
    rows = rows.withColumn("_o", order)
    months = rows.groupBy(*KEY).agg(
        F.max_by("value", F.when(F.col("value").isNotNull(), F.col("_o"))).alias("value"),
        F.min_by(F.struct("_o", "value"), "_o").alias("_first"),
        first_filled("name").alias("_name"), first_filled("row_no").alias("_no"),
    )
    code = Window.partitionBy("region", "code")
    own = F.when(F.col("_first._o") == F.min("_first._o").over(code), F.col("_first.value"))
    return months.select(
        *KEY, F.min("_name").over(code)["name"].alias("name"), F.min("_no").over(code)["row_no"].alias("row_no"), "value", own.alias("own")
    )


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Series after the new cells are written, with a change flag per cell.

    Both sides hold one row per key. A cell changes when it was absent, empty or different.
    """
    o = old.select(*KEY, F.col("value").alias("old_value"), F.lit(True).alias("_had"))
    n = new.select(*KEY, F.col("value").alias("new_value"), F.lit(True).alias("_got"))
    both = o.join(n, list(KEY), "full")
    got = F.col("_got").isNotNull()
    return both.select(
        *KEY,
        F.when(got, F.col("new_value")).otherwise(F.col("old_value")).alias("value"),
        F.col("old_value"),
        (got & ~F.col("old_value").eqNullSafe(F.col("new_value")) | got & F.col("old_value").isNull()).alias("changed"),
        got.alias("written"),
        F.col("_had").isNull().alias("is_new"),
    )


def unpivot(wide: DataFrame, ids: Sequence[str], as_text: bool = True) -> DataFrame:
    """Wide sheet columns -> (ids, period, value); empty cells are skipped, zeros stay."""
    months = [c for c in wide.columns if c not in ids]
    cells = F.array(*[F.struct(constant_period(c).alias("period"), F.col(f"`{c}`").cast("string").alias("cell")) for c in months])
    filled = wide.select(*ids, F.inline(cells)).filter(F.col("cell").isNotNull() & (F.col("cell") != ""))
    value = num_lenient(F.col("cell")) if as_text else num_of_double(F.col("cell"))
    return filled.select(*ids, "period", value.alias("value"))


def pivot(
    series: DataFrame, periods: Sequence[str], rows: Sequence[str] = ("region", "code"), prefix: str = ""
) -> DataFrame:
    """Series -> one row per (region, code), one column per listed period.

    The list is explicit, so no job runs just to find the columns.
    """
    cell = lambda p: F.max(F.when(F.col("period") == p, F.col("value"))).alias(prefix + p)
    return series.groupBy(*rows).agg(*[cell(p) for p in periods])


def allocate_columns(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """Column number of each period: known ones keep theirs, new ones follow in first-seen order.

    `known` (region, period, col); `incoming` (region, period, seq). Data starts at column 4.
    """
    fresh = (
        incoming.groupBy("region", "period").agg(F.min("seq").alias("seq")).join(known, ["region", "period"], "left_anti")
    )
    # Periods per region are months, a short list.
    nth = F.row_number().over(Window.partitionBy("region").orderBy("seq", "period"))
    top = known.groupBy("region").agg(F.max("col").alias("_top"))
    added = (
        fresh.withColumn("_nth", nth)
        .join(top, "region", "left")
        .select("region", "period", (F.coalesce("_top", F.lit(3)) + F.col("_nth")).cast("int").alias("col"))
    )
    return known.select("region", "period", F.col("col").cast("int").alias("col")).unionByName(added)


def append_codes(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """Row number of each code: known ones keep theirs, new ones follow in first-seen order.

    `known` (region, code, row_seq); `incoming` (region, code, seq) with unique `seq`.
    """
    fresh = incoming.groupBy("region", "code").agg(F.min("seq").alias("seq")).join(known, ["region", "code"], "left_anti")
    ranked = number_within(fresh, ["region"], "seq", "_nth")
    top = known.groupBy("region").agg(F.max("row_seq").alias("_top"))
    added = ranked.join(top, "region", "left").select(
        "region", "code", (F.coalesce("_top", F.lit(0)) + F.col("_nth")).cast("long").alias("row_seq")
    )
    return known.select("region", "code", F.col("row_seq").cast("long").alias("row_seq")).unionByName(added)


def member_totals(series: DataFrame, members: Sequence[str]) -> DataFrame:
    """Sum over the configured member regions per (code, period)."""
    return (
        series.filter(F.col("region").isin(list(members)))
        .groupBy("code", "period")
        .agg(F.sum("value").alias("total"))
    )


def run_stats(written: DataFrame, issues: DataFrame) -> DataFrame:
    """Counts of one run in one row: files, regions_new, cells, checks and mismatches."""
    cells = written.agg(
        F.countDistinct("source_file").alias("files"),
        F.countDistinct(F.when(F.col("region_is_new"), F.col("region"))).alias("regions_new"),
        F.count(F.lit(1)).alias("cells"),
        F.countDistinct("region", "period", "code").alias("write_checks"),
    )
    bad = issues.agg(
        F.count_if(F.col("source") == fv.TOTALS_SOURCE).alias("total_bad"),
        F.count_if(F.col("detail") == fv.NO_DATA_DETAIL).alias("no_data_bad"),
        F.count_if((F.col("source") == fv.TOTALS_SOURCE) & F.contains("detail", F.lit(fv.WHITELIST_MARK))).alias("wl_hit"),
        F.count_if(F.startswith("detail", F.lit(fv.READBACK_PREFIX))).alias("write_mismatches"),
        F.count(F.lit(1)).alias("issues"),
    )
    # Two one-row frames.
    return cells.withColumn("_k", F.lit(1)).join(bad.withColumn("_k", F.lit(1)), "_k").drop("_k")
