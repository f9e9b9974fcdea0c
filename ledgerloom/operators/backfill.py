"""Backfill of all-zero codes from a second ledger, with roll-up to parent codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions.number import code_text, num_lenient
from ledgerloom.functions.text import strip

FILE_KEY = ["file", "region", "period"]


def code_struct(codes: Sequence[tuple]) -> Column:
    """Configuration rows as a literal array, for projections instead of joins."""
    return F.array(*[F.struct(*[F.lit(v).alias(f"f{i}") for i, v in enumerate(row)]) for row in codes])


def ledger_values(ledger: DataFrame, mapping: Sequence[tuple[str, str, int]]) -> DataFrame:
    """(period, code, value): first ledger row whose code matches, at the mapped column.

    `ledger` (period, r, c, v) is the long form of the sheet; the value column may be empty.
    """
    rows = ledger.filter(F.col("c") == 1).select("period", "r", code_text(F.col("v")).alias("fee_code"))
    wanted = rows.withColumn("m", F.explode(F.filter(code_struct(mapping), lambda m: m["f1"] == F.col("fee_code"))))
    first = wanted.groupBy("period", F.col("m.f0").alias("code"), F.col("m.f2").alias("c")).agg(F.min("r").alias("r"))
    cells = ledger.filter(F.col("c").isin([m[2] for m in mapping])).select("period", "r", "c", "v")
    return first.join(cells, ["period", "r", "c"], "left").select("period", "code", num_lenient(F.col("v")).alias("value"))


def ledger_names(ledger: DataFrame) -> DataFrame:
    """(period, fee_code, name): later rows win; the header row is skipped."""
    rows = ledger.filter((F.col("r") >= 2) & F.col("c").isin(1, 2)).groupBy("period", "r").agg(
        F.max(F.when(F.col("c") == 1, code_text(F.col("v")))).alias("fee_code"),
        F.max(F.when(F.col("c") == 2, strip(F.col("v")))).alias("name"),
    )
    return rows.filter(F.col("fee_code") != "").groupBy("period", "fee_code").agg(F.max_by("name", "r").alias("name"))


def needs_backfill(src: DataFrame, watched: Sequence[str], keys: Sequence[str] = tuple(FILE_KEY)) -> DataFrame:
    """Files whose watched codes sum to zero; a file without any of them qualifies too."""
    size = F.sum(F.when(F.col("code").isin(list(watched)), F.abs("value")))
    return src.groupBy(*keys).agg((F.coalesce(size, F.lit(0)) < 0.01).alias("needed"))


def eligible_files(src: DataFrame, watched: Sequence[str], regions: Sequence[str], ledger_periods: DataFrame) -> DataFrame:
    """Files to backfill: listed region, all-zero trigger and a ledger of the same period."""
    listed = src.filter(F.col("region").isin(list(regions)))
    return (
        needs_backfill(listed, watched).filter("needed").drop("needed")
        .join(ledger_periods.select("period").distinct(), "period", "left_semi")
    )


def backfill_values(src: DataFrame, eligible: DataFrame, fees: DataFrame, increment_code: str) -> DataFrame:
    """Audit rows of the replaced values. `src` holds one row per (file, code).

    `fees` has at most one row per mapped code and period.
    """
    hits = src.join(eligible, FILE_KEY, "left_semi").join(fees.withColumnRenamed("value", "fee"), ["period", "code"])
    group = F.when(F.col("code") == increment_code, "B").otherwise("A")
    return hits.select(
        *FILE_KEY, "code", F.col("fee").cast(dict(src.dtypes)["value"]).alias("v1"), F.col("value").alias("v2"),
        group.alias("grp"),
    ).withColumn("d12", (F.col("v1") - F.col("v2")).cast(dict(src.dtypes)["value"])).withColumn("source", F.lit(fv.BACKFILL_SOURCE)).withColumn(
        "detail", F.lit(fv.BACKFILL_DETAIL)
    )


def parent_rollup(src: DataFrame, filled: DataFrame, parents: Sequence[tuple[str, str]]) -> DataFrame:
    """Audit rows of parent codes moved by the group differences of their file."""
    money = dict(src.dtypes)["value"]
    deltas = filled.groupBy("file", "grp").agg(F.sum("d12").alias("delta"))
    group = F.get(F.filter(code_struct(parents), lambda p: p["f0"] == F.col("code")), F.lit(0))["f1"]
    rows = src.filter(F.col("code").isin([p[0] for p in parents])).withColumn("grp", group)
    moved = rows.join(deltas, ["file", "grp"]).filter(F.abs("delta") >= 0.01)
    return moved.select(
        *FILE_KEY, "code", "grp", (F.col("value") + F.col("delta")).cast(money).alias("v1"), F.col("value").alias("v2"),
        F.col("delta").cast(money).alias("d12"), F.lit(fv.PARENT_SOURCE).alias("source"), F.lit(fv.PARENT_DETAIL).alias("detail"),
    )


def apply_overrides(src: DataFrame, *changes: DataFrame) -> DataFrame:
    """Corrected copy: changed values over the source rows; `old_value` keeps the original."""
    new = None
    for c in changes:
        part = c.select("file", "code", F.col("v1").alias("_new"))
        new = part if new is None else new.unionByName(part)
    joined = src.join(new, ["file", "code"], "left")
    return joined.withColumn("old_value", F.col("value")).withColumn("value", F.coalesce("_new", "value")).withColumn(
        "corrected", F.col("_new").isNotNull()
    ).drop("_new")


def identity_check(
    corrected: DataFrame, eligible: DataFrame, fee_codes: Sequence[str], increment_code: str,
    tolerance: float = fv.DEFAULT_TOLERANCE,
) -> DataFrame:
    """Sum of the fee codes against the increment code, per backfilled file; a missing code is 0."""
    total = lambda codes: F.coalesce(F.sum(F.when(F.col("code").isin(list(codes)), F.col("value"))), F.lit(0))
    per_file = corrected.join(eligible, FILE_KEY, "left_semi").groupBy(*FILE_KEY).agg(
        total([increment_code]).alias("v1"), total(fee_codes).alias("v2")
    )
    return per_file.filter(F.abs(F.col("v1") - F.col("v2")) > tolerance).withColumn("d12", F.col("v1") - F.col("v2"))


def preview(
    src: DataFrame, eligible: DataFrame, fees: DataFrame, names: DataFrame, mapping: Sequence[tuple[str, str, int]],
    fee_codes: Sequence[str], increment_code: str, tolerance: float = fv.DEFAULT_TOLERANCE,
) -> DataFrame:
    """Lines shown before anything is written: one per mapped code, then both totals.

    Columns: file, line_no, code, name, from_code, value, ok.
    """
    lines = eligible.select("file", "period", F.posexplode(code_struct(mapping)).alias("line_no", "m")).select(
        "file", "period", "line_no", F.col("m.f0").alias("code"), F.col("m.f1").alias("fee_code")
    )
    own = src.select("file", "code", F.col("name").alias("own_name"))
    named = (
        lines.join(fees, ["period", "code"], "left").join(own, ["file", "code"], "left")
        .join(names.withColumnRenamed("name", "fee_name"), ["period", "fee_code"], "left")
    )
    value = F.round(F.coalesce("value", F.lit(0.0)), 2)
    detail = named.select(
        "file", "line_no", "code", F.coalesce(F.nullif("own_name", F.lit("")), "fee_name", "fee_code").alias("name"),
        F.concat_ws(" ", "fee_code", F.nullif("fee_name", F.lit(""))).alias("from_code"), value.alias("value"),
        F.lit(None).cast("boolean").alias("ok"),
    )
    amount = lambda codes: F.coalesce(F.sum(F.when(F.col("code").isin(list(codes)), F.col("value"))), F.lit(0.0))
    sums = named.groupBy("file").agg(amount(fee_codes).alias("s4"), amount([increment_code]).alias("inc"))
    n = len(mapping)
    ok = F.abs(F.col("s4") - F.col("inc")) <= tolerance
    label = F.concat(F.lit("Σ"), F.lit(f"{fee_codes[0]}~{fee_codes[-1]}"))
    totals = sums.select("file", F.explode(F.array(
        F.struct(F.lit(n).alias("line_no"), label.alias("code"), F.lit("四项费用之和").alias("name"), F.lit("").alias("from_code"), F.round("s4", 2).alias("value"), F.lit(None).cast("boolean").alias("ok")),
        F.struct(F.lit(n + 1).alias("line_no"), F.lit(increment_code).alias("code"), F.lit("其他收入(增加值)").alias("name"), F.lit("").alias("from_code"), F.round("inc", 2).alias("value"), ok.alias("ok")),
    )).alias("x")).select("file", "x.*")
    return detail.unionByName(totals)
