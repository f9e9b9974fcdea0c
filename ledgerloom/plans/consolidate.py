"""Consolidate indicator files into the series, verify what was stored, report issues."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions.period import file_period, file_region
from ledgerloom.operators import backfill, checks, series
from ledgerloom.scale import materialized
from ledgerloom.sources.rules import ReconcileConfig
from ledgerloom.sources.tables import scan_indicator
from ledgerloom.streaming.jobs import exists

ROWS = ["source_file", "region", "period", "code", "name", "row_no", "value"]
SERIES = ["region", "code", "value", "name", "row_no"]


@dataclass
class RunResult:
    issues: DataFrame
    log: DataFrame
    stats: DataFrame
    corrected: DataFrame | None = None


def source_rows(raw: DataFrame, cfg: ReconcileConfig, order: list[str]) -> DataFrame:
    """Indicator rows with the period and region of their file name; `order` columns rank rows, last wins."""
    rules = [(name, kw) for name, kw, _role, _none in cfg.regions]
    scanned = scan_indicator(raw, cfg.value_col, ["source_file", *order])
    return scanned.withColumns({"period": file_period(F.col("source_file")), "region": file_region(F.col("source_file"), rules)})


def stored_series(spark: SparkSession, path: str) -> DataFrame:
    schema = "region string, code string, value double, name string, row_no string, period string"
    if exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def store(merged: DataFrame, path: str) -> None:
    """Rewrites the touched period partitions only. `merged` must be a written table, not a plan that reads them."""
    merged.select(*SERIES, "period").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(path)


def apply_backfill(
    latest: DataFrame, cfg: ReconcileConfig, ledger: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(corrected rows, audit issues, pre-adjustment values, changes by the adjustment)."""
    src = latest.withColumn("file", F.col("source_file"))
    fees = backfill.ledger_values(ledger, cfg.backfill_map)
    eligible = backfill.eligible_files(src, cfg.watched, cfg.backfill_regions, ledger)
    filled = backfill.backfill_values(src, eligible, fees, cfg.increment_code)
    moved = backfill.parent_rollup(src, filled, cfg.parent_groups)
    fixed = materialized(backfill.apply_overrides(src, filled, moved))
    names = src.select("file", "code", "name")
    audit = filled.select(*moved.columns).unionByName(moved).join(names, ["file", "code"], "left")
    last = fixed.filter("corrected").groupBy("period", "code").agg(F.max_by(F.struct("old_value", "value"), "file").alias("at"))
    pre = last.select("period", "code", F.col("at.old_value").alias("pre"))
    change = last.select("period", "code", (F.col("at.value") - F.coalesce("at.old_value", F.lit(0.0))).alias("change"))
    identity = backfill.identity_check(fixed.drop("old_value", "corrected"), eligible, cfg.fee_codes, cfg.increment_code, cfg.tolerance)
    broken = identity.select(
        "period", F.lit(cfg.base_region).alias("source"), F.lit(cfg.increment_code).alias("code"), F.lit(fv.IDENTITY_DETAIL).alias("detail"), "v1", "v2", "d12", "file"
    )
    issues = checks.union_issues(audit.withColumn("v3", F.lit(0.0)).withColumn("d13", F.col("v1")), broken)
    return fixed.drop("file"), issues, pre, change


def run(
    spark: SparkSession, rows: DataFrame, order: list[str], series_path: str, issues_path: str, cfg: ReconcileConfig,
    biz: str = "国库校验", ledger: DataFrame | None = None,
) -> RunResult:
    """One run: upsert, write, read back, check. The write is a barrier: checks see stored data only.

    With `ledger` (period, r, c, v) the run also backfills all-zero files from it.
    """
    skipped = rows.filter((F.col("region") == fv.UNKNOWN_REGION) | (F.col("period") == ""))
    usable = rows.filter((F.col("region") != fv.UNKNOWN_REGION) & (F.col("period") != ""))
    rank = F.struct(*order)
    values = ["name", "row_no", "value", *order]
    latest = materialized(series.last_wins(usable, ["source_file", "region", "period", "code"], values, rank))
    audit, pre, change = None, None, None
    corrected = latest
    if ledger is not None:
        corrected, audit, pre, change = apply_backfill(latest, cfg, ledger)
    expected = series.last_wins(corrected, series.KEY, ["name", "row_no", "value", "source_file"], rank)
    before = stored_series(spark, series_path)
    periods = expected.select("period").distinct()
    touched = before.join(periods, "period", "left_semi")
    merged = materialized(
        series.upsert(touched, expected)
        .join(touched.select(*series.KEY, F.col("name").alias("_on"), F.col("row_no").alias("_or")), list(series.KEY), "left")
        .join(expected.select(*series.KEY, F.col("name").alias("_nn"), F.col("row_no").alias("_nr"), "source_file"), list(series.KEY), "left")
        .withColumns({"name": F.coalesce(F.nullif("_on", F.lit("")), "_nn"), "row_no": F.coalesce(F.nullif("_or", F.lit("")), "_nr")})
    )
    known_regions = before.select("region").distinct()
    known_codes = before.select("region", "code").distinct()
    traced = corrected.withColumn("file", F.col("source_file"))
    watch = materialized(checks.zero_watch(
        traced.join(known_codes, ["region", "code"], "left_semi"), before, cfg.base_region,
        [*[m[0] for m in cfg.backfill_map], *cfg.backfill_parents], change,
    )) if ledger is not None else None
    written = merged.filter("written").join(known_regions.withColumn("_old", F.lit(True)), "region", "left").withColumn("region_is_new", F.col("_old").isNull())
    written = materialized(written.select(*series.KEY, "source_file", "changed", "region_is_new"))
    store(merged, series_path)

    saved = stored_series(spark, series_path)
    label = series_path.rstrip("/").rsplit("/", 1)[-1]
    parts = [
        checks.no_data_check(saved, cfg.no_data_regions, expected.select("region"), cfg.tolerance, biz, label),
        checks.verify_readback(expected, saved, cfg.tolerance, biz, label),
        checks.totals_check(saved, cfg.base_region, cfg.members, cfg.tolerance, cfg.whitelist, periods, pre, biz, label),
    ]
    if ledger is not None:
        parts = [audit, watch, checks.source_no_data_check(traced, cfg.source_no_data_regions, cfg.tolerance), *parts]
    checks.union_issues(*parts).withColumn("biz", F.coalesce("biz", F.lit(biz))).write.mode("overwrite").parquet(issues_path)
    issues = spark.read.parquet(issues_path)
    log = checks.ingest_log(
        written.select("source_file", "region", "period", "changed").unionByName(
            skipped.select("source_file", "region", "period", F.lit(False).alias("changed")).distinct()
        )
    )
    return RunResult(issues, log, series.run_stats(written, issues), corrected)
