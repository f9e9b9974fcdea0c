"""Rule-driven summary: sheets -> wide rows -> de-duplicated append to each rule's target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions.period import data_date
from ledgerloom.operators import append, reshape, rulepass
from ledgerloom.operators.reshape import ExtractRule
from ledgerloom.scale import materialized
from ledgerloom.sources.rules import extract_rules
from ledgerloom.streaming.jobs import exists


def rule_tables(cells: DataFrame, merges: DataFrame, rules: Sequence[ExtractRule], fallback_date: Column) -> list[DataFrame]:
    """Wide table of each rule with the fixed path columns in front and a sequence column `_seq`.

    One pass makes the rows of all rules and writes them by rule; what reaches the driver are the distinct
    header paths, the columns of the tables themselves.
    """
    rows, paths = rulepass.wide_pass(cells, merges, rules)
    rows = materialized(rows)
    columns: dict[int, list[str]] = {}
    for p in paths.orderBy("rule_no", "workbook", "sheet_no", "sheet", "c").select("rule_no", "path").collect():
        columns.setdefault(p.rule_no, []).append(p.path)
    dated = rows.withColumn("_date", data_date(F.regexp_replace("workbook", r"\.[^.]*$", ""), fallback_date))
    named = dated.select(
        "rule_no", F.col("workbook").alias(fv.PATH_COLUMNS[0]), F.col("sheet").alias(fv.PATH_COLUMNS[1]), F.col("_date").alias(fv.PATH_COLUMNS[2]),
        F.col("row_head").alias(fv.PATH_COLUMNS[3]), F.struct("workbook", "sheet_no", "sheet", "r").alias("_seq"), "values",
    )
    return [reshape.wide_table(named.filter(F.col("rule_no") == no).drop("rule_no"), columns.get(no, [])) for no in range(len(rules))]


def rules_of(sheet: DataFrame, seq: str) -> list[ExtractRule]:
    """The rules of a rule sheet in the order of its lines (`seq`), or the default rule where none is enabled.

    A rule sheet is written by hand; each of its lines becomes a job of its own.
    """
    found = extract_rules(sheet, [seq], seq).orderBy(seq).drop(seq).collect()
    rules = [ExtractRule(**r.asDict(), row_header_cols=[r.row_header_col], only_numeric=False) for r in found]
    return rules or [ExtractRule(header_rows=[1, 2], row_header_col=1, row_header_cols=[1, 2], only_numeric=False)]


def append_rule(spark: SparkSession, table: DataFrame, rule: ExtractRule, path: str) -> dict:
    """Appends one rule's rows; returns input, batch and added counts, or why nothing was written."""
    header = [c for c in table.columns if c != "_seq"]
    keys = append.resolve_dedup(rule.dedup, header)
    if exists(spark, path):
        target = spark.read.option("mergeSchema", True).parquet(path)
        if target.isEmpty():
            target = table.drop("_seq").limit(0)
        elif not append.header_fits(target.columns):
            return {"rule": rule.name, "added": 0, "reason": "header_mismatch"}
    else:
        target = table.drop("_seq").limit(0)
    batch = append.force_text(table)
    counts = append.append_stats(batch, target, keys).first()
    added = materialized(append.new_rows(batch, target, keys, F.col("_seq")).drop("_seq"))
    added.write.mode("append").parquet(path)
    return {"rule": rule.name, "input": counts["input"], "batch": counts["batch"], "added": counts["added"], "reason": ""}


def run(
    spark: SparkSession, cells: DataFrame, merges: DataFrame, rules: Sequence[ExtractRule], target_root: str, fallback_date: Column
) -> list[dict]:
    wanted = [rule for rule in rules if rule.write and rule.target]
    if not wanted:
        return []
    tables = rule_tables(cells, merges, wanted, fallback_date)
    return [append_rule(spark, table, rule, f"{target_root.rstrip('/')}/{rule.target}") for rule, table in zip(wanted, tables)]
