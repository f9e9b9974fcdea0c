"""Skew-safe building blocks against their plain window form."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.scale import first_row, lead_within, number_within


def skewed(spark):
    """A third of the rows share one key."""
    k = F.col("id")
    return spark.range(6000).select(
        F.when(k % 3 == 0, "hot").when(k % 101 == 0, None).otherwise((k % 40).cast("string")).alias("key"), ((k * 7919) % 6000).alias("seq")
    )


def test_number_within(spark):
    df = skewed(spark)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("seq")).cast("long"))
    got = number_within(df, ["key"], "seq", "n", chunk=128)
    assert sorted(map(str, got.select("key", "seq", "n").collect())) == sorted(map(str, want.select("key", "seq", "n").collect()))


def test_lead_within(spark):
    df = skewed(spark).filter("key is not null")
    want = df.withColumn("nx", F.lead("seq").over(Window.partitionBy("key").orderBy("seq")))
    got = lead_within(df, ["key"], ["seq"], F.col("seq"), F.floor(F.col("seq") / 50), "nx")
    assert sorted(map(str, got.select("key", "seq", "nx").collect())) == sorted(map(str, want.select("key", "seq", "nx").collect()))


def test_first_row_cuts_before_the_shuffle(spark):
    plan = first_row(skewed(spark), ["key"], F.col("seq"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # partial and final


def test_plans_have_no_cross_join(spark):
    from ledgerloom.catalog import QUERIES, runner

    for name in ("totals_check", "file_meta", "assign_cells", "ignore_filter", "tpl_hit", "append_new", "merge_fill", "upsert_series", "unknown_lines", "table_diff"):
        plan = runner(QUERIES[name])(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_totals_scan_prunes_columns(spark):
    from ledgerloom.catalog import QUERIES, runner

    plan = runner(QUERIES["totals_check"])(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "o_orderstatus" not in plan and "c_name" not in plan
