"""Cell-level diff, grid accuracy and read fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.compare import values_equal
from ledgerloom.functions.geometry import column_letter
from ledgerloom.functions.text import compare_key, strip

ADDRESS = ["sheet", "r", "c", "kind"]


def table_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Differences of two cell sets (sheet, r, c, kind, vtype, v, v_num): missing, extra or changed.

    Formulas compare as trimmed text, values by type and value.
    """
    side = lambda df, p: df.select(*ADDRESS, *[F.col(x).alias(p + x) for x in ("vtype", "v", "v_num")])
    both = side(before, "b_").join(side(after, "a_"), ADDRESS, "full")
    same_value = values_equal(*[F.col(x) for x in ("b_vtype", "b_v", "b_v_num", "a_vtype", "a_v", "a_v_num")])
    same = F.when(F.col("kind") == "formula", strip(F.col("b_v")) == strip(F.col("a_v"))).otherwise(same_value)
    problem = F.when(F.col("a_vtype").isNull(), "缺失").when(F.col("b_vtype").isNull(), "多出").when(~F.coalesce(same, F.lit(False)), "不一致")
    return both.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select(
        "sheet", "kind", F.concat(column_letter(F.col("c")), F.col("r").cast("string")).alias("address"), "r", "c",
        "problem", F.col("b_v").alias("before"), F.col("a_v").alias("after"),
    )


def first_problems(problems: DataFrame, k: int = 8) -> DataFrame:
    return problems.orderBy("sheet", F.col("kind") != "formula", "r", "c").limit(k)


def sheet_names_equal(before: DataFrame, after: DataFrame) -> DataFrame:
    """Whether each workbook keeps its sheet names in order (workbook, sheet, sheet_no)."""
    names = lambda df, n: df.groupBy("workbook").agg(
        F.transform(F.sort_array(F.collect_set(F.struct("sheet_no", "sheet"))), lambda x: x["sheet"]).alias(n)
    )
    joined = names(before, "_b").join(names(after, "_a"), "workbook", "full")
    return joined.select("workbook", F.col("_b").eqNullSafe(F.col("_a")).alias("same"))


def grid_accuracy(expected: DataFrame, got: DataFrame, keys: list[str]) -> DataFrame:
    """matched / total over the non-blank expected cells, blind to spaces and mark width."""
    want = compare_key(F.col("text"))
    joined = expected.filter(want != "").join(got.select(*keys, "r", "c", F.col("text").alias("_got")), [*keys, "r", "c"], "left")
    hit = want == compare_key(F.col("_got"))
    return joined.groupBy(*keys).agg(
        F.count_if(hit).alias("matched"), F.count(F.lit(1)).alias("total"), (F.count_if(hit) / F.count(F.lit(1))).alias("accuracy")
    )


def mismatches(expected: DataFrame, got: DataFrame, keys: list[str]) -> DataFrame:
    want = compare_key(F.col("text"))
    joined = expected.filter(want != "").join(got.select(*keys, "r", "c", F.col("text").alias("got")), [*keys, "r", "c"], "left")
    return joined.filter(want != compare_key(F.col("got"))).select(*keys, "r", "c", F.col("text").alias("expected"), F.coalesce("got", F.lit("")).alias("got"))


def fingerprint(cells: DataFrame) -> DataFrame:
    """(sheet, rows, cols, last): size of a read sheet and its last cell."""
    return cells.groupBy("sheet").agg(
        F.max("r").cast("long").alias("rows"), F.max("c").cast("int").alias("cols"), F.max_by("v", F.struct("r", "c")).alias("last")
    )


def fingerprints_agree(a: DataFrame, b: DataFrame) -> DataFrame:
    x = fingerprint(a).withColumnsRenamed({"rows": "rows_a", "cols": "cols_a", "last": "last_a"})
    y = fingerprint(b).withColumnsRenamed({"rows": "rows_b", "cols": "cols_b", "last": "last_b"})
    same = (
        F.col("rows_a").eqNullSafe(F.col("rows_b")) & F.col("cols_a").eqNullSafe(F.col("cols_b")) & F.col("last_a").eqNullSafe(F.col("last_b"))
    )
    return x.join(y, "sheet", "full").select("sheet", F.coalesce("rows_a", "rows_b").alias("rows"), same.alias("agree"))
