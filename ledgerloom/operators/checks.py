"""Reconciliation checks; each returns issue rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions.compare import approx, finite
from ledgerloom.scale import join_null_safe

ISSUE_COLUMNS = ["period", "source", "code", "name", "detail", "v1", "v2", "v3", "d12", "d13", "biz", "file"]


def _null(dtype: str = "double") -> Column:
    return F.lit(None).cast(dtype)


def exceeds(c: Column, tolerance: float) -> Column:
    """|c| > tolerance; NaN never exceeds."""
    return (F.abs(c) > tolerance) & ~F.isnan(c.cast("double"))


def totals_check(
    saved: DataFrame,
    base: str,
    members: Sequence[str],
    tolerance: float = fv.DEFAULT_TOLERANCE,
    whitelist: Sequence[str] = (),
    periods: DataFrame | None = None,
    pre_adjust: DataFrame | None = None,
    biz: str = "",
    file: str = "",
) -> DataFrame:
    """City level against the sum of the member regions, per base code and base period.

    Members outside the configuration are ignored. One pass: both levels are conditional
    sums of the same groupBy, which combines before the shuffle.
    """
    is_base, is_member = F.col("region") == base, F.col("region").isin([m for m in members if m != base])
    money = dict(saved.dtypes)["value"]
    used = saved.filter(is_base | is_member)
    if periods is not None:
        used = used.join(periods.select("period").distinct(), "period", "left_semi")
    name = F.col("name") if "name" in saved.columns else F.lit(None).cast("string")
    pairs = used.groupBy("code", "period").agg(
        F.coalesce(F.sum(F.when(is_base, F.col("value"))), F.lit(0)).cast(money).alias("city"),
        F.coalesce(F.sum(F.when(is_member, F.col("value"))), F.lit(0)).cast(money).alias("total"),
        F.coalesce(F.bool_or(is_base), F.lit(False)).alias("_in_base"),
        F.max(F.when(is_base, name)).alias("name"),
    )
    # A base code without a cell in a base period counts as 0 there.
    per_code = Window.partitionBy("code")
    coded = pairs.withColumn("_code", F.max("_in_base").over(per_code)).withColumn("_n", F.max("name").over(per_code))
    base_periods = saved.filter(is_base).select("period").distinct()
    checked = coded.filter("_code").join(base_periods, "period", "left_semi")
    gap = F.col("city") - F.col("total")
    bad = checked.filter((F.abs(gap) > tolerance) | F.isnan(gap.cast("double")))
    listed = F.col("code").isin(list(whitelist)) if whitelist else F.lit(False)
    detail = F.when(listed, F.lit(fv.TOTALS_BAD_WHITELISTED)).otherwise(F.lit(fv.TOTALS_BAD))
    if pre_adjust is None:
        pre, d12 = _null(money), _null(money)
    else:
        bad = bad.join(pre_adjust.select("period", "code", "pre"), ["period", "code"], "left")
        pre = F.coalesce("pre", "city").cast(money)
        d12 = (F.col("city") - pre).cast(money)
        detail = F.concat(detail, F.when(F.abs(d12) > tolerance, fv.TOTALS_ADJUSTED_SUFFIX).otherwise(""))
    return bad.select(
        "period", F.lit(fv.TOTALS_SOURCE).alias("source"), "code", F.col("_n").alias("name"), detail.alias("detail"),
        F.col("city").alias("v1"), pre.alias("v2"), F.col("total").alias("v3"), d12.alias("d12"),
        gap.cast(money).alias("d13"), F.lit(biz).alias("biz"), F.lit(file).alias("file"),
    )


def no_data_check(
    series: DataFrame,
    no_data_regions: Sequence[str],
    touched: DataFrame,
    tolerance: float = fv.DEFAULT_TOLERANCE,
    biz: str = "",
    file: str = "",
) -> DataFrame:
    """Every non-zero cell, history included, of the must-be-zero regions touched by this run."""
    money = dict(series.dtypes)["value"]
    name = F.col("name") if "name" in series.columns else F.lit(None).cast("string")
    return (
        series.filter(F.col("region").isin(list(no_data_regions)) & exceeds(F.col("value"), tolerance))
        .join(touched.select("region").distinct(), "region", "left_semi")
        .select(
            "period", F.col("region").alias("source"), "code", name.alias("name"), F.lit(fv.NO_DATA_DETAIL).alias("detail"),
            F.col("value").alias("v1"), F.lit(0).cast(money).alias("v2"), _null(money).alias("v3"),
            F.col("value").alias("d12"), F.col("value").alias("d13"), F.lit(biz).alias("biz"), F.lit(file).alias("file"),
        )
    )


def verify_readback(
    expected: DataFrame,
    saved: DataFrame,
    tolerance: float = fv.DEFAULT_TOLERANCE,
    biz: str = "",
    file: str = "",
) -> DataFrame:
    """Expected cells (region, period, code, name, value, source_file) against the stored series.

    The reason columns are looked up for the misses only.
    """
    key = ["region", "period", "code"]
    limit = tolerance + 1e-9
    stored = saved.select(*key, F.col("value").cast("double").alias("actual"))
    want = expected.withColumn("value", F.col("value").cast("double"))
    actual = F.col("actual")
    agrees = finite(actual) & ~((F.abs(F.col("value") - actual) > limit) | F.isnan("value"))
    misses = want.join(stored, key, "left").filter(~F.coalesce(agrees, F.lit(False)))
    regions = saved.select("region").distinct().withColumn("_region", F.lit(True))
    periods = saved.select("region", "period").distinct().withColumn("_period", F.lit(True))
    codes = saved.select("region", "code").distinct().withColumn("_code", F.lit(True))
    judged = (
        misses.join(regions, "region", "left").join(periods, ["region", "period"], "left").join(codes, ["region", "code"], "left")
    )
    reason = (
        F.when(F.col("_region").isNull(), fv.READBACK_NO_REGION)
        .when(F.col("_period").isNull(), fv.READBACK_NO_PERIOD)
        .when(F.col("_code").isNull(), fv.READBACK_NO_CODE)
        .when(actual.isNull() & (F.abs(F.col("value")) > limit), fv.READBACK_EMPTY)
        .when(actual.isNull(), F.lit(None))  # an empty cell counts as 0
        .when(~finite(actual), fv.READBACK_NOT_FINITE)
        .otherwise(fv.READBACK_DIFFERS)
    )
    known = F.when(finite(actual), actual)
    return (
        judged.withColumn("_reason", reason)
        .filter(F.col("_reason").isNotNull())
        .select(
            "period", F.col("region").alias("source"), "code", "name",
            F.concat(F.lit(fv.READBACK_PREFIX), "_reason").alias("detail"),
            F.col("value").alias("v1"), _null().alias("v2"), known.alias("v3"), _null().alias("d12"),
            (F.col("value") - known).alias("d13"), F.lit(biz).alias("biz"),
            F.coalesce(F.nullif("source_file", F.lit("")), F.lit(file)).alias("file"),
        )
    )


def source_no_data_check(
    src: DataFrame, regions: Sequence[str] = tuple(fv.DEFAULT_SOURCE_NO_DATA_REGIONS), tolerance: float = fv.DEFAULT_TOLERANCE
) -> DataFrame:
    """Non-zero source rows of listed regions; reported in addition to `no_data_check`."""
    money = dict(src.dtypes)["value"]
    return src.filter(F.col("region").isin(list(regions)) & exceeds(F.col("value"), tolerance)).select(
        "period", F.col("region").alias("source"), "code", F.lit(fv.NO_DATA_DETAIL).alias("detail"),
        F.lit("source").alias("stage"), F.col("value").alias("v1"), F.lit(0).cast(money).alias("v2"),
        F.col("value").alias("d12"), F.col("value").alias("d13"), *_origin(src),
    )


def _origin(src: DataFrame) -> list[str]:
    """Columns that tell where an issue row comes from, as far as the source carries them."""
    return [c for c in ("name", "file") if c in src.columns]


def zero_watch(
    src: DataFrame, series: DataFrame, base: str, watched: Sequence[str], adjusted: DataFrame | None = None
) -> DataFrame:
    """Watched base-region codes still at zero, if the code was already in the series."""
    known = series.filter(F.col("region") == base).select("code").distinct()
    zero = src.filter((F.col("region") == base) & F.col("code").isin(list(watched)) & (F.abs("value") < 0.01))
    hit = zero.join(known, "code", "left_semi")
    money = dict(src.dtypes)["value"]
    if adjusted is None:
        hit = hit.withColumn("change", F.lit(0).cast(money))
    else:
        hit = hit.join(adjusted.select("period", "code", "change"), ["period", "code"], "left")
    before = (F.col("value") - F.coalesce("change", F.lit(0))).cast(money)
    return hit.select(
        "period", F.col("region").alias("source"), "code", F.lit(fv.ZERO_WATCH_DETAIL).alias("detail"),
        F.col("value").alias("v1"), before.alias("v2"), *_origin(src),
    )


def row_balance(rows: DataFrame, terms: Sequence[str]) -> DataFrame:
    """prev_dr - prev_cr + cur_dr - cur_cr against end_dr - end_cr, at half a cent."""
    c = [F.coalesce(F.col(x).cast("double"), F.lit(0.0)) for x in terms]
    left, right = c[0] - c[1] + c[2] - c[3], c[4] - c[5]
    return rows.withColumn("gap", left - right).filter(approx("<>", left, right))


def subtotal_check(rows: DataFrame, section: Sequence[str], is_total: Column, value: str) -> DataFrame:
    """Total row against the sum of its section's detail rows."""
    out = rows.groupBy(*section).agg(
        F.sum(F.when(is_total, F.col(value))).alias("stated"),
        F.coalesce(F.sum(F.when(~is_total, F.col(value))), F.lit(0)).alias("summed"),
    )
    return out.filter(F.col("stated").isNotNull()).withColumn("gap", F.col("stated") - F.col("summed")).filter(
        approx("<>", F.col("stated"), F.col("summed"))
    )


def rule_checks(cells: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """User rules (rule_id, filter_sql, expr_sql): rows where the expression is true.

    All rules are evaluated in one pass over the rows. Rules see whole-number columns as decimals, so
    that sums and products do not wrap. A division by zero or a cast that fails gives null, which counts
    as not bad; `rule_nulls` counts these rows. Rules whose SQL does not resolve are left out;
    `unusable_rules` names them.
    """
    wide = _widened(cells)
    broken = unusable_rules(cells, rules)
    usable = [F.when(_hit(where, expr), F.lit(rule_id)) for rule_id, where, expr in rules if rule_id not in broken]
    hits = F.filter(F.array(*usable).cast("array<string>"), lambda x: x.isNotNull())
    with _nulls_for_errors(cells.sparkSession):
        return wide.select(_ROW, F.explode(hits).alias("rule_id")).select(f"{_ROW}.*", "rule_id")


def rule_nulls(cells: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(rule_id, n_rows): rows that a rule's filter takes but for which its expression gives null (an
    error, an overflow of 38 digits, or a null in the data). One aggregate over all rules."""
    broken = unusable_rules(cells, rules)
    usable = [(i, where, expr) for i, where, expr in rules if i not in broken]
    with _nulls_for_errors(cells.sparkSession):
        counts = [F.count_if(F.expr(where).cast("boolean") & F.expr(expr).cast("boolean").isNull()) for _, where, expr in usable]
        lines = F.array(*[F.struct(F.lit(i).alias("rule_id"), n.alias("n_rows")) for (i, _, _), n in zip(usable, counts)])
        return _widened(cells).agg(lines.alias("_lines")).select(F.inline("_lines")).filter("n_rows > 0")


_ROW = "_row"


def _widened(cells: DataFrame) -> DataFrame:
    """The rows as they are in one struct, and beside it their columns with whole numbers as decimals."""
    whole = [n for n, t in cells.dtypes if t in ("tinyint", "smallint", "int", "bigint")]
    kept = cells.select("*", F.struct(*[F.col(f"`{c}`") for c in cells.columns]).alias(_ROW))
    return kept.withColumns({n: F.col(f"`{n}`").cast("decimal(20,0)") for n in whole})


def unusable_rules(cells: DataFrame, rules: Sequence[tuple[str, str, str]]) -> dict[str, str]:
    """Rule id -> reason, of the rules that do not parse or name what the rows lack."""
    reasons = {}
    for rule_id, where, expr in rules:
        try:
            _widened(cells).select(_hit(where, expr)).schema
        except AnalysisException as error:  # also parse errors
            reasons[rule_id] = error.getCondition() or type(error).__name__
    return reasons


def _hit(where: str, expr: str) -> Column:
    return F.expr(where).cast("boolean") & F.expr(expr).cast("boolean")


@contextmanager
def _nulls_for_errors(spark: SparkSession) -> Iterator[None]:
    """Expressions resolved inside give null instead of an error; what was resolved before keeps its mode."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def with_totals(rows: DataFrame, totals: Sequence[tuple[str, str, str]], keys: Sequence[str]) -> DataFrame:
    """Aggregates (name, filter_sql, agg_sql) per key as columns of every row of the key, for rules that
    compare rows, sheets or books: `("city", "sheet = '合计'", "sum(v_num)")` with the book as key."""
    parts = [F.expr(f"{agg} filter (where {where})").alias(name) for name, where, agg in totals]
    return join_null_safe(rows, rows.groupBy(*keys).agg(*parts), keys)


def issue_view(issues: DataFrame) -> DataFrame:
    return issues.select(
        "period", F.col("source").alias("region"), "code", "name", "detail", "v1", "v2", "v3",
        F.contains("detail", F.lit(fv.WHITELIST_MARK)).alias("wl"),
    )


def ingest_log(cells: DataFrame) -> DataFrame:
    """One line per file: skipped, or whether any of its cells changed."""
    skipped = F.bool_or((F.col("region") == fv.UNKNOWN_REGION) | (F.coalesce("period", F.lit("")) == ""))
    return cells.groupBy("source_file", "region", "period").agg(
        F.when(skipped, fv.LOG_SKIPPED).when(F.bool_or("changed"), fv.LOG_UPDATED).otherwise(fv.LOG_IMPORTED).alias("message")
    )


def union_issues(*parts: DataFrame) -> DataFrame:
    typed = []
    for part in parts:
        have = set(part.columns)
        typed.append(part.select(*[
            (F.col(c) if c in have else F.lit(None)).cast("double" if c[0] in "vd" and c != "detail" else "string").alias(c)
            for c in ISSUE_COLUMNS
        ]))
    out = typed[0]
    for part in typed[1:]:
        out = out.unionByName(part)
    return out


def page_summary(pages: DataFrame, bad_rows: DataFrame, alignment: DataFrame, keep: int = 8) -> DataFrame:
    """Per page: verdict, first bad rows with the overflow count, alignment counts.

    Bad rows are cut to `keep` per page before they are gathered; the count sees all. A page whose
    `checked` column (optional) is false was not checked and is not called balanced.
    """
    counts = bad_rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_bad"))
    first = Window.partitionBy("page_id").orderBy("r")
    label = F.concat(F.lit("第"), F.col("r") + 1, F.lit("行["), F.concat_ws(" ", F.nullif("code", F.lit("")), F.nullif("name", F.lit(""))), F.lit("]"))
    heads = (
        bad_rows.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= keep)
        .groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("_k", label.alias("t")))).alias("_t"))
    )
    n = F.coalesce("n_bad", F.lit(0))
    joined = F.coalesce(F.array_join(F.transform("_t", lambda x: x["t"]), "；"), F.lit(""))
    overflow = F.when(n > keep, F.concat(F.lit("…（共 "), n, F.lit(" 行）"))).otherwise("")
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    aligned = F.concat(
        number("matched"), F.lit(" 行匹配"),
        F.when(number("unmatched") > 0, F.concat(F.lit("，"), "unmatched", F.lit(" 未找到"))).otherwise(""),
        F.when(number("extra") > 0, F.concat(F.lit("，"), "extra", F.lit(" 多余"))).otherwise(""),
    )
    checked = F.col("checked") if "checked" in pages.columns else F.lit(True)
    verdict = (
        F.when(F.coalesce("template", F.lit("")) == "", "未套模板")
        .when(~checked, "未校验")
        .when(n > 0, F.concat(F.lit("✗ "), n, F.lit(" 行不平")))
        .otherwise("✓ 平衡")
    )
    return (
        pages.join(counts, "page_id", "left").join(heads, "page_id", "left").join(alignment, "page_id", "left")
        .select("page_id", "template", verdict.alias("verdict"), F.concat(joined, overflow).alias("detail"), aligned.alias("alignment"))
    )


def overall_summary(pages: DataFrame) -> DataFrame:
    """Totals over (page_id, status, template, n_bad)."""
    templated, bad = F.coalesce("template", F.lit("")) != "", F.col("n_bad") > 0
    return pages.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(templated).alias("templated"),
        F.count_if(bad).alias("bad"), F.count_if((F.col("status") == "完成") & templated & ~bad).alias("ok"),
    )


def top_details(rows: DataFrame, keys: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """First k rows per key with the total count of the key (for the overflow text)."""
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_all"))
    w = Window.partitionBy(*keys).orderBy(*order)
    heads = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return heads.join(totals, list(keys))
