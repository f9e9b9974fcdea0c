"""Whole jobs: consolidation with stored read-back, backfill, rule summary, pages, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators.reshape import ExtractRule
from ledgerloom.plans import consolidate, pages, summary
from ledgerloom.sources.rules import ReconcileConfig, load_config
from ledgerloom.sources.tables import indicator_rows, read_indicator_csv, scan_indicator
from ledgerloom.streaming import jobs
from test_operators import sheet

ORDER = ["file_seq", "src_row"]
HEADER = "指标代码,指标名称,行序号,余额,上期－余额\n"


def write(folder, name, lines):
    (folder / name).write_text(HEADER + "".join(f"{line}\n" for line in lines), encoding="utf-8")


def read(spark, folder):
    return read_indicator_csv(spark, str(folder))


def config():
    return ReconcileConfig(
        base_region="惠州市", whitelist=["11002"],
        regions=[("惠州市", "惠州市", "base", False), ("市本部", "市本部", "member", False), ("龙门县", "龙门", "member", True)],
    )


def test_consolidate_twice(spark, tmp_path):
    first, second, out = tmp_path / "a", tmp_path / "b", tmp_path / "out"
    first.mkdir(), second.mkdir()
    write(first, "2026.08 惠州市.csv", ["11001,A,1,100,0", "11002.0,B,2,50,0", ",x,,1,"])
    write(first, "2026.08 市本部.csv", ['11001,A,1,"1,00",0', "11002,B,2,40,0"])
    write(first, "2026.08 龙门县.csv", ["11001,A,1,0,0", "11003,C,3,7,0"])
    write(first, "无法识别.csv", ["11001,A,1,1,0"])
    cfg, series_path, issues_path = config(), str(out / "series"), str(out / "issues")
    rows = consolidate.source_rows(read(spark, first), cfg, ORDER)
    result = consolidate.run(spark, rows, ORDER, series_path, issues_path, cfg)
    got = {(r.source, r.code, r.detail) for r in result.issues.collect()}
    assert got == {("总分校验", "11002", "总分不平 (白名单指标)"), ("龙门县", "11003", "不应有数")}
    stats = result.stats.first()
    assert (stats["files"], stats["regions_new"], stats["cells"], stats["total_bad"], stats["no_data_bad"], stats["wl_hit"], stats["write_mismatches"]) == (3, 3, 6, 1, 1, 1, 0)
    assert {r.message for r in result.log.filter("source_file = '无法识别.csv'").collect()} == {"[跳过] 文件名无法解析地区/月份"}

    # A later run: one corrected month, one new month; history stays.
    write(second, "2026.08 市本部.csv", ["11001,A,1,100,0", "11002,B,2,50,0"])
    write(second, "2026.09 惠州市.csv", ["11001,A,1,5,0"])
    rows = consolidate.source_rows(read(spark, second), cfg, ORDER)
    result = consolidate.run(spark, rows, ORDER, series_path, issues_path, cfg)
    stored = {(r.region, r.code, r.period): r.value for r in consolidate.stored_series(spark, series_path).collect()}
    assert stored[("市本部", "11002", "2026.08")] == 50.0 and stored[("惠州市", "11002", "2026.08")] == 50.0
    assert stored[("惠州市", "11001", "2026.09")] == 5.0 and len(stored) == 7
    assert {(r.code, r.period) for r in result.issues.collect()} == {("11001", "2026.09")}
    messages = {r.source_file: r.message for r in result.log.collect()}
    assert messages == {"2026.08 市本部.csv": "[数据更新]", "2026.09 惠州市.csv": "[数据更新]"}


def test_backfill_run(spark, tmp_path):
    src, out = tmp_path / "a", tmp_path / "out"
    src.mkdir()
    fees = ["11367", "11368", "11369", "11370", "11631"]
    write(src, "2026.09 惠州市.csv", [f"{c},N{c},1,0,0" for c in fees] + ["11364,P,1,10,0", "11001,Q,1,20,0", "11628,R,1,30,0"])
    ledger = [("2026.09", r, 1, code) for r, code in enumerate(["512.0", "513", "514", "515", "502", "512"], 2)]
    ledger += [("2026.09", r, 7, str(v)) for r, v in enumerate([1, 2, 3, 4, 0, 99], 2)] + [("2026.09", 6, 8, "11")]
    cells = spark.createDataFrame(ledger, "period string, r int, c int, v string")
    cfg = config()
    rows = consolidate.source_rows(read(spark, src), cfg, ORDER)
    result = consolidate.run(spark, rows, ORDER, str(out / "s"), str(out / "i"), cfg, "会计校验", cells)
    values = {r.code: r.value for r in result.corrected.collect()}
    assert values == {"11367": 1.0, "11368": 2.0, "11369": 3.0, "11370": 4.0, "11631": 11.0, "11364": 20.0, "11001": 30.0, "11628": 41.0}
    issues = result.issues.groupBy("source", "detail").count().collect()
    found = {(r.source, r.detail): r["count"] for r in issues}
    assert found[("会计补录", "已补录费用数据")] == 5 and found[("会计父项补录", "父项已同步补录")] == 3
    assert found[("惠州市", "增加值(11631)与四项费用(11367~11370)之和不符")] == 1
    assert found[("总分校验", "总分校验不平 - 费用调整")] == 8
    assert result.issues.filter("biz is null").isEmpty()


def test_indicator_files_by_their_header(spark, tmp_path):
    """Value by header name, else the fourth column; the later row of the later file wins."""
    (tmp_path / "2026.08 惠州市.csv").write_text("\ufeff指标代码,指标名称,行序号,上期, 余额 ,备注\n11001,x,1,5,77,a\n,y,2,6,78,\n11002,\"a,b\",2,6,9\n", encoding="utf-8")
    (tmp_path / "2026.08 惠州市 b+c.csv").write_text("指标代码,指标名称,行序号,数值\n11001,x,1,5\n11001,x,1,6\n", encoding="utf-8")
    (tmp_path / "2026.08 空.csv").write_text("", encoding="utf-8")
    raw = read_indicator_csv(spark, str(tmp_path))
    assert raw.columns == ["code", "name", "row_no", "余额", "prev", "source_file", "file_seq", "src_row"]
    rows = consolidate.source_rows(raw, config(), ORDER)
    got = sorted((r.source_file, r.code, r.name, r.value) for r in rows.collect())
    assert got == [("2026.08 惠州市 b+c.csv", "11001", "x", 5.0), ("2026.08 惠州市 b+c.csv", "11001", "x", 6.0), ("2026.08 惠州市.csv", "11001", "x", 77.0), ("2026.08 惠州市.csv", "11002", "a,b", 9.0)]
    # Both files name the same region and month: '2026.08 惠州市.csv' sorts behind the one with a suffix.
    result = consolidate.run(spark, rows, ORDER, str(tmp_path / "s"), str(tmp_path / "i"), config())
    stored = {r.code: r.value for r in consolidate.stored_series(spark, str(tmp_path / "s")).collect()}
    last = max(r.file_seq for r in raw.select("file_seq").distinct().collect())
    assert stored == {"11001": 6.0 if "b+c" in last else 77.0, "11002": 9.0}


def test_indicator_rows_of_workbooks(spark):
    grid = [("a.xlsx", ["代码", "名称", "行", "上期", "余额"], ["11001.0", "x", "1", "5", "77"]), ("b.xlsx", ["代码", "名称", "行", "数"], ["11002", "y", "2", "8"])]
    cells = [(b, 0, r, c, v) for b, *rows in grid for r, row in enumerate(rows, 1) for c, v in enumerate(row, 1)] + [("a.xlsx", 1, 2, 1, "99")]
    got = indicator_rows(spark.createDataFrame(cells, "workbook string, sheet_no int, r int, c int, v string"))
    assert sorted(tuple(r) for r in scan_indicator(got, keep=["source_file", *ORDER]).collect()) == [
        ("11001", "x", "1", 77.0, "a.xlsx", "a.xlsx", 2), ("11002", "y", "2", 8.0, "b.xlsx", "b.xlsx", 2),
    ]


def test_load_config(spark):
    settings = spark.createDataFrame([("容差", "abc"), ("取数列", " 期末 "), ("补录父项", "11364.0; 11001;"), ("补录地区", "甲;乙"), ("x", "y")], "key string, value string")
    regions = spark.createDataFrame([("甲", "", None, "是"), (" ", "k", "", "1"), ("乙", "b", "base", "否")], "name string, kw string, role string, no_data string")
    mapping = spark.createDataFrame([("11367.0", "512", "x"), ("", "1", "8"), ("11631", "502.0", "8.0")], "code string, fee_code string, fee_col string")
    got = load_config(settings, regions, mapping, spark.createDataFrame([("11600.0",), ("",)], "code string"))
    assert (got.tolerance, got.value_col, got.backfill_parents, got.backfill_regions) == (0.01, "期末", ["11364", "11001"], ["甲", "乙"])
    assert got.regions == [("甲", "甲", "成员", True), ("乙", "b", "base", False)] and got.whitelist == ["11600"]
    assert got.backfill_map == [("11367", "512", 7), ("11631", "502", 8)]


def test_summary_appends_once(spark, tmp_path):
    cells, merges = sheet(spark)
    rule = ExtractRule("全", "月报", "S", [1, 2], 1, [1], 3, 0, 2, 5, "", False, "t1")
    run = lambda: summary.run(spark, cells, merges, [rule], str(tmp_path), F.lit("2020-01-01"))
    assert (run()[0]["added"], run()[0]["added"]) == (2, 0)
    table = spark.read.parquet(str(tmp_path / "t1"))
    got = {r["行头路径"]: (str(r["数据日期"]), r["一月_计划"], r["二月_实际"]) for r in table.collect()}
    assert got == {"冲压一班": ("2026-09-30", "12500", "12960"), "焊接班": ("2026-09-30", "8600", "9130")}


def test_pages_run(spark, tables):
    from ledgerloom.catalog.align import tpl

    kinds = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(k).alias("kind")) for c, k in ((0, "struct"), (1, "struct"), (3, "num"), (4, "num"))])
    cells = tpl(tables).select("doc", "page", "r", "code", F.inline(kinds)).select("doc", "page", "r", "c", F.when(F.col("c") == 0, F.col("code")).otherwise("").alias("text"), "kind")
    result = pages.run(tables.items, tables.cell_boxes, tables.ignore_rects, tpl(tables), cells)
    n_pages = result.pages.count()
    all_pages = tables.items.select("page_id").distinct().count()
    assert n_pages > 0 and result.summary.count() == all_pages
    assert {(r.verdict, r.template == "") for r in result.summary.select("verdict", "template").collect()} <= {("未套模板", True), ("未校验", False)}
    matched = result.report.agg(F.sum("matched")).first()[0]
    assert matched == result.aligned.count()
    assert result.aligned.count() == result.aligned.select("page_id", "line_no").distinct().count() == result.aligned.select("page_id", "r").distinct().count()
    assert result.filled.filter("c = 3 and text <> ''").count() > 0
    assert result.filled.filter("c = 0").join(tpl(tables), ["r"]).filter("text = code").count() > 0


def test_upsert_stream_equals_batch(spark, tables, tmp_path):
    from ledgerloom.operators.series import last_wins

    cells = tables.events.select(
        F.col("event_type").alias("region"), (F.col("user_id") % 7).alias("code"), F.date_format("ts", "yyyy.MM.dd").alias("period"), "value", "event_id"
    )
    # Files in no particular order: the order column decides, not arrival.
    cells.repartition(5, "event_id").write.parquet(str(tmp_path / "src"))
    stream = jobs.file_stream(spark, str(tmp_path / "src"), cells.schema, "*.parquet", 1)
    keys = ["region", "code", "period"]
    jobs.upsert_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), keys, ["event_id"], "period").awaitTermination()
    want = last_wins(cells, keys, ["value", "event_id"], F.struct("event_id"))
    got = spark.read.schema("region string, code bigint, value double, event_id bigint, period string").parquet(str(tmp_path / "out")).select(*want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_append_stream_is_replay_safe(spark, tables, tmp_path):
    events = tables.events.select("event_id", "user_id", "event_type")
    events.repartition(4).write.parquet(str(tmp_path / "src"))
    stream = lambda: jobs.file_stream(spark, str(tmp_path / "src"), events.schema, "*.parquet", 2)
    keys = ["user_id", "event_type"]
    for checkpoint in ("cp", "cp", "again"):  # restart, then a full replay into the same target
        jobs.append_stream(stream(), str(tmp_path / "out"), str(tmp_path / checkpoint), keys, "event_id").awaitTermination()
        got = spark.read.parquet(str(tmp_path / "out"))
        assert got.count() == events.select(*keys).distinct().count() == got.select(*keys).distinct().count()


def test_rules_of_a_sheet(spark):
    names = ["enabled", "name", "wb_keyword", "sheet_keyword", "row_header_col", "header_rows", "row_start", "row_end", "col_start", "col_end", "skip_keywords", "target", "dedup", "write"]
    schema = "seq int, " + ", ".join(f"{n} string" for n in names)
    lines = [(2, "1", "", "", "", "B", "1", "", "", "", "", "", "t2", "", ""), (1, "是", "first", "", "", "", "2,3", "5", "", "D", "F", "x", "t1", "", "no"), (3, "否", "off", *[""] * 12)]
    first, second = summary.rules_of(spark.createDataFrame(lines, schema), "seq")
    assert (first.name, first.header_rows, first.row_start, first.col_start, first.col_end, first.write) == ("first", [2, 3], 5, 4, 6, False)
    assert (second.name, second.row_header_col, second.row_header_cols, second.target, second.write) == ("规则2", 2, [2], "t2", True)
    (default,) = summary.rules_of(spark.createDataFrame(lines[2:], schema), "seq")
    assert (default.header_rows, default.row_start, default.col_start, default.col_end) == ([1, 2], 3, 3, 8)


def test_append_within_a_day_reads_that_day_only(spark, tmp_path):
    from ledgerloom.streaming import jobs

    schema = "id long, day date, k string"
    for n, lines in enumerate(["(1, date'2024-01-01', 'a'), (2, date'2024-01-02', 'b')", "(3, date'2024-01-01', 'a'), (4, date'2024-01-01', 'c')"]):
        spark.sql(f"select cast(id as long) id, day, k from values {lines} as t(id, day, k)").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.file_stream(spark, f"{tmp_path}/in", spark.range(0).selectExpr("id", "cast(null as date) day", "'' k").schema)
        jobs.append_stream(stream, f"{tmp_path}/out", f"{tmp_path}/progress", ["day", "k"], "id", "day").awaitTermination()
    got = spark.read.schema(f"{schema}, batch_id long").parquet(f"{tmp_path}/out")
    assert sorted((r.id, r.batch_id) for r in got.collect()) == [(1, 0), (2, 0), (4, 1)]


def test_append_keeps_rows_without_a_day_once(spark, tmp_path):
    from ledgerloom.streaming import jobs

    schema = spark.range(0).selectExpr("id", "cast(null as date) day", "'' k").schema
    for n, lines in enumerate(["(1, null, 'a'), (2, date'2024-01-02', null)", "(3, null, 'a'), (4, date'2024-01-02', null), (5, null, 'b')"]):
        spark.sql(f"select cast(id as long) id, cast(day as date) day, cast(k as string) k from values {lines} as t(id, day, k)").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.file_stream(spark, f"{tmp_path}/in", schema)
        jobs.append_stream(stream, f"{tmp_path}/out", f"{tmp_path}/progress", ["day", "k"], "id", "day").awaitTermination()
    got = spark.read.schema("id long, day date, k string, batch_id long").parquet(f"{tmp_path}/out").collect()
    assert sorted((r.id, r.batch_id) for r in got) == [(1, 0), (2, 0), (5, 1)]


def test_append_reads_nothing_of_the_target(spark, tmp_path):
    from ledgerloom.streaming import jobs

    schema = spark.range(0).selectExpr("id", "'' k").schema
    for turn, ids in enumerate([range(0, 50), range(25, 75)]):
        spark.createDataFrame([(i + 1000 * turn, f"k{i}") for i in ids], schema).write.mode("append").parquet(f"{tmp_path}/in")
        known = spark.createDataFrame([("k70",)], "k string")
        jobs.append_stream(jobs.file_stream(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out{turn}", f"{tmp_path}/progress", ["k"], "id", known=known).awaitTermination()
    # The second batch went to another, empty target and still left the first one's keys out.
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out1").collect()) == [i + 1000 for i in range(50, 75) if i != 70]


def test_earliest_row_by_event_time(spark, tmp_path):
    from ledgerloom.streaming import jobs

    schema = "id long, k string, ts timestamp"
    runs = [
        [(1, "a", "2024-01-01 10:00:00"), (2, "b", "2024-01-01 10:30:00")],
        [(3, "a", "2024-01-01 09:40:00"), (4, "b", "2024-01-01 10:45:00"), (5, None, "2024-01-01 10:50:00")],
        [(6, "b", "2024-01-01 01:00:00"), (7, "a", "2024-01-02 10:00:00")],  # far behind the watermark; a new session of a
        [(8, "z", "2024-02-01 00:00:00")],
    ]
    for rows in runs:
        lines = spark.createDataFrame(rows, "id long, k string, t string").selectExpr("id", "k", "cast(t as timestamp) ts")
        lines.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.file_stream(spark, f"{tmp_path}/in", lines.schema)
        jobs.keep_earliest_stream(stream, f"{tmp_path}/out", f"{tmp_path}/progress", ["k"], "ts", "1 hour").awaitTermination()
    assert sorted(r.id for r in spark.read.schema(schema).parquet(f"{tmp_path}/out").collect()) == [2, 3, 5, 7]
