"""Operators on golden rows."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from ledgerloom.operators import append, checks, diff, export, layout, reshape, series
from ledgerloom.sources.html import html_tables
from ledgerloom.sources.listing import file_digests, latest_file, list_files, safe_map
from ledgerloom.sources.workbook import cells_of, failed_files, merges_of, read_workbooks


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_merge_duplicates(spark):
    """Three copies of a code: later values win, also a zero over an amount; a missing value wins over nothing;
    the first name and row number that are not empty stay; `own` is what the first copy said."""
    lines = [
        (5, "K7", "", "", {"Q1": 5.5, "Q2": 8.0}), (6, "Z9", "zeta", "12", {"Q1": 3.0}), (9, "K7", "kappa", "", {"Q2": 0.0, "Q3": 1.25}),
        (11, "K7", "other", "77", {"Q1": None, "Q4": 2.0}), (12, "Z9", "", "", {"Q1": -4.0, "Q3": 0.0}),
    ]
    flat = [("North", code, p, v, name, no, r) for r, code, name, no, cells in lines for p, v in cells.items()]
    flat.append(("South", "K7", "Q1", 1.0, "elsewhere", "1", 2))
    df = spark.createDataFrame(flat, "region string, code string, period string, value double, name string, row_no string, r int")
    got = series.merge_duplicates(df, F.col("r"))
    assert rows(series.pivot(got, ["Q1", "Q2", "Q3", "Q4"])) == [
        ("North", "K7", 5.5, 0.0, 1.25, 2.0), ("North", "Z9", -4.0, None, 0.0, None), ("South", "K7", 1.0, None, None, None),
    ]
    found = {(r.region, r.code, r.period): r for r in got.collect()}
    assert {k[1:]: r.own for k, r in found.items() if k[0] == "North"} == {
        ("K7", "Q1"): 5.5, ("K7", "Q2"): 8.0, ("K7", "Q3"): None, ("K7", "Q4"): None, ("Z9", "Q1"): 3.0, ("Z9", "Q3"): None,
    }
    assert {(r.name, r.row_no) for k, r in found.items() if k[:2] == ("North", "K7")} == {("kappa", "77")}


def test_totals_check_edges(spark):
    data = [
        ("CITY", "a", "2026.01", 10.0), ("X", "a", "2026.01", 4.0), ("Y", "a", "2026.01", 6.0),  # balanced
        ("CITY", "b", "2026.01", 5.0),  # no member: counts as 0
        ("X", "c", "2026.01", 3.0),  # code not in the base: never checked
        ("X", "a", "2026.02", 3.0),  # period not in the base: never checked
        ("Z", "a", "2026.01", 99.0),  # not configured
        ("CITY", "d", "2026.01", 1.0), ("X", "d", "2026.01", 1.0), ("CITY", "e", "2026.01", float("nan")),
    ]
    df = spark.createDataFrame(data, "region string, code string, period string, value double")
    got = checks.totals_check(df, "CITY", ["X", "Y"], 0.01, ["b"])
    assert {(r.code, r.detail) for r in got.collect()} == {("b", "总分不平 (白名单指标)"), ("e", "总分校验不平")}


def test_base_code_without_cell_counts_as_zero(spark):
    data = [("CITY", "a", "2026.01", 1.0), ("CITY", "b", "2026.02", 1.0), ("X", "a", "2026.01", 1.0), ("X", "b", "2026.02", 1.0), ("X", "a", "2026.02", 7.0)]
    df = spark.createDataFrame(data, "region string, code string, period string, value double")
    got = checks.totals_check(df, "CITY", ["X"]).collect()
    assert [(r.code, r.period, r.v1, r.v3) for r in got] == [("a", "2026.02", 0.0, 7.0)]


def test_no_data_ignores_nan(spark):
    df = spark.createDataFrame([("E", "a", "p", float("nan")), ("E", "b", "p", 0.01), ("E", "c", "p", 0.02)], "region string, code string, period string, value double")
    assert [r.code for r in checks.no_data_check(df, ["E"], df).collect()] == ["c"]


HEADER_ROWS = [["车间", "一月", "", "二月", ""], ["", "计划", "实际", "计划", "实际"], ["冲压一班", "12500", "12380", "13000", "12960"], ["焊接班", "8600", "8420", "9000", "9130"]]
HEADER_MERGES = [(1, 1, 2, 1), (1, 2, 1, 3), (1, 4, 1, 5)]


def sheet(spark):
    cells = [("月报_20260930.xlsx", "S", r, c, v) for r, row in enumerate(HEADER_ROWS, 1) for c, v in enumerate(row, 1)]
    merges = [("月报_20260930.xlsx", "S", *m) for m in HEADER_MERGES]
    return (
        spark.createDataFrame(cells, "workbook string, sheet string, r bigint, c int, v string"),
        spark.createDataFrame(merges, "workbook string, sheet string, r0 bigint, c0 int, r1 bigint, c1 int"),
    )


def test_merged_headers(spark):
    cells, merges = sheet(spark)
    paths = {r.c: r.path for r in reshape.column_paths(cells, merges, [1, 2]).collect()}
    assert paths == {1: "车间_车间", 2: "一月_计划", 3: "一月_实际", 4: "二月_计划", 5: "二月_实际"}
    grid = reshape.header_forward_fill(cells, merges, [1, 2])
    labels = {r.c: r.label for r in reshape.header_labels(grid, [1, 2]).collect()}
    assert labels == {1: "车间", 2: "一月_计划", 3: "一月_实际", 4: "二月_计划", 5: "二月_实际"}
    doubled = {r.c: r.path for r in reshape.column_paths(cells, merges, [2]).collect()}
    assert doubled == {1: "车间", 2: "计划_1", 3: "实际_1", 4: "计划_2", 5: "实际_2"}


def test_append_idempotent(spark):
    schema = "`工作簿名` string, `工作表名` string, `数据日期` date, `行头路径` string, `本期余额_借方` double, `科目代码_科目代码` string, seq int"
    import datetime

    target = spark.createDataFrame([("旧工作簿", "旧表", datetime.date(2026, 9, 1), "甲.乙", 5.0, "11001", 0)], schema).drop("seq")
    batch = spark.createDataFrame([("新工作簿", "新表", datetime.date(2026, 10, 1), "甲.乙", 9.0, "11001", 1)], schema)
    keys = append.resolve_dedup("", batch.columns)
    assert keys == ["数据日期", "行头路径"]
    once = append.append(batch.drop("seq"), target, keys, F.col("工作簿名"))
    assert once.count() == 2
    assert append.new_rows(batch, once, keys, F.col("seq")).count() == 0
    empty = target.limit(0)
    three = batch.unionByName(batch.withColumn("行头路径", F.lit("b"))).unionByName(batch.withColumn("行头路径", F.lit("c")))
    assert append.new_rows(three, empty, keys, F.col("seq")).count() == 3
    assert append.resolve_dedup("B;3;行头路径;zz", batch.columns) == ["工作表名", "数据日期", "行头路径"]
    assert not append.header_fits(["工作簿名"])


def test_force_text(spark):
    df = spark.createDataFrame([(11344.0, "11347.0", 1.0), (None, "1123P", 2.0)], "`行头路径` double, `科目代码_科目代码` string, x double")
    assert rows(append.force_text(df)) == [("11344", "11347", 1.0), (None, "1123P", 2.0)]


def test_table_diff(spark):
    schema = "sheet string, r int, c int, kind string, vtype string, v string, v_num double"
    a = spark.createDataFrame([("S", 1, 1, "value", "number", "1", 1.0), ("S", 1, 2, "value", "string", "x", None), ("S", 2, 1, "formula", "string", "=A1", None), ("S", 3, 3, "value", "bool", "true", None)], schema)
    b = spark.createDataFrame([("S", 1, 1, "value", "number", "1", 1.0 + 2e-16), ("S", 1, 2, "value", "string", "y", None), ("S", 2, 1, "formula", "string", " =A1 ", None), ("S", 4, 4, "value", "string", "z", None)], schema)
    got = {(r.address, r.problem) for r in diff.table_diff(a, b).collect()}
    assert got == {("B1", "不一致"), ("C3", "缺失"), ("D4", "多出")}


def test_redaction(spark):
    cells = spark.createDataFrame([("S", 1, 1, "科目代码"), ("S", 2, 1, "101"), ("S", 2, 6, "99.5")], "sheet string, r int, c int, v string")
    hidden = export.redact(cells, cells.filter("c = 6"), ["sheet", "r", "c"])
    assert rows(hidden) == [("S", 1, 1, "科目代码"), ("S", 2, 1, "101"), ("S", 2, 6, None)]


def test_region_cells_named(spark):
    cells = spark.createDataFrame([("S", r, c) for r in range(11) for c in range(6)], "sheet string, r int, c int")
    rects = spark.createDataFrame([("S", "数字区域", 1, 5, 10, 5), ("S", "结构区域", 0, 0, 10, 4)], "sheet string, name string, r0 int, c0 int, r1 int, c1 int")
    got = reshape.region_cells(cells, rects)
    assert got.filter("kind = 'numeric'").count() == 10
    assert [r.c for r in got.filter("kind = 'numeric'").select("c").distinct().collect()] == [5]
    assert got.filter("kind = 'struct'").count() == 55


def test_safe_map_isolates(spark):
    df = spark.createDataFrame([(0, "x"), (1, "1")], "idx int, v string")
    got = {r.idx: (r.status, r.payload) for r in safe_map(df, "idx", "v", int).collect()}
    assert got == {0: ("failed", None), 1: ("ok", "1")}


def test_html_spans(spark):
    html = "<p>x</p><table><tr><th rowspan=2>a</th><td colspan='2'>b</td></tr><tr><td>c<td>d&nbsp;</tr></table><table><tr><td>z</td></tr></table>"
    got = html_tables(spark.createDataFrame([(1, html), (2, "<p>none</p>")], "page_id bigint, html string"))
    assert [tuple(r)[1:] for r in got.orderBy("table_no", "r", "c").collect()] == [
        (0, 0, 0, 2, 1, "a"), (0, 0, 1, 1, 2, "b"), (0, 1, 1, 1, 1, "c"), (0, 1, 2, 1, 1, "d"), (1, 0, 0, 1, 1, "z"),
    ]


def xlsx(sheet_xml: str, shared: list[str]) -> bytes:
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="表1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{sheet_xml}</sheetData><mergeCells><mergeCell ref='A1:B2'/></mergeCells></worksheet>")
    return out.getvalue()


def test_read_workbooks(spark, tmp_path):
    body = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>1.5</v></c><c r="D1" s="1"><v>46295</v></c></row><row r="3"><c r="AA3" t="b"><v>1</v></c><c r="AB3"><f>A1+1</f><v>2</v></c></row>'
    (tmp_path / "月报 1.xlsx").write_bytes(xlsx(body, ["指标代码"]))
    (tmp_path / "bad.xlsx").write_bytes(b"not a zip")
    book = read_workbooks(spark, str(tmp_path))
    got = {(r.r, r.c): (r.vtype, r.v, r.v_num, r.formula) for r in cells_of(book).collect()}
    assert got[(1, 1)] == ("string", "指标代码", None, None) and got[(1, 3)] == ("number", "1.5", 1.5, None)
    assert got[(3, 27)] == ("bool", "true", None, None) and got[(3, 28)] == ("number", "2", 2.0, "A1+1")
    assert got[(1, 4)][0] == "date"
    assert cells_of(book).filter("r = 1 and c = 4").first().v_ts.isoformat() == "2026-09-30T00:00:00"
    assert [tuple(r)[2:] for r in merges_of(book).collect()] == [(1, 1, 2, 2)]
    assert [r.workbook for r in failed_files(book).collect()] == ["bad.xlsx"]
    files = list_files(spark, str(tmp_path))
    assert files.count() == 2 and file_digests(spark, str(tmp_path), "bad.xlsx").first().sha256 is not None
    assert latest_file(files).first().path is None


def test_json_parts_make_a_document(spark):
    import json

    grid = spark.createDataFrame([(1, 0, 0, 'a"b', 0.12345), (1, 0, 1, "", None), (1, 1, 0, "c", 1.0), (1, 1, 1, "中", None)], "page_id bigint, r int, c int, text string, score double")
    pages = spark.createDataFrame([(1, "p.jpg", "标题", "table")], "page_id bigint, name string, title string, mode string")
    merges = spark.createDataFrame([(1, 0, 0, 1, 2)], "page_id bigint, r int, c int, rspan int, cspan int")
    parts = export.json_parts(grid, pages, merges).orderBy("page_id", "section", "r", "c").collect()
    doc = json.loads("".join(p.part for p in parts))
    assert doc == {"name": "p.jpg", "title": "标题", "mode": "table", "rows": [['a"b', ""], ["c", "中"]], "merges": [[0, 0, 1, 2]], "scores": {"0,0": 0.123, "1,0": 1.0}}


def test_line_veto_counts_overlapping_boxes_once(spark):
    boxes = [(1, i, 0, 100 * i, 200, 100 * i + 20, "中文", 1.0) for i in range(4)] + [(1, 9, 0, 2, 200, 22, "中文", 1.0)]
    items = spark.createDataFrame(boxes, "page_id bigint, item_no bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint, text string, score double")
    lines = spark.createDataFrame([(1, 100), (1, 300)], "page_id bigint, x int")
    got = {r.x: (r.crossings, r.stays) for r in layout.line_veto(lines, items).collect()}
    assert got == {100: (4, False), 300: (0, True)}


def test_sinks(spark, tmp_path):
    import json

    import pytest

    from ledgerloom import sinks

    grid = spark.createDataFrame(
        [(p, r, c, f"{p},{r}|{c}", 0.5) for p in (1, 2) for r in range(30) for c in range(2)], "page_id bigint, r int, c int, text string, score double"
    )
    pages = spark.createDataFrame([(1, "p1", "", "table"), (2, "p2", "T", "table")], "page_id bigint, name string, title string, mode string")
    text = lambda name: "".join(f.read_text(encoding="utf-8") for f in sorted((tmp_path / name).glob("part-*")))
    sinks.write_csv(grid, 2, str(tmp_path / "csv"))
    assert text("csv").startswith('\ufeff"2,0|0","2,0|1"\n"2,1|0"') and text("csv").count("\ufeff") == 1
    sinks.write_text(grid, pages, str(tmp_path / "txt"))
    lines = text("txt").split("\n")
    assert lines[:2] == ["===== p1 =====", "1,0|0  1,0|1"] and lines[31:33] == ["", "===== T ====="]
    sinks.write_markdown(grid, pages, str(tmp_path / "md"))
    assert text("md").startswith("## p1\n\n| 1,0\\|0 | 1,0\\|1 |\n|---|---|\n| 1,1\\|0 |")
    merges = spark.createDataFrame([], "page_id bigint, r int, c int, rspan int, cspan int")
    sinks.write_json(grid.filter("page_id = 2"), pages.filter("page_id = 2"), merges, str(tmp_path / "json"))
    assert json.loads(text("json").replace("\n", ""))["rows"][29] == ["2,29|0", "2,29|1"]
    sinks.publish(grid.select(F.col("text").alias("v")), str(tmp_path / "pub"))
    with pytest.raises(ValueError):
        sinks.publish(grid.select(F.lit("C:\\x").alias("v")), str(tmp_path / "pub2"))


def test_extract_rules(spark):
    from ledgerloom.sources.rules import extract_rules

    names = ["enabled", "name", "wb_keyword", "sheet_keyword", "row_header_col", "header_rows", "row_start", "row_end", "col_start", "col_end", "skip_keywords", "target", "dedup", "write"]
    sheet_rows = [
        ("是", "a", "", "", "B", "1, 2,x", "3", "", "C", "H", "", "t", "", ""), ("", "off", "", "", "A", "1", "", "", "", "", "", "", "", ""),
        ("1", "b", "", "", "?", "", "", "9", "4", "", "", "t", "", " No "),
    ]
    df = spark.createDataFrame(sheet_rows, ", ".join(f"{n} string" for n in names))
    got = {r.name: r for r in extract_rules(df).collect()}
    assert set(got) == {"a", "b"}
    a, b = got["a"], got["b"]
    assert (a.row_header_col, a.header_rows, a.row_start, a.row_end, a.col_start, a.col_end, a.write) == (2, [1, 2], 3, 0, 3, 8, True)
    assert (b.row_header_col, b.header_rows, b.row_end, b.col_start, b.col_end, b.write) == (1, [1], 9, 4, 0, False)


def test_html_large_and_odd_spans(spark):
    """Spans are not cut, cost no memory for their area, and rows without a cell do not count."""
    html = (
        "<table><tr></tr><tr><td rowspan=900000000 colspan=900000000>a</td><td>b</td></tr><tr></tr>"
        "<tr><td colspan='x'>c</td><td rowspan='²'>d</td></tr></table>"
    )
    got = html_tables(spark.createDataFrame([(1, html)], "page_id bigint, html string"))
    big = 900000000
    assert [tuple(r)[2:] for r in got.orderBy("r", "c").collect()] == [
        (0, 0, big, big, "a"), (0, big, 1, 1, "b"), (1, big, 1, 1, "c"), (1, big + 1, 1, 1, "d"),
    ]


def test_workbook_faults_leave_no_half_file(spark, tmp_path, monkeypatch):
    from ledgerloom.sources import workbook

    rows = "".join(f'<row r="{r}"><c r="A{r}"><v>{r}</v></c></row>' for r in range(1, 60))
    monkeypatch.setattr(workbook, "_BATCH", 7)
    good = xlsx(rows, [])
    assert sum(len(b) for b in workbook._batches("g", good)) == 60  # 59 cells and the merge
    bad = xlsx(rows + '<row r="60"><c r="A60" t="s"><v>5</v></c></row>', [])
    import pytest

    batches = workbook._batches("b", bad)
    with pytest.raises(IndexError):
        next(batches)


def test_date_formats_and_epoch(spark):
    from datetime import datetime
    from xml.etree import ElementTree as ET

    from ledgerloom.sources.workbook import _cell, _DATE_FORMATS

    assert {28, 29, 31, 35, 51, 56, 58} <= _DATE_FORMATS and not _DATE_FORMATS & {0, 9, 23, 26, 37, 44, 48, 49, 59}
    cell = ET.fromstring('<c r="A1" s="1"><v>1</v></c>')
    assert _cell(cell, [], {1}, datetime(1904, 1, 1))[7] == datetime(1904, 1, 2)


def test_rules_with_errors_and_totals(spark):
    from ledgerloom.operators import checks

    cells = spark.createDataFrame([("b", "合计", 1, 10.0, 0.0, "x"), ("b", "明细", 1, 6.0, 2.0, "7"), ("b", "明细", 2, 3.0, 1.0, None)], "workbook string, sheet string, r int, a double, d double, t string")
    rules = [("div", "true", "a / d > 2"), ("cast", "true", "cast(t as int) = 7"), ("cross", "sheet = '合计'", "a <> parts"), ("gone", "true", "nope = 1"), ("syntax", "true", "a >")]
    rows = checks.with_totals(cells, [("parts", "sheet = '明细'", "sum(a)")], ["workbook"])
    got = sorted((r.rule_id, r.sheet, r.r) for r in checks.rule_checks(rows, rules).collect())
    assert got == [("cast", "明细", 1), ("cross", "合计", 1), ("div", "明细", 1), ("div", "明细", 2)]
    assert set(checks.unusable_rules(rows, rules)) == {"gone", "syntax"}
    assert checks.rule_checks(rows, []).isEmpty() and spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_shared_folder_needs_a_setting_on_a_cluster():
    import pytest

    from ledgerloom.session import shared_folder

    class Conf(dict):
        pass

    class Session:
        conf = Conf({"spark.master": "yarn"})

    with pytest.raises(ValueError):
        shared_folder(Session())
    Session.conf["spark.checkpoint.dir"] = "hdfs://x/y"
    assert shared_folder(Session()).startswith("hdfs://x/y/ledgerloom-")


def test_rules_do_not_wrap(spark):
    from ledgerloom.operators import checks

    rows = spark.createDataFrame([(1, 2_000_000_000, 2_000_000_000, "x"), (2, 1, 1, "4"), (3, 9 * 10**18, 1, None)], "id long, a long, b int, t string")
    rules = [("sum", "true", "a + b > 3000000000L"), ("product", "id < 3", "a * b > 3000000000L"), ("large", "true", "a + a + a > 20e18"), ("cast", "true", "cast(t as int) > 3"), ("gone", "true", "q > 1")]
    found = {(r.rule_id, r.id) for r in checks.rule_checks(rows, rules).collect()}
    assert found == {("sum", 1), ("sum", 3), ("product", 1), ("large", 3), ("cast", 2)}
    assert checks.rule_checks(rows, rules).columns == [*rows.columns, "rule_id"] and dict(checks.rule_checks(rows, rules).dtypes)["a"] == "bigint"
    assert {(r.rule_id, r.n_rows) for r in checks.rule_nulls(rows, rules).collect()} == {("cast", 2)}
    assert list(checks.unusable_rules(rows, rules)) == ["gone"]


def test_rules_over_ranges(spark):
    from ledgerloom.operators.ranges import RangeRule, range_checks, unusable_range_rules

    grid = [("b", "Sum", 3, 7, 10.0), ("b", "Sum", 4, 7, 9.0), ("b", "Sum", 5, 7, None)]
    grid += [("b", "Data", r, c, float(r)) for r in (3, 4, 5) for c in (1, 2, 3)] + [(None, "Sum", 3, 7, 1.0)]
    cells = spark.createDataFrame([(w, s, r, c, None if v is None else str(v), v) for w, s, r, c, v in grid], "workbook string, sheet string, r long, c int, v string, v_num double")
    rules = [
        RangeRule("row", "Sum!$G$3:$G$5", "coalesce(value, 0) <> total", {"total": ("sum", "Data!A3:C3")}),
        RangeRule("all", "Sum!G3:G5", "value < big * 2", {"big": ("max", "Data!$A$3:$C$5"), "n": ("count", "Data!A1:C2")}),
        RangeRule("empty", "Sum!G5", "n = 0 and low is null", {"n": ("count", "G3"), "low": ("min", "Data!Z1:Z9")}),
        RangeRule("wrong", "Sum!G5", "nothing > 1"),
    ]
    found = {(r.rule_id, r.workbook, r.r) for r in range_checks(cells, rules).collect()}
    # Row 3 has 9 and 4 has 12, 5 has 15; the cell of the book without a name has no data of its own.
    assert found == {("row", "b", 3), ("row", "b", 4), ("row", "b", 5), ("row", None, 3), ("all", "b", 4)}
    assert list(unusable_range_rules(cells, rules)) == ["wrong"]


def test_rules_share_one_pass(spark):
    """Rows, heads and paths of several rules on one sheet; no rule adds a shuffle."""
    import re

    from ledgerloom.operators.reshape import ExtractRule
    from ledgerloom.operators.rulepass import sheet_rows, wide_pass

    grid = {(1, 1): "id", (1, 2): "plan", (1, 4): "plan", (2, 2): "q1", (2, 3): "q2", (2, 4): "q1", (3, 1): "7.0", (3, 2): "a", (3, 3): "b", (4, 2): "", (4, 4): "d", (5, 1): "skip me", (5, 2): "x", (9, 3): "e"}
    cells = spark.createDataFrame([("book", "s", r, c, v) for (r, c), v in grid.items()] + [("book", "other", 3, 2, "z"), ("else", "s", 3, 2, "y")], "workbook string, sheet string, r long, c int, v string")
    merges = spark.createDataFrame([("book", "s", 1, 2, 1, 3), ("book", "s", 3, 1, 4, 1)], "workbook string, sheet string, r0 long, c0 int, r1 long, c1 int")
    rules = [
        ExtractRule("all", "book", "s", [1, 2], 1, [1], 3, 0, 2, 0, "skip", False), ExtractRule("one", "", "s", [2], 2, [2], 3, 4, 3, 3, "", False),
        ExtractRule("none", "nowhere", "", [1], 1, [1], 3, 0, 2, 0, "", False),
    ]
    rows, columns = wide_pass(cells, merges, rules)
    got = {(r.rule_no, r.workbook, r.sheet, r.row_head, r.r): dict(r["values"]) for r in rows.collect()}
    # "other" holds no keyword of a rule but the s of its name? It holds none: only sheets with an s.
    assert got == {
        (0, "book", "s", "7", 3): {"plan_q1_1": "a", "plan_q2": "b"}, (0, "book", "s", "7", 4): {"plan_q1_2": "d"}, (1, "book", "s", "a", 3): {"q2": "b"},
    }
    assert {(r.rule_no, r.path, r.c) for r in columns.filter("rule_no = 0").collect()} == {(0, "plan_q1_1", 2), (0, "plan_q2", 3), (0, "plan_q1_2", 4)}

    def shuffles(n):
        plan = sheet_rows(cells, rules[:1] * n)._jdf.queryExecution().executedPlan().toString()
        made, _ = wide_pass(cells, merges, rules[:1] * n)
        return len(re.findall(r"Exchange hash", plan + made._jdf.queryExecution().executedPlan().toString()))

    assert shuffles(1) == shuffles(12) <= 9
