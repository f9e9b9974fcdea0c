"""What grows with the input stays small in one task: order of steps in the plans, and the same rows as before."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog import QUERIES
from ledgerloom.operators import reshape


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_grid_rows_are_told_apart_before_their_columns(tables):
    from ledgerloom.catalog.reshape import grid_places

    text = plan(grid_places(tables))
    assert text.index("Generate") < text.index("Aggregate")  # the top of a plan comes first
    assert rows(grid_places(tables)) == rows(tables.grid.select("sheet", "r", "c").distinct())


def test_region_except_tells_no_cells_apart(spark, tables):
    assert plan(QUERIES["region_except"](tables)).count("Aggregate") == 2
    cells = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 1, 2), ("a", None, 3), ("b", 1, 2)], "sheet string, r long, c int")
    numeric = spark.createDataFrame([("a", 1, 2), ("a", 1, 2), ("a", None, 3), ("b", 1, 1)], "sheet string, r long, c int")
    assert rows(reshape.region_except(cells, numeric, ["sheet", "r", "c"])) == [("a", 1, 1), ("a", None, 3), ("b", 1, 2)]


def test_range_rules_join_orders_once(spark, tables):
    from ledgerloom.catalog.checks import RANGE_RULES, rule_cells
    from ledgerloom.operators import ranges

    # The numbers come with the orders, without a second join of the orders to themselves.
    assert plan(rule_cells(tables).filter("sheet = 'Orders'")).count("Join") == 1
    far = 1_048_577
    cells = spark.createDataFrame(
        [("B", "Orders", far, 2, 5.0), ("B", "Lines", far, 1, 1.0), ("B", "Lines", far, 7, 2.0), ("B", "Lines", far, 8, 90.0), ("B", "Orders", far, 3, 2.0)],
        "workbook string, sheet string, r long, c int, v_num double",
    ).withColumn("v", F.col("v_num").cast("string"))
    assert rows(ranges.range_checks(cells, RANGE_RULES)) == [("B", "Orders", far, 2, "sum", 5.0)]
    values = {(r.rule_no, r.r, r.c): r.operands for r in ranges.operand_values(cells, RANGE_RULES).collect()}
    assert values == {(0, far, 2): {"lines": 3.0}, (1, far, 2): {"most": 2.0}}


def test_merge_fill_deals_out_empty_cells_only(spark, tables):
    got = QUERIES["merge_fill"](tables)
    assert got.columns == ["workbook", "sheet", "r", "c", "v", "filled"]
    # Cells with a value come by a branch of their own, without any join.
    assert plan(got).index("Union") < plan(got).index("Join")
    cells = spark.createDataFrame(
        [("w", "s", 1, 1, "a"), ("w", "s", 1, 2, None), ("w", "s", 2, 1, ""), ("w", "s", 2, 2, "b"), ("w", "s", 3, 3, ""), ("w", "s", 4, 3, None), ("w", "s", 5, 1, None), (None, "s", 1, 2, None)],
        "workbook string, sheet string, r long, c int, v string",
    )
    merges = spark.createDataFrame([("w", "s", 1, 1, 2, 2), ("w", "s", 3, 3, 4, 3)], "workbook string, sheet string, r0 long, c0 int, r1 long, c1 int")
    assert rows(reshape.merge_fill(cells, merges)) == sorted([
        ("w", "s", 1, 1, "a", False), ("w", "s", 1, 2, "a", True), ("w", "s", 2, 1, "a", True), ("w", "s", 2, 2, "b", False), ("w", "s", 3, 3, "", False),
        ("w", "s", 4, 3, None, False), ("w", "s", 5, 1, None, False), (None, "s", 1, 2, None, False),
    ], key=str)


def test_rows_with_a_head_look_for_no_merge(spark, tables):
    from ledgerloom.catalog.reshape import RULES
    from ledgerloom.operators import rulepass

    wide, _ = rulepass.wide_pass(tables.sheet_cells, tables.sheet_merges, RULES)
    assert plan(wide).count("Union") == 1
    # Keywords are compiled, not parsed in each row.
    assert "split(" not in plan(rulepass.sheet_rows(tables.sheet_cells, RULES))
    cells = [("w", "s", 1, 1, "k"), ("w", "s", 1, 2, "a"), ("w", "s", 1, 3, "a"), ("w", "s", 1, 4, "a_2"), ("w", "s", 3, 1, "h"), ("w", "s", 3, 2, "x"), ("w", "s", 3, 4, "z"), ("w", "s", 4, 3, "y"), ("w", "s", 5, 2, "lost")]
    frame = spark.createDataFrame(cells, "workbook string, sheet string, r long, c int, v string")
    merges = spark.createDataFrame([("w", "s", 3, 1, 4, 1)], "workbook string, sheet string, r0 long, c0 int, r1 long, c1 int")
    rule = rulepass.ExtractRule(header_rows=[1], row_header_col=1, row_start=2, col_start=2, col_end=0)
    got = {r.r: (r.row_head, r["values"]) for r in rulepass.wide_pass(frame, merges, [rule])[0].collect()}
    assert got == {3: ("h", {"a_1": "x", "a_2": "z"}), 4: ("h", {"a_2": "y"})}


def test_walks_and_readers_stay_in_arrow(spark, tables):
    for name in ("interp_fill", "align_fuzzy"):
        assert "FlatMapGroupsInArrow" in plan(QUERIES[name](tables)), name
    assert "MapInArrow" in plan(QUERIES["scan_cells"](tables))


def test_nearest_line_of_few_columns():
    import pyarrow as pa

    from ledgerloom.operators.align import _nearest_free

    # Rows 5 and 6 both want y = 10; of two lines at the same distance the smaller number is taken, and a row out of reach takes none.
    group = pa.table({
        "page_id": [3] * 6, "is_row": [True, False, True, False, False, True], "no": [6, 9, 5, 2, 4, 7],
        "y": [10.0, 12.0, 10.0, 8.0, 40.0, 90.0], "reach": [5.0] * 6,
    })
    assert _nearest_free(group).to_pylist() == [{"page_id": 3, "r": 5, "line_no": 2}, {"page_id": 3, "r": 6, "line_no": 9}]
    assert _nearest_free(group.slice(0, 1)).num_rows == 0


def test_keys_of_near_codes_are_dealt_over_more_tasks_as_values_grow(spark, monkeypatch):
    from ledgerloom.operators import align, fuzzy_index

    items = spark.range(300).selectExpr("id % 7 as page_id", "cast(11000000 + id * 7 as string) as text")
    tpl = spark.range(250).selectExpr("'D' as doc", "'P' as page", "cast(id as int) as r", "cast(11000000 + id * 9 as string) as code", "'' as name")
    few = rows(align.template_hits(items, tpl))
    monkeypatch.setattr(fuzzy_index, "VALUES", 10)
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = align.template_hits(items, tpl)
    assert fuzzy_index.parts_for(spark, 10 * own) is None and fuzzy_index.parts_for(spark, 550) == 55 > own
    # In both joins the values (once for short, once for long ones) and the keys of both sides, then the pairs and the hits.
    assert plan(many).count("RepartitionByExpression") == 14
    assert many.rdd.getNumPartitions() == 55
    assert rows(many) == few and len(few) > 1000


def test_row_alignment_deals_its_near_keys_alike(spark, monkeypatch):
    from ledgerloom.operators import align, fuzzy_index

    tpl = spark.range(60).selectExpr("'D' as doc", "'P' as page", "cast(id as int) as r", "cast(1100 + id * 3 as string) as code", "concat('name of ', id * 37 % 61) as name")
    lines = spark.range(60).selectExpr(
        "id % 3 as page_id", "cast(id as int) as line_no", "cast(id * 20 as double) as y",
        "if(id % 4 = 0, '', cast(1101 + id * 3 as string)) as code", "concat('name if ', id * 37 % 61) as name", "cast(null as string) as text",
    )
    pages = spark.range(3).selectExpr("id as page_id", "'D' as doc", "'P' as page")
    few = rows(align.align_fuzzy(pages, tpl, lines))
    unknown = rows(align.unknown_lines(pages, tpl, lines, align.align_exact(pages, tpl, lines)))
    monkeypatch.setattr(fuzzy_index, "VALUES", 4)
    seen, wanted = lines.selectExpr("'D' as doc", "'P' as page", "code", "name"), tpl.selectExpr("doc", "page", "code as t_code", "name as t_name")
    assert plan(align.candidate_keys(seen, wanted, 29)).count(", 29") >= 8
    assert rows(align.align_fuzzy(pages, tpl, lines)) == few and len(few) > 20
    assert rows(align.unknown_lines(pages, tpl, lines, align.align_exact(pages, tpl, lines))) == unknown


def test_region_tiles_are_not_sent_through_the_driver(spark, tables):
    """Areas have many tiles each, which the planner does not know of; what is broadcast is one row of two numbers."""
    text = QUERIES["region_cells"](tables)._jdf.queryExecution().sparkPlan().toString()
    assert text.count("SortMergeJoin") == 1 and "BroadcastHashJoin" not in text
    rects = spark.createDataFrame([("a", "NUM1", 3, 1, 2000, 2), ("a", "NUM1", 3, 1, 2000, 2), ("a", "MID", 5, 0, 6, 0), ("b", "STRUCT", 2, 1, 4, 1), ("b", "other", 0, 0, 9000, 9), (None, "NUM", 1, 1, 9, 9), ("a", "NUM9", None, 1, 9, 9)], "sheet string, name string, r0 int, c0 int, r1 int, c1 int")
    cells = spark.createDataFrame([(s, r, c) for s in ("a", "b", None) for r in (None, 0, 1, 2, 3, 5, 6, 1500, 2000, 2001, 9000, 9001) for c in (1, 2, 3)], "sheet string, r long, c int")
    want = [("a", r, c, "numeric") for r in (3, 5, 6, 1500, 2000) for c in (1, 2)] + [("a", r, c, "mid") for r in (5, 6) for c in (1, 2, 3)] + [("b", r, 1, "struct") for r in (2, 3)]
    near = reshape.reached_rows(cells, rects)
    assert rows(reshape.region_cells(cells, rects)) == rows(reshape.region_cells(near, rects)) == sorted(want, key=str)
    assert {x.r for x in near.collect()} == {0, 1, 2, 3, 5, 6, 1500, 2000, 2001, 9000}
    assert reshape.reached_rows(cells, rects.limit(0)).count() == 0 == reshape.region_cells(cells, rects.limit(0)).count()
