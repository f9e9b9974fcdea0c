"""Multi-row headers and merged cells -> column paths, wide rows and long rows.

Sheets are (workbook, sheet, r, c, v) with 1-based r and c; a missing cell is empty.
A sheet has at most 1,048,576 rows and 16,384 columns, which bounds every per-row
and per-header group below.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions.geometry import column_letter
from ledgerloom.functions.number import code_text, plain_number
from ledgerloom.functions.text import drop_repeats, has_any_keyword, match_all_keywords, strip
from ledgerloom.scale import rects_by_tile, shuffled, with_rects

SHEET = ["workbook", "sheet"]
_TILE = (64, 1024)


@dataclass
class ExtractRule:
    """One reshape rule. Column and row numbers are 1-based; 0 means open."""

    name: str = "OCR导出表"
    wb_keyword: str = ""
    sheet_keyword: str = ""
    header_rows: list[int] = field(default_factory=lambda: [1, 2])
    row_header_col: int = 1
    row_header_cols: list[int] = field(default_factory=lambda: [1, 2])
    row_start: int = 3
    row_end: int = 0
    col_start: int = 3
    col_end: int = 8
    skip_keywords: str = ""
    only_numeric: bool = True
    target: str = ""
    dedup: str = ""
    write: bool = True


def empty(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def merges_with_value(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Merges with the value of their top-left cell, null if it is empty.

    Only filled cells in a column where some merge begins are dealt out; these columns are at most those of a sheet.
    """
    starts = F.broadcast(merges.select(F.col("c0").cast("int").alias("c")).distinct())
    filled = cells.filter(~empty(F.col("v"))).join(starts, "c", "left_semi")
    anchors = filled.select(*SHEET, F.col("r").alias("r0"), F.col("c").alias("c0"), F.col("v").alias("anchor"))
    return merges.join(anchors, ["r0", "c0", *reversed(SHEET)], "left")


def merge_fill(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Empty cells inside a merge take its top-left value; `filled` tells which. Cells with a value stay where they are."""
    blank = empty(F.col("v"))
    tiled = _merge_tiles(merges_with_value(cells, merges))
    placed = with_rects(cells.filter(blank), tiled, SHEET, F.col("c"), F.col("r"), _TILE)
    anchor = _covering_anchor(F.col("_rects"), F.col("r"), F.col("c"))
    take = ~empty(anchor)
    found = placed.withColumn("filled", take).withColumn("v", F.when(F.col("filled"), anchor).otherwise(F.col("v"))).drop("_rects")
    return cells.filter(~blank).withColumn("filled", F.lit(False)).unionByName(found)


def _merge_tiles(valued: DataFrame) -> DataFrame:
    box = (F.col("c0"), F.col("r0"), F.col("c1"), F.col("r1"))
    return rects_by_tile(valued, SHEET, _TILE, ["r0", "c0", "r1", "c1", "anchor"], box, ["r0", "c0"])


def _covering_anchor(rects: Column, r: Column, c: Column) -> Column:
    inside = F.filter(rects, lambda m: (m["r0"] <= r) & (r <= m["r1"]) & (m["c0"] <= c) & (c <= m["c1"]))
    return F.get(inside, F.lit(0))["anchor"]


def sheet_width(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*SHEET).agg(F.max("c").alias("width"))


def header_grid(cells: DataFrame, merges: DataFrame, header_rows: Sequence[int]) -> DataFrame:
    """Every header cell up to the sheet's width, with merge anchors filled in.

    Only header rows and the merges touching them are read.
    """
    rows = [int(r) for r in header_rows]
    top = cells.filter(F.col("r").isin(rows))
    places = (
        sheet_width(cells)
        .select(*SHEET, F.explode(F.sequence(F.lit(1), F.col("width"))).alias("c"))
        .select(*SHEET, "c", F.explode(F.array(*[F.lit(r) for r in rows]).cast("array<long>")).alias("r"))
    )
    grid = places.join(top.select(*SHEET, "r", "c", "v"), [*SHEET, "r", "c"], "left")
    touching = merges.filter((F.col("r0") <= max(rows)) & (F.col("r1") >= min(rows)))
    anchors = merges_with_value(cells.filter(F.col("r") <= max(rows)), touching)
    filled = with_rects(grid, _merge_tiles(anchors), SHEET, F.col("c"), F.col("r"), _TILE)
    anchor = _covering_anchor(F.col("_rects"), F.col("r"), F.col("c"))
    return filled.select(*SHEET, "r", "c", F.when(empty(F.col("v")), anchor).otherwise(F.col("v")).alias("v"))


def _parts(header_rows: Sequence[int]) -> Column:
    """Header texts of one column, in the order of the listed header rows."""
    order = {int(r): i for i, r in enumerate(header_rows)}
    rank = F.coalesce(*[F.when(F.col("r") == r, F.lit(i)) for r, i in order.items()])
    return F.transform(F.sort_array(F.collect_list(F.struct(rank.alias("i"), strip(F.col("v")).alias("t")))), lambda x: x["t"])


def column_paths(cells: DataFrame, merges: DataFrame, header_rows: Sequence[int], col_start: int = 1, col_end: int = 0) -> DataFrame:
    """(workbook, sheet, c, path): header texts joined with `_`, repeated paths numbered `_1`, `_2`."""
    grid = header_grid(cells, merges, header_rows).filter(F.col("c") >= max(col_start, 1))
    if col_end:
        grid = grid.filter(F.col("c") <= col_end)
    raw = grid.groupBy(*SHEET, "c").agg(F.array_join(F.filter(_parts(header_rows), lambda x: x != ""), "_").alias("raw"))
    same = Window.partitionBy(*SHEET, "raw")
    nth = F.row_number().over(same.orderBy("c"))
    return raw.select(
        *SHEET, "c",
        F.when(F.col("raw") == "", F.concat(F.lit(fv.UNNAMED_COLUMN_PREFIX), column_letter(F.col("c"))))
        .when(F.count(F.lit(1)).over(same) > 1, F.concat("raw", F.lit("_"), nth))
        .otherwise(F.col("raw")).alias("path"),
    )


def header_forward_fill(cells: DataFrame, merges: DataFrame, header_rows: Sequence[int]) -> DataFrame:
    """Header texts carried to the right; a vertical merge shows its top row."""
    rows = [int(r) for r in header_rows]
    places = (
        sheet_width(cells)
        .select(*SHEET, F.explode(F.sequence(F.lit(1), F.col("width"))).alias("c"))
        .select(*SHEET, "c", F.explode(F.array(*[F.lit(r) for r in rows]).cast("array<long>")).alias("r"))
    )
    touching = merges.filter((F.col("r0") <= max(rows)) & (F.col("r1") >= min(rows))).withColumn("anchor", F.lit(None).cast("string"))
    placed = with_rects(places, _merge_tiles(touching), SHEET, F.col("c"), F.col("r"), _TILE)
    r, c = F.col("r"), F.col("c")
    inside = F.filter("_rects", lambda m: (m["r0"] <= r) & (r <= m["r1"]) & (m["c0"] <= c) & (c <= m["c1"]))
    sourced = placed.withColumn("_from", F.coalesce(F.get(inside, F.lit(0))["r0"], r)).drop("_rects")
    top = cells.filter(F.col("r") <= max(rows)).select(*SHEET, F.col("r").alias("_from"), "c", strip(F.col("v")).alias("v"))
    along = Window.partitionBy(*SHEET, "r").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    text = F.last(F.nullif("v", F.lit("")), ignorenulls=True).over(along)
    return sourced.join(top, [*SHEET, "_from", "c"], "left").select(*SHEET, "r", "c", F.coalesce(text, F.lit("")).alias("v"))


def header_labels(grid: DataFrame, header_rows: Sequence[int], separator: str = "_", blank: Column | None = None) -> DataFrame:
    """(workbook, sheet, c, label): header texts without consecutive repeats."""
    label = F.array_join(drop_repeats(_parts(header_rows)), separator)
    out = grid.filter(F.col("r").isin([int(r) for r in header_rows])).groupBy(*SHEET, "c").agg(label.alias("label"))
    return out if blank is None else out.withColumn("label", F.when(F.col("label") == "", blank).otherwise(F.col("label")))


def _rule_cells(cells: DataFrame, rule: ExtractRule) -> DataFrame:
    """Cells of the sheets a rule covers; keyword tests run before any shuffle."""
    fits = match_all_keywords(F.col("workbook"), F.lit(rule.wb_keyword)) & match_all_keywords(F.col("sheet"), F.lit(rule.sheet_keyword))
    return cells.filter(fits)


def strip_list(text: str) -> list[str]:
    return [x.strip() for x in text.split(";") if x.strip()]


def sheet_numbers(cells: DataFrame) -> DataFrame:
    """(workbook, sheet, sheet_no) of every sheet; 0 where the cells carry no number."""
    number = F.min("sheet_no") if "sheet_no" in cells.columns else F.lit(0)
    return cells.groupBy(*SHEET).agg(F.coalesce(number, F.lit(0)).cast("int").alias("sheet_no"))


def column_order(cells: DataFrame, merges: DataFrame, rules: Sequence[ExtractRule]) -> DataFrame:
    """Union of column paths, each with the place (rule_no, workbook, sheet_no, sheet, c) where it is seen first.

    Sheets come in the order of `sheet_no`; without that column, by name.
    """
    seen = None
    for no, rule in enumerate(rules):
        used = _rule_cells(cells, rule)
        part = column_paths(used, merges, rule.header_rows, rule.col_start, rule.col_end).withColumn("rule_no", F.lit(no))
        part = part.join(sheet_numbers(used), SHEET, "left")
        seen = part if seen is None else seen.unionByName(part)
    first = F.min(F.struct("rule_no", "workbook", "sheet_no", "sheet", "c")).alias("at")
    return seen.groupBy("path").agg(first).select("path", "at.*")


def wide_table(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Map of values -> one column per listed path."""
    rest = [c for c in rows.columns if c != "values"]
    return rows.select(*rest, *[F.element_at("values", F.lit(p)).alias(p) for p in columns])


def long_rows(cells: DataFrame, merges: DataFrame, rule: ExtractRule) -> DataFrame:
    """(workbook, sheet, rule, row_head, col_head, r, c, value, value_num), one row per kept cell."""
    used = cells
    if rule.wb_keyword:
        used = used.filter(F.contains("workbook", F.lit(rule.wb_keyword)))
    if rule.sheet_keyword:
        used = used.filter(F.contains("sheet", F.lit(rule.sheet_keyword)))
    start = max(rule.row_start or 3, max(rule.header_rows) + 1)
    c_first = rule.col_start or 3
    heads = [int(c) for c in rule.row_header_cols]
    is_head, in_data = F.col("c").isin(heads), F.col("c") >= c_first
    body = used.filter((F.col("r") >= start) & (is_head | in_data) & ~empty(F.col("v")))
    texts = [F.coalesce(F.max(F.when(F.col("c") == c, strip(F.col("v")))), F.lit("")) for c in heads]
    # Numbers first, as groups and joins sort by their keys in order and names of books begin alike.
    rows = body.groupBy("r", *reversed(SHEET)).agg(
        F.concat_ws(" | ", *texts).alias("row_head"),
        F.sort_array(F.collect_list(F.when(in_data, F.struct("c", "v")))).alias("cells"),
    )
    if strip_list(rule.skip_keywords):
        rows = rows.filter(~has_any_keyword(F.col("row_head"), F.lit(rule.skip_keywords)))
    flat = rows.select(*SHEET, "r", "row_head", F.inline("cells"))
    if rule.col_end:
        flat = flat.filter(F.col("c") <= rule.col_end)
    number = plain_number(F.col("v"))
    if rule.only_numeric:
        flat = flat.filter(number.isNotNull())
    grid = header_forward_fill(used, merges, rule.header_rows)
    labels = header_labels(grid, rule.header_rows, "_", F.concat(F.lit("列"), F.col("c")))
    return flat.join(labels, ["sheet", "c", "workbook"], "left").select(
        *SHEET, F.lit(rule.name).alias("rule"), "row_head", F.col("label").alias("col_head"), "r", "c",
        strip(F.col("v")).alias("value"), number.alias("value_num"),
    )


REGION_CLASSES = [("numeric", "(?i)^(数字|NUM)"), ("struct", "(?i)^(结构|STRUCT)"), ("mid", "(?i)^(中缝|MID)")]


def reached_rows(rows: DataFrame, rects: DataFrame) -> DataFrame:
    """The rows (or cells) that lie neither above nor below all rectangles; two numbers, in one row, are sent to them."""
    reach = rects.agg(F.min("r0").alias("_lo"), F.max("r1").alias("_hi"))
    return rows.join(F.broadcast(reach), F.col("r").between(F.col("_lo"), F.col("_hi"))).select(*rows.columns)


def region_cells(cells: DataFrame, rects: DataFrame) -> DataFrame:
    """Cells inside named rectangles (sheet, name, r0, c0, r1, c1), with the class its name gives."""
    name = F.col("name")
    kind = F.coalesce(*[F.when(F.regexp_like(name, F.lit(p)), F.lit(k)) for k, p in REGION_CLASSES])
    classed = rects.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    tiled = rects_by_tile(
        classed, ["sheet"], _TILE, ["r0", "c0", "r1", "c1", "kind"], (F.col("c0"), F.col("r0"), F.col("c1"), F.col("r1")), ["kind", "r0", "c0"]
    )
    r, c = F.col("r"), F.col("c")
    # A rectangle has many tiles, which the planner does not know of.
    placed = with_rects(cells, shuffled(tiled), ["sheet"], c, r, _TILE)
    inside = F.filter("_rects", lambda m: (m["r0"] <= r) & (r <= m["r1"]) & ((m["kind"] == "mid") | (m["c0"] <= c) & (c <= m["c1"])))
    kinds = F.array_distinct(F.transform(inside, lambda m: m["kind"]))
    return placed.select(*cells.columns, F.explode(kinds).alias("kind"))


def region_union(*regions: DataFrame) -> DataFrame:
    """Distinct cells of several regions."""
    out = regions[0]
    for part in regions[1:]:
        out = out.unionByName(part)
    return out.dropDuplicates()


def region_except(all_cells: DataFrame, numeric: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Structure cells: everything outside the numeric region. An anti join asks whether a match exists, so repeats need not be cut before."""
    return all_cells.join(numeric.select(*keys), list(keys), "left_anti")


def mid_section(rows: DataFrame, header_rows: int = 0) -> DataFrame:
    """First second-header row per sheet (sheet, r, code, text), -1 when there is none.

    It is the first row without a code that holds a header word, below a total row that
    itself is below a data row. All three are minima, so no ordered scan is needed.
    """
    body = rows.filter(F.col("r") >= header_rows)
    coded = F.regexp_like("code", F.lit(r"\d"))
    seen = body.groupBy("sheet").agg(F.min(F.when(coded, F.col("r"))).alias("_data"))
    plain = body.filter(~coded).join(seen, "sheet")
    is_total = F.contains("text", F.lit(fv.TOTAL_WORD)) & (F.col("r") > F.col("_data"))
    totals = plain.filter(is_total).groupBy("sheet").agg(F.min("r").alias("_total"))
    is_head = F.lit(False)
    for word in fv.MID_HEADER_WORDS:
        is_head |= F.contains("text", F.lit(word))
    heads = plain.filter(is_head & ~is_total).join(totals, "sheet").filter(F.col("r") > F.col("_total"))
    found = heads.groupBy("sheet").agg(F.min("r").alias("_mid"))
    return rows.select("sheet").distinct().join(found, "sheet", "left").select("sheet", F.coalesce("_mid", F.lit(-1)).cast("long").alias("mid_row"))
