"""User rules over ranges of cells, also of other sheets.

A rule applies to the cells of a range. Its operands are ranges whose references move with the cell unless
they carry a `$`, as in a sheet: applied to `Report!G3:G20`, the operand `C3:F3` is the same row's C to F, and
`Detail!$C$3:$C$9` the same nine cells for all. Ranges become rectangles; equal rectangles are aggregated
once, by an equi join on the tile a cell lies in, and come back to the cells as named values for the rule's
SQL expression.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.checks import rule_checks, unusable_rules
from ledgerloom.scale import rects_by_tile, with_rects

# Rows x columns of a tile.
TILE = (64, 256)
FUNCTIONS = ("sum", "min", "max", "count")
_AREA = re.compile(r"(?:'?([^'!]+)'?!)?(\$?)([A-Za-z]{1,3})(\$?)(\d+)(?::(\$?)([A-Za-z]{1,3})(\$?)(\d+))?$")


@dataclass(frozen=True)
class RangeRule:
    """`operands`: name -> (one of FUNCTIONS, range). The expression sees the cell's own `value` (number),
    `text`, and the operands; where it is true the cell is bad."""

    rule_id: str
    applies_to: str
    expr: str
    operands: dict[str, tuple[str, str]] = field(default_factory=dict)


def _area(reference: str, default_sheet: str | None = None) -> tuple:
    """(sheet, r0, c0, r1, c1, then for each corner whether row and column are fixed), 1-based."""
    found = _AREA.match(reference.strip())
    if not found:
        raise ValueError(f"not a range: {reference}")

    def column(letters: str) -> int:
        n = 0
        for x in letters.upper():
            n = n * 26 + ord(x) - 64
        return n

    sheet, fc0, c0, fr0, r0, fc1, c1, fr1, r1 = found.groups()
    if c1 is None:
        fc1, c1, fr1, r1 = fc0, c0, fr0, r0
    return sheet or default_sheet, int(r0), column(c0), int(r1), column(c1), bool(fr0), bool(fc0), bool(fr1), bool(fc1)


def _targets(rules: Sequence[RangeRule]) -> list[tuple]:
    """(rule_no, sheet, r0, c0, r1, c1) of every area a rule applies to; areas are joined by commas."""
    return [(i, *_area(a)[:5]) for i, rule in enumerate(rules) for a in rule.applies_to.split(",")]


def _operands(rules: Sequence[RangeRule]) -> list[tuple]:
    out = []
    for i, rule in enumerate(rules):
        sheet, r, c = _area(rule.applies_to.split(",")[0])[:3]
        for name, (function, area) in rule.operands.items():
            if function not in FUNCTIONS:
                raise ValueError(f"unknown function {function} in rule {rule.rule_id}")
            out.append((i, name, function, r, c, *_area(area, sheet)))
    return out


def _moved(start: str, fixed: str, by: Column) -> Column:
    return F.when(F.col(fixed), F.col(start)).otherwise(F.col(start) + by)


def _applies(rules: Sequence[RangeRule]) -> list[Column]:
    """Whether a cell lies in a rule's areas, by rule. Rules are written by hand, so their areas are compiled into the projection."""
    r, c, hit = F.col("r"), F.col("c"), [F.lit(False) for _ in rules]
    for i, sheet, r0, c0, r1, c1 in _targets(rules):
        if sheet is not None:
            hit[i] = hit[i] | ((F.col("sheet") == sheet) & r.between(r0, r1) & c.between(c0, c1))
    return hit


def _reached(rules: Sequence[RangeRule]) -> Column:
    """Whether some operand can reach a cell (o_sheet, r, c), from the areas its rule applies to."""
    out = F.lit(False)
    for i, _, _, br, bc, sheet, r0, c0, r1, c1, fr0, fc0, fr1, fc1 in _operands(rules):
        areas = [a[2:] for a in _targets(rules) if a[0] == i]
        up, left = min(a[0] for a in areas) - br, min(a[1] for a in areas) - bc
        down, right = max(a[2] for a in areas) - br, max(a[3] for a in areas) - bc
        rows = F.col("r").between(r0 if fr0 else r0 + up, r1 if fr1 else r1 + down)
        out = out | ((F.col("o_sheet") == sheet) & rows & F.col("c").between(c0 if fc0 else c0 + left, c1 if fc1 else c1 + right))
    return out


def operand_values(cells: DataFrame, rules: Sequence[RangeRule], book: str = "workbook") -> DataFrame:
    """(book, sheet, r, c, rule_no, value, text, operands map) of every cell a rule applies to.

    `cells` has book, sheet, r, c (1-based), v and v_num. An empty range sums and counts to 0, its least and
    largest value are null. Only numbers count.
    """
    wide = _operand_columns(cells, rules, book)
    own = F.array(*[F.array(*[F.lit(n) for n in rule.operands]).cast("array<string>") for rule in rules])
    entries = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("x")) for n in _names(rules)]).cast("array<struct<name:string,x:double>>")
    told = F.filter(entries, lambda e: F.array_contains(F.get(own, F.col("rule_no")), e["name"]))
    return wide.select(book, "sheet", "r", "c", "rule_no", "value", "text", F.when(F.size(told) > 0, F.map_from_entries(told)).alias("operands"))


def _operand_columns(cells: DataFrame, rules: Sequence[RangeRule], book: str) -> DataFrame:
    """`operand_values` with one column for each operand name, null where the rule has no such operand."""
    spark = cells.sparkSession
    x, y = F.col("c"), F.col("r")
    size = (TILE[1], TILE[0])
    hits = _applies(rules)
    any_hit = F.lit(False)
    for hit in hits:
        any_hit = any_hit | hit
    rule_nos = F.array_compact(F.array(*[F.when(hit, F.lit(i)) for i, hit in enumerate(hits)]))
    # The filter goes before the numbers, so that sheets without rules are not read.
    at = cells.filter(any_hit).select(book, "sheet", "r", "c", F.col("v_num").alias("value"), F.col("v").alias("text"), F.explode(rule_nos).alias("rule_no"))
    key, names = [book, "sheet", "r", "c", "rule_no"], _names(rules)
    bare = [i for i, rule in enumerate(rules) if not rule.operands]
    plain = at.filter(F.col("rule_no").isin(bare)).select(*key, "value", "text", *[F.lit(None).cast("double").alias(n) for n in names])
    if not names:
        return plain

    schema = "rule_no int, name string, function string, br long, bc long, o_sheet string, r0 long, c0 long, r1 long, c1 long, fr0 boolean, fc0 boolean, fr1 boolean, fc1 boolean"
    defined = spark.createDataFrame(_operands(rules), schema)
    down, right = F.col("r") - F.col("br"), F.col("c") - F.col("bc")
    asked = at.join(defined, "rule_no").select(
        *key, "value", "text", "name", "function", "o_sheet", (F.col("fr0") | F.col("fr1")).alias("_stays"),
        _moved("r0", "fr0", down).alias("q0"), _moved("c0", "fc0", right).alias("p0"), _moved("r1", "fr1", down).alias("q1"), _moved("c1", "fc1", right).alias("p1"),
    )
    # Rows first: joins sort by their keys in order, and few rectangles share a row.
    rect = ["q0", "p0", "q1", "p1", "o_sheet", book]
    # Only ranges that stay repeat for many cells; those that move down with them differ, and a tile takes each once.
    rects = asked.filter("_stays").select(*rect).distinct().unionByName(asked.filter("not _stays").select(*rect))
    tiled = rects_by_tile(rects, [book, "o_sheet"], size, ["q0", "p0", "q1", "p1"], (F.col("p0"), F.col("q0"), F.col("p1"), F.col("q1")), ["q0", "p0"])
    numbers = cells.filter("v_num is not null").select(book, F.col("sheet").alias("o_sheet"), "r", "c", "v_num").filter(_reached(rules))
    met = with_rects(numbers, tiled, [book, "o_sheet"], x, y, size).select(book, "o_sheet", "r", "c", "v_num", F.explode("_rects").alias("b"))
    held = met.filter((F.col("b.q0") <= y) & (y <= F.col("b.q1")) & (F.col("b.p0") <= x) & (x <= F.col("b.p1")))
    sums = held.groupBy("b.q0", "b.p0", "b.q1", "b.p1", "o_sheet", book).agg(
        F.sum(F.col("v_num").cast("decimal(28,6)")).cast("double").alias("sum"), F.min("v_num").alias("min"), F.max("v_num").alias("max"),
        F.count(F.lit(1)).cast("double").alias("count"),
    )
    found = asked.join(sums, rect, "left").withColumn(
        "x",
        F.when(F.col("function") == "sum", F.coalesce("sum", F.lit(0.0))).when(F.col("function") == "count", F.coalesce("count", F.lit(0.0)))
        .when(F.col("function") == "min", F.col("min")).otherwise(F.col("max")),
    )
    per_cell = found.groupBy("r", "c", "rule_no", "sheet", book, "text").agg(
        F.max("value").alias("value"), *[F.max(F.when(F.col("name") == n, F.col("x"))).alias(n) for n in names]
    ).select(*key, "value", "text", *names)
    return per_cell.unionByName(plain) if bare else per_cell


def range_checks(cells: DataFrame, rules: Sequence[RangeRule], book: str = "workbook") -> DataFrame:
    """(book, sheet, r, c, rule_id, value) of the cells where a rule's expression is true."""
    return rule_checks(_operand_columns(cells, rules, book), _as_rows(rules)).select(book, "sheet", "r", "c", "rule_id", "value")


def unusable_range_rules(cells: DataFrame, rules: Sequence[RangeRule], book: str = "workbook") -> dict[str, str]:
    """Rule id -> reason, of the rules whose expression does not resolve."""
    return unusable_rules(_operand_columns(cells, rules, book), _as_rows(rules))


def _names(rules: Sequence[RangeRule]) -> list[str]:
    return sorted({n for rule in rules for n in rule.operands})


def _as_rows(rules: Sequence[RangeRule]) -> list[tuple[str, str, str]]:
    return [(rule.rule_id, f"rule_no = {i}", rule.expr) for i, rule in enumerate(rules)]
