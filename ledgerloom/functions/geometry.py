"""Column letters, A1 ranges and page geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import strip


def column_index(c: Column) -> Column:
    """'B' -> 2, digits pass, anything else 0."""
    s = F.upper(strip(c))
    letters = F.aggregate(F.split(s, ""), F.lit(0), lambda acc, ch: acc * 26 + F.ascii(ch) - 64)
    return (
        F.when(F.regexp_like(s, F.lit(r"^\d+$")), s.try_cast("int"))
        .when(F.regexp_like(s, F.lit("^[A-Z]+$")), letters)
        .otherwise(F.lit(0))
    )


def column_letter(index: Column) -> Column:
    """1 -> 'A' ... up to three letters ('ZZZ' = 18278), which covers every sheet width; an error beyond."""
    i = index.cast("long")
    last = F.char((i - 1) % 26 + 65)
    j = F.floor((i - 1) / 26)
    middle = F.when(j >= 1, F.char((j - 1) % 26 + 65)).otherwise("")
    k = F.floor((j - 1) / 26)
    first = F.when(k >= 1, F.char((k - 1) % 26 + 65)).otherwise("")
    beyond = F.raise_error(F.concat(F.lit("no column letters for "), i.cast("string"))).cast("string")
    return F.when((i < 1) | (i > 18278), beyond).otherwise(F.concat(first, middle, last))


_REF = r"(?i)^([A-Z]{1,3})(\d+)(?::([A-Z]{1,3})(\d+))?$"


def parse_reference(part: Column, default_sheet: Column) -> Column:
    """One A1 reference -> struct(sheet, r0, c0, r1, c1), 0-based; null fields when invalid."""
    bare = F.replace(strip(part), F.lit("$"), F.lit(""))
    sheet = F.regexp_extract(bare, r"^'?([^'!]+)'?!(.+)$", 1)
    area = F.when(sheet == "", bare).otherwise(F.regexp_extract(bare, r"^'?([^'!]+)'?!(.+)$", 2))
    ok = F.regexp_like(area, F.lit(_REF))
    group = lambda n: F.regexp_extract(area, _REF, n)
    c_to = F.when(group(3) == "", group(1)).otherwise(group(3))
    r_to = F.when(group(4) == "", group(2)).otherwise(group(4))
    return F.struct(
        F.when(sheet == "", default_sheet).otherwise(sheet).alias("sheet"),
        F.when(ok, group(2).try_cast("int") - 1).alias("r0"),
        F.when(ok, column_index(group(1)) - 1).alias("c0"),
        F.when(ok, r_to.try_cast("int") - 1).alias("r1"),
        F.when(ok, column_index(c_to) - 1).alias("c1"),
    )


def lay_edges(fracs: Column, start: Column, end: Column) -> Column:
    """Fractions of a span -> pixel edges, halves to even."""
    return F.transform(fracs, lambda f: F.bround(start + f * (end - start)).cast("int"))


def edge_fracs(edges: Column) -> Column:
    """Pixel edges -> fractions of their span, 5 decimals."""
    start = F.element_at(edges, 1)
    span = F.greatest(F.element_at(edges, -1) - start, F.lit(1))
    return F.transform(edges, lambda x: F.round((x - start) / span, 5))


def inside_closed(cx: Column, cy: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    return (cx >= x) & (cx <= x + w) & (cy >= y) & (cy <= y + h)


def inside_half_open(cx: Column, cy: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    return (cx >= x) & (cx < x + w) & (cy >= y) & (cy < y + h)
