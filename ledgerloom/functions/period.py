"""Periods, dates and file names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions.text import let, strip, text_or_empty


def _bare(c: Column) -> Column:
    return strip(F.regexp_replace(text_or_empty(c), r"[-./]", ""))


def _dotted(bare: Column, raw: Column) -> Column:
    month = F.lpad(F.substring(bare, 5, 2), 2, "0")
    return F.when(F.length(bare) >= 6, F.concat(F.substring(bare, 1, 4), F.lit("."), month)).otherwise(raw)


def normalize_period(c: Column) -> Column:
    """'2026-09', '202609' ... -> '2026.09'; shorter text unchanged."""
    return let(_bare(c), lambda t: _dotted(t, c))


def constant_period(header: str) -> Column:
    """Period of a header known when the plan is built; folds to a literal."""
    raw = strip(F.lit(header))
    return _dotted(_bare(raw), raw)


def header_period(text: Column, num: Column | None = None) -> Column:
    """Period of a header cell; numeric YYYY.1 may be January or October and stays raw."""
    if num is None:
        return normalize_period(strip(text))
    raw = num.cast("string")
    unclear = F.regexp_like(raw, F.lit(r"^\d{4}\.1$"))
    return (
        F.when(num.isNull(), normalize_period(strip(text)))
        .when(unclear, raw)
        .otherwise(normalize_period(F.format_string("%.2f", num)))
    )


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def file_period(name: Column) -> Column:
    first = F.element_at(F.split(file_stem(name), " "), 1)
    return F.when(first == "", F.lit("")).otherwise(normalize_period(first))


def file_rest(name: Column) -> Column:
    parts = F.split(file_stem(name), " ")
    rest = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "")
    return F.when(rest == "", file_stem(name)).otherwise(rest)


def match_region(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Region whose keyword occurs in the text; longest keyword wins, then rule order.

    Rules are job configuration, so the match is a plain projection: no join.
    """
    ordered = sorted(rules, key=lambda rule: -len(rule[1]))
    first = lambda t: F.coalesce(*[F.when(F.contains(t, F.lit(k)), F.lit(n)) for n, k in ordered], F.lit(fv.UNKNOWN_REGION))
    return let(text, first)


def file_region(name: Column, rules: Sequence[tuple[str, str]]) -> Column:
    matched = match_region(file_rest(name), rules)
    return F.when(file_period(name) == "", F.lit(fv.UNKNOWN_REGION)).otherwise(matched)


def data_date(stem: Column, fallback: Column) -> Column:
    """YYYYMMDD in a file stem, else the fallback date."""
    found = F.regexp_extract(stem, r"(20\d{2})[_.-]?(\d{2})[_.-]?(\d{2})", 0)
    digits = F.regexp_replace(found, r"[_.-]", "")
    parsed = F.when(F.length(digits) == 8, F.try_to_date(digits, "yyyyMMdd"))
    return F.coalesce(parsed, fallback.cast("date"))


def ledger_period(c: Column) -> Column:
    """'2026年9月...' -> '2026-09', else 'ERR'."""
    pattern = r"(\d{4})年(\d{1,2})月"
    year, month = F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)
    return F.when(F.coalesce(year, F.lit("")) == "", F.lit("ERR")).otherwise(
        F.concat(year, F.lit("-"), F.lpad(month, 2, "0"))
    )
