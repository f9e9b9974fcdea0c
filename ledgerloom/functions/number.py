"""Number expressions: lenient parsing, code text and typed coercion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import SPACES, half_width, let, strip, text_or_empty

PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_NON_FINITE = r"(?i)^[+-]?(nan|inf|infinity)$"
# Digit groups such as 1_000; an underscore stands between two digits.
_GROUPED = r"^[+-]?\d+(_\d+)*(\.\d+(_\d+)*)?$"


def numeric_text(c: Column) -> Column:
    """Amount text without whitespace and thousands marks."""
    return F.regexp_replace(text_or_empty(c), f"[{SPACES},，]", "")


def _parse(text: Column) -> Column:
    """Double for a plain number (try_cast alone would also take '1.0d')."""
    ok = F.regexp_like(text, F.lit(PLAIN_NUMBER)) | F.regexp_like(text, F.lit(_NON_FINITE))
    return F.when(ok, text.try_cast("double")).when(
        F.contains(text, F.lit("_")) & F.regexp_like(text, F.lit(_GROUPED)), F.replace(text, F.lit("_"), F.lit("")).try_cast("double")
    )


def num_lenient(c: Column) -> Column:
    """Number from messy text: blank is 0, else the number, else its numeric prefix, else 0."""
    text = c.cast("string")
    prefix = lambda t: F.regexp_extract(t, r"^([-+]?\d*\.?\d+)", 1).try_cast("double")
    messy = let(half_width(numeric_text(text)), lambda t: F.coalesce(_parse(t), prefix(t), F.lit(0.0)))
    return (
        F.when(text.isNull() | (text == ""), 0.0)
        .when(F.regexp_like(text, F.lit(PLAIN_NUMBER)), text.try_cast("double"))
        .otherwise(messy)
    )


def num_of_double(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def looks_numeric(c: Column) -> Column:
    return number_or_null(c).isNotNull()


def is_amount_text(c: Column) -> Column:
    return F.regexp_like(strip(c), F.lit(r"^[-+]?[\d,]+(\.\d+)?%?$"))


def number_or_null(c: Column) -> Column:
    return let(half_width(numeric_text(c)), _parse)


def plain_number(c: Column) -> Column:
    """Number of a text that is one as a whole, ends and thousands commas aside, else null: '1 2' is none."""
    return let(F.replace(strip(c), F.lit(","), F.lit("")), lambda t: F.when(
        F.regexp_like(t, F.lit(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$")), t.try_cast("double")))


def code_text(c: Column) -> Column:
    """Code as text: trimmed, '11600.0' becomes '11600'."""
    return F.regexp_replace(strip(c), r"^([-+]?\d+)\.0+$", "$1")


def double_text(c: Column) -> Column:
    """Text of a double; whole numbers without decimal point or exponent."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e18)
    return F.when(whole, c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))


def typed_code_text(vtype: Column, text: Column, num: Column) -> Column:
    """Code text of a typed cell (bool, number or string)."""
    return (
        F.when(vtype == "null", F.lit(""))
        .when(vtype == "bool", F.initcap(text))
        .when(vtype == "number", double_text(num))
        .otherwise(code_text(text))
    )


def typed_text_key(vtype: Column, text: Column, num: Column, ts: Column) -> Column:
    """De-duplication key: ISO date, whole number, or the text untouched."""
    return (
        F.when(vtype == "null", F.lit(""))
        .when(vtype == "date", F.date_format(ts, "yyyy-MM-dd"))
        .when(vtype == "number", double_text(num))
        .otherwise(text_or_empty(text))
    )


def text_key(c: Column, dtype: str) -> Column:
    """De-duplication key of a DataFrame column of Spark type `dtype`."""
    if dtype.startswith(("timestamp", "date")):
        key = F.date_format(c, "yyyy-MM-dd")
    elif dtype in ("double", "float"):
        key = double_text(c.cast("double"))
    else:
        key = c.cast("string")
    return F.coalesce(key, F.lit(""))


def coerce_number(c: Column) -> Column:
    """struct(kind, num, text, whole): int, decimal, percent (as fraction) or text.

    `whole` holds whole numbers of up to 38 digits exactly; `num` is the nearest double.
    """
    text = strip(c)
    bare = F.replace(text, F.lit(","), F.lit(""))
    percent = F.regexp_like(text, F.lit(r"^-?\d+(\.\d+)?%$"))
    whole = F.regexp_like(text, F.lit(r"^(-?\d+|-?\d{1,3}(,\d{3})*)$"))
    point = F.regexp_like(text, F.lit(r"^(-?\d+|-?\d{1,3}(,\d{3})*)\.\d+$"))
    return F.struct(
        F.when(percent, "percent").when(whole, "int").when(point, "decimal").otherwise("text").alias("kind"),
        F.when(percent, F.round(F.rtrim(text, F.lit("%")).try_cast("double") / 100.0, 6))
        .when(whole | point, bare.try_cast("double"))
        .alias("num"),
        F.when(~(percent | whole | point), text).alias("text"),
        F.when(whole, bare.try_cast("decimal(38,0)")).alias("whole"),
    )


def sig15(c: Column) -> Column:
    """Double cut to 15 significant digits."""
    finite = ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))) & (c != 0)
    return F.when(finite, F.format_string("%.14e", c).try_cast("double")).otherwise(c)
