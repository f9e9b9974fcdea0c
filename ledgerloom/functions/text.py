"""Text expressions: stripping, keys, names and punctuation."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv

# Space characters, with the no-break and ideographic ones that \s leaves out.
SPACES = "\\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WS = f"[{SPACES}]"
FULL_WIDTH = "".join(chr(c) for c in [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)])
HALF_WIDTH = "".join(chr(ord(c) - 0xFEE0) for c in FULL_WIDTH)

# Half-width marks and the full-width marks they become.
HALF_MARKS = ",:;!?()"
FULL_MARKS = "，：；！？（）"
_FLAG = "\ue000"
_CJK = r"一-鿿"
_CJK_CONTEXT = _CJK + "，。；：！？（）"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(text_or_empty(c), rf"{_WS}+$|^{_WS}+", "")


def squeeze(c: Column) -> Column:
    """Remove every whitespace character."""
    return F.regexp_replace(text_or_empty(c), rf"{_WS}+", "")


def half_width(c: Column) -> Column:
    wide = F.regexp_like(c, F.lit("[０-９Ａ-Ｚａ-ｚ]"))
    return F.when(wide, F.translate(c, FULL_WIDTH, HALF_WIDTH)).otherwise(c)


def has_meaning(c: Column) -> Column:
    return F.regexp_like(text_or_empty(c), F.lit(r"[\p{L}\p{N}]"))


def key_code(c: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(text_or_empty(c), r"[^\p{L}\p{N}]", "")


def digits(c: Column) -> Column:
    return F.regexp_replace(text_or_empty(c), r"[^\p{Nd}]", "")


def normalize_text(c: Column) -> Column:
    """Half-width letters and digits; full-width marks beside CJK text.

    Marks are flagged first, each by its original neighbours, and widened afterwards,
    so a widened mark never counts as context for the next one.
    """
    # Text without CJK or full-width marks has no context to widen and no mark to trim around.
    has_context = F.lit(f"[{_CJK_CONTEXT}【】《》]")
    return let(half_width(text_or_empty(c)), lambda t: F.when(F.regexp_like(t, has_context), _widen_marks(t)).otherwise(t))


def _widen_marks(out: Column) -> Column:
    out = F.regexp_replace(out, rf"([{_CJK_CONTEXT}][ 　]*+)([{HALF_MARKS}])", f"$1{_FLAG}$2")
    out = F.regexp_replace(out, rf"{_FLAG}?+([{HALF_MARKS}])(?=[ 　]*[{_CJK_CONTEXT}])", f"{_FLAG}$1")
    for half, full in zip(HALF_MARKS, FULL_MARKS):
        out = F.replace(out, F.lit(_FLAG + half), F.lit(full))
    out = F.regexp_replace(out, rf"{_WS}++([，。；：！？）】》（【《])", "$1")
    return F.regexp_replace(out, rf"([（【《]){_WS}+", "$1")


def compare_key(c: Column) -> Column:
    """Blind to spaces and to full/half-width marks; used by grid accuracy."""
    folded = F.translate(text_or_empty(c), FULL_MARKS + "　", HALF_MARKS + " ")
    return strip(F.replace(folded, F.lit(" "), F.lit("")))


def title_like(c: Column) -> Column:
    bare = F.regexp_replace(text_or_empty(c), "|".join(fv.TITLE_STOP_WORDS), "")
    bare = F.regexp_replace(bare, f"[{SPACES}0-9（）()：:．.、·—\\-‐–]+", "")
    return F.length(bare) >= 2


def safe_sheet_name(c: Column, limit: int = fv.EXCEL_NAME_LIMIT) -> Column:
    filled = F.when(text_or_empty(c) == "", F.lit("Sheet")).otherwise(text_or_empty(c))
    clean = strip(F.regexp_replace(filled, r"[\\/*?:\[\]]", "_"))
    return F.left(F.coalesce(F.nullif(clean, F.lit("")), F.lit("Sheet")), F.lit(limit))


def safe_file_name(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)[^\w.\-{_CJK}]+", "_")


def match_all_keywords(text: Column, keywords: Column) -> Column:
    parts = F.filter(F.split(text_or_empty(keywords), "[;，,]"), lambda x: x != "")
    return F.forall(parts, lambda k: F.contains(text, k))


def holds_all(text: Column, keywords: str) -> Column:
    """`match_all_keywords` for keywords that are known when the query is built."""
    held = F.lit(True)
    for part in re.split("[;，,]", keywords or ""):
        if part:
            held = held & F.contains(text, F.lit(part))
    return held


def has_any_keyword(text: Column, keywords: Column) -> Column:
    parts = F.filter(F.transform(F.split(strip(keywords), ";"), strip), lambda x: x != "")
    return F.exists(parts, lambda k: F.contains(text, k))


def drop_repeats(parts: Column) -> Column:
    """Drop blanks and parts equal to the part kept before them."""
    return F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(
            (F.coalesce(x, F.lit("")) == "")
            | (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) == x),
            acc,
        ).otherwise(F.concat(acc, F.array(x))),
    )
