"""Fuzzy equality of codes, row keys and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.number import looks_numeric
from ledgerloom.functions.text import digits, key_code, let, squeeze, text_or_empty


# Texts of ASCII characters are compared seven places at a time, as numbers, up to this length.
_PACKED = 35


def _packed(c: Column, at: int, size: Column) -> Column:
    """`size` ASCII characters from place `at` on (0-based) as the bytes of a number."""
    return F.conv(F.hex(F.substr(c, F.lit(at + 1), size)), 16, 10).cast("long")


def _differing(a: Column, b: Column, common: Column) -> Column:
    """Places among the first `common` ones in which two ASCII texts differ."""
    out = F.lit(0)
    for at in range(0, _PACKED, 7):
        size = F.least(F.lit(7), common - at)
        bits = _packed(a, at, size).bitwiseXOR(_packed(b, at, size))
        # The highest bit of each byte is free, and set by this sum where the byte has any bit.
        places = (bits + F.lit(0x7F7F7F7F7F7F7F)).bitwiseAND(F.lit(0x80808080808080))
        out = out + F.when(common > at, F.bit_count(places)).otherwise(0)
    return out


def agreement(a: Column, b: Column) -> Column:
    """Share of positions with the same character, over the longer length."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y) & x.isNotNull() & y.isNotNull())
    same = F.size(F.filter(pairs, lambda hit: hit))
    common, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    plain = (common > 0) & (common <= _PACKED) & (F.octet_length(a) == F.length(a)) & (F.octet_length(b) == F.length(b))
    return F.when(plain, common - _differing(a, b, common)).otherwise(same) / longer


def _pair(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def _near(a: Column, b: Column, share: float) -> Column:
    return (F.abs(F.length(a) - F.length(b)) <= 1) & (agreement(a, b) >= share)


def coded_match(ka: Column, kb: Column) -> Column:
    """`codes_match` on keys that are columns already."""
    return (ka == kb) | ((ka != "") & (kb != "") & _near(ka, kb, 0.7))


def codes_match(a: Column, b: Column) -> Column:
    return let(_pair(key_code(a), key_code(b)), lambda k: coded_match(k["a"], k["b"]))


def _digits_inside(short: Column, long: Column) -> Column:
    spare = F.length(long) - F.length(short)
    return (F.length(short) >= 3) & F.contains(long, short) & (spare <= F.length(long) * F.lit(0.6))


def keys_match(ka: Column, da: Column, kb: Column, db: Column) -> Column:
    """`key_match` on keys and digits that are columns already."""
    return (ka != "") & (kb != "") & (
        (ka == kb) | _digits_inside(da, db) | _digits_inside(db, da) | _near(ka, kb, 0.75)
    )


def near_keys_match(ka: Column, kb: Column) -> Column:
    """Equal keys or nearly the same positions: `keys_match` but for the digits."""
    return (ka != "") & (kb != "") & ((ka == kb) | _near(ka, kb, 0.75))


def key_match(a: Column, b: Column) -> Column:
    """Equal keys, digits inside one another, or nearly the same positions."""
    return let(
        _pair(key_code(a), key_code(b)),
        lambda k: let(_pair(digits(k["a"]), digits(k["b"])), lambda d: keys_match(k["a"], d["a"], k["b"], d["b"])),
    )


def squeezed_match(x: Column, y: Column, numeric_x: Column, numeric_y: Column) -> Column:
    """`text_match` on texts without spaces of which is known whether they are numbers."""
    no_comma = lambda c: F.replace(c, F.lit(","), F.lit(""))
    long = (F.length(x) >= 4) & (F.length(y) >= 4)
    similar = F.when(numeric_x & numeric_y, no_comma(x) == no_comma(y)).otherwise(long & (agreement(x, y) >= 0.8))
    return (x != "") & (y != "") & ((x == y) | similar)


def text_match(a: Column, b: Column) -> Column:
    """Same text without spaces, same number without commas, or long texts that nearly agree."""
    return let(_pair(squeeze(a), squeeze(b)), lambda s: squeezed_match(s["a"], s["b"], looks_numeric(s["a"]), looks_numeric(s["b"])))


def row_key_match(tpl_code: Column, tpl_name: Column, code: Column, name: Column) -> Column:
    """A template row and a read row name the same subject."""
    both = F.concat(text_or_empty(code), text_or_empty(name))
    by_code = (
        (tpl_code != "")
        & key_match(tpl_code, both)
        & (F.contains(both, tpl_code) | (F.length(key_code(tpl_code)) >= 3))
    )
    by_name = (F.length(tpl_name) >= 3) & (F.contains(both, tpl_name) | F.contains(tpl_name, both))
    return by_code | by_name | key_match(tpl_code, code) | ((tpl_name != "") & text_match(tpl_name, name))
