"""Comparisons with a money tolerance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CENT_TOLERANCE = 0.005


def approx(op: str, a: Column, b: Column, tol: float = CENT_TOLERANCE) -> Column:
    """a `op` b where differences up to `tol` count as equal."""
    d = a.cast("double") - b.cast("double")
    return {
        "<>": F.abs(d) > tol,
        "=": F.abs(d) <= tol,
        "<=": d <= tol,
        ">=": d >= -tol,
        "<": d < -tol,
        ">": d > tol,
    }[op]


def round2_differs(a: Column, b: Column) -> Column:
    return F.round(a.cast("decimal(38,6)"), 2) != F.round(b.cast("decimal(38,6)"), 2)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def values_equal(ltype: Column, ltext: Column, lnum: Column, rtype: Column, rtext: Column, rnum: Column) -> Column:
    """Same type and value; numbers may differ in the last bit (relative 1e-15)."""
    scale = F.greatest(F.abs(lnum), F.abs(rnum))
    close = finite(lnum) & finite(rnum) & (lnum != 0) & (rnum != 0) & (F.abs(lnum - rnum) <= F.lit(1e-15) * scale)
    as_number = (ltype == "number") & ((lnum == rnum) | close)
    as_text = (ltype != "number") & ltext.eqNullSafe(rtext)
    return (ltype == rtype) & (as_number | as_text)
