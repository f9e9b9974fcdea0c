"""Declared schemas of the data model."""

from pyspark.sql import types as T


def _st(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


_s, _i, _l, _d, _ts, _b = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType(), T.BooleanType(),
)

CELLS = _st(
    ("workbook", _s), ("sheet", _s), ("sheet_no", _i), ("r", _i), ("c", _i),
    ("vtype", _s), ("v", _s), ("v_num", _d), ("v_ts", _ts), ("formula", _s),
)
MERGES = _st(("workbook", _s), ("sheet", _s), ("r0", _i), ("c0", _i), ("r1", _i), ("c1", _i))
OBS = _st(
    ("region", _s), ("code", _s), ("period", _s), ("value", _d), ("name", _s),
    ("row_no", _s), ("source_file", _s), ("file_seq", _i), ("src_row", _l),
)
ISSUES = _st(
    ("period", _s), ("source", _s), ("code", _s), ("name", _s), ("detail", _s),
    ("v1", _d), ("v2", _d), ("v3", _d), ("d12", _d), ("d13", _d), ("biz", _s), ("file", _s),
)
ITEMS = _st(
    ("page_id", _l), ("item_no", _l), ("x0", _d), ("y0", _d), ("x1", _d), ("y1", _d),
    ("text", _s), ("score", _d),
)
CELL_BOXES = _st(
    ("page_id", _l), ("r", _i), ("c", _i), ("x", _d), ("y", _d), ("w", _d), ("h", _d),
)
