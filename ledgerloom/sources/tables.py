"""Indicator tables and sheet-shaped frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions.number import code_text, num_lenient
from ledgerloom.functions.text import strip


def value_column(columns: Sequence[str], wanted: str) -> str:
    """Column of the exact trimmed name, else the fourth."""
    return next((c for c in columns if c.strip() == wanted), columns[3])


def scan_indicator(sheet: DataFrame, value_col: str = fv.DEFAULT_VALUE_COLUMN, keep: Sequence[str] = ()) -> DataFrame:
    """(code, name, row_no, value, *keep) of rows with a code; other columns are pruned at the scan."""
    cols = [c for c in sheet.columns if c not in keep]
    quoted = [F.col(f"`{c}`") for c in cols]
    value = F.col(f"`{value_column(cols, value_col)}`")
    rows = sheet.filter(quoted[0].isNotNull()).select(
        code_text(quoted[0]).alias("code"), strip(quoted[1]).alias("name"), strip(quoted[2]).alias("row_no"),
        num_lenient(value).alias("value"), *keep,
    )
    return rows.filter(F.col("code") != "")


def read_indicator_csv(spark: SparkSession, paths: Sequence[str] | str, value_col: str = fv.DEFAULT_VALUE_COLUMN) -> DataFrame:
    """CSV files `period region.csv`, each read by its own header line.

    Result: code, name, row_no, the value under the name `value_col`, prev, source_file, file_seq,
    src_row. The value is the column whose trimmed header is `value_col`, per file, else the fourth.
    `file_seq` (the path) and `src_row` order rows as they stand, files by path: rank by
    `["file_seq", "src_row"]`. Files may differ in columns and width; empty files give nothing.
    """
    lines = _placed(spark.read.text(paths), F.col("value"))
    commas = F.length("first") - F.length(F.replace("first", F.lit(",")))
    width = max(_first_lines(lines).agg(F.max(commas)).first()[0] or 0, 4) + 1
    fields = [f"f{i}" for i in range(width)]
    raw = spark.read.schema(", ".join(f"{f} string" for f in fields)).option("header", False).csv(paths)
    rows = _placed(raw, F.array(*fields))
    heads = _first_lines(rows).withColumn("_at", F.col("src_row"))
    name = lambda x: strip(F.replace(x, F.lit("\ufeff"), F.lit("")))
    position = F.array_position(F.transform("first", name), value_col.strip())
    placed = rows.join(heads.select("file_seq", "_at", position.alias("_p")), "file_seq").filter(F.col("src_row") > F.col("_at"))
    cell = lambda i: F.get("line", i)
    value = cell(F.when(F.col("_p") > 0, F.col("_p").cast("int") - 1).otherwise(3))
    base = F.element_at(F.split("file_seq", "/"), -1)
    return placed.select(
        cell(F.lit(0)).alias("code"), cell(F.lit(1)).alias("name"), cell(F.lit(2)).alias("row_no"), value.alias(value_col.strip()),
        cell(F.lit(4)).alias("prev"), F.url_decode(F.replace(base, F.lit("+"), F.lit("%2B"))).alias("source_file"), "file_seq", "src_row",
    )


def _placed(rows: DataFrame, line: Column) -> DataFrame:
    """(line, file_seq, src_row): a row's file and its place there, by file block and by order in the block."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("no"))
    return rows.select(line.alias("line"), F.col("_metadata.file_path").alias("file_seq"), place.alias("src_row"))


def _first_lines(rows: DataFrame) -> DataFrame:
    return rows.filter("src_row.block = 0").groupBy("file_seq").agg(F.min_by("line", "src_row").alias("first"), F.min("src_row").alias("src_row"))


def indicator_rows(cells: DataFrame, value_col: str = fv.DEFAULT_VALUE_COLUMN) -> DataFrame:
    """The columns of `read_indicator_csv` from workbook cells (workbook, sheet_no, r, c, v): first sheet,
    header in its first row; `file_seq` is the workbook and `src_row` the row."""
    first = cells.filter("sheet_no = 0")
    wanted = first.filter((F.col("r") == 1) & (strip(F.col("v")) == value_col.strip()))
    column = wanted.groupBy("workbook").agg(F.min("c").alias("_vc"))
    at = lambda c: F.max(F.when(F.col("c") == c, F.col("v")))
    rows = first.filter("r > 1").join(column, "workbook", "left").groupBy("workbook", "r").agg(
        at(1).alias("code"), at(2).alias("name"), at(3).alias("row_no"), at(F.coalesce("_vc", F.lit(4))).alias(value_col.strip()), at(5).alias("prev")
    )
    return rows.select(
        "code", "name", "row_no", value_col.strip(), "prev", F.col("workbook").alias("source_file"),
        F.col("workbook").alias("file_seq"), F.col("r").alias("src_row"),
    )


def drop_blank_rows(cells: DataFrame) -> DataFrame:
    """Cells of rows that hold at least one non-empty cell. A sheet row is at most one sheet wide."""
    w = Window.partitionBy("workbook", "sheet", "r")
    filled = F.coalesce(F.col("v"), F.lit("")) != ""
    return cells.withColumn("_any", F.max(filled).over(w)).filter("_any").drop("_any")
