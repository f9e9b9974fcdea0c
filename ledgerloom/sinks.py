"""Writers: ordered text files, run folders and the period-partitioned series."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import export

BOM = "\ufeff"


def write_ordered_lines(lines: DataFrame, path: str, order: Sequence[str], column: str = "line", bom: bool = False) -> None:
    """Text files whose names sort like their lines: a range shuffle, no single writer."""
    text = F.col(column)
    if bom:
        first = lines.select(F.min(F.struct(*order))).scalar()
        text = F.when(F.struct(*order) == first, F.concat(F.lit(BOM), text)).otherwise(text)
    ordered = lines.withColumn("_text", text).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select(F.col("_text").alias("value")).write.text(path)


def write_csv(grid: DataFrame, page_id: int, path: str) -> None:
    """One page as CSV with a byte-order mark."""
    write_ordered_lines(export.csv_lines(grid.filter(F.col("page_id") == page_id)), path, ["page_id", "r"], bom=True)


def write_text(grid: DataFrame, pages: DataFrame, path: str) -> None:
    write_ordered_lines(export.text_lines(grid, pages), path, ["page_id", "pos"])


def write_markdown(grid: DataFrame, pages: DataFrame, path: str) -> None:
    write_ordered_lines(export.markdown_lines(grid, pages), path, ["page_id", "pos"])


def write_json(grid: DataFrame, pages: DataFrame, merges: DataFrame, path: str) -> None:
    """The parts of every page's JSON document, in order."""
    write_ordered_lines(export.json_parts(grid, pages, merges), path, ["page_id", "section", "r", "c"], "part")


def write_corrected(corrected: DataFrame, root: str) -> str:
    """A corrected copy in a new run folder; an existing one is never replaced."""
    path = os.path.join(root, f"run_id={uuid.uuid4().hex}")
    corrected.write.mode("errorifexists").partitionBy("period").parquet(path)
    return path


def publish(cells: DataFrame, path: str, allowed_suffix: str = "") -> None:
    """Writes redacted cells; stops when a machine-local path is left in them."""
    found = export.local_paths(cells, allowed_suffix).limit(1).collect()
    if found:
        raise ValueError(f"local path left in {found[0].asDict()}")
    cells.write.mode("errorifexists").parquet(path)
