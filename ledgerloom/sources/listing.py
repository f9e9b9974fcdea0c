"""File listings: extension filter, de-duplication, newest file, digests and per-row isolation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv

# Picture files taken into a batch.
IMAGE_EXTENSIONS = [".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp", ".heic", ".heif"]


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, modificationTime, length) without reading the contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return files.select("path", "modificationTime", "length")


def split_listing(files: DataFrame, extensions: Sequence[str] = tuple(IMAGE_EXTENSIONS)) -> DataFrame:
    """Distinct paths with the reason a path is skipped (null = taken)."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./\\]*)$", 1))
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    reason = F.when(~ext.isin(list(extensions)), F.concat(F.lit("跳过非图片文件："), name))
    return files.select("path").dropDuplicates(["path"]).withColumn("reason", reason)


def latest_file(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Newest recognised export, by modification time; equal times by path."""
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    ours = files.filter(F.startswith(name, F.lit(fv.EXPORT_STEM_PREFIX)) & F.endswith(name, F.lit(".xlsx")))
    return ours.groupBy(*keys).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def file_digests(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def safe_map(df: DataFrame, key: str, column: str, fn: Callable[[object], object]) -> DataFrame:
    """(key, status, error, payload): `fn` per value; one failing row does not fail the batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, value in zip(batch[key], batch[column]):
                try:
                    rows.append((k, "ok", None, str(fn(value))))
                except Exception as error:  # noqa: BLE001 - reported per row
                    rows.append((k, "failed", f"{type(error).__name__}: {error}", None))
            yield pd.DataFrame(rows, columns=[key, "status", "error", "payload"])

    dtype = dict(df.dtypes)[key]
    return df.select(key, column).mapInPandas(run, f"{key} {dtype}, status string, error string, payload string")
