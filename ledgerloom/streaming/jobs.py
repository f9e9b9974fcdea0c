"""Incremental append, upsert and keep-first over file sources.

Each micro-batch writes an output that a replay of the same batch overwrites, so a job
restarted from its checkpoint gives the same table.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ledgerloom.operators.append import key_names, keyed, new_rows
from ledgerloom.operators.series import last_wins
from ledgerloom.scale import materialized


def file_stream(spark: SparkSession, path: str, schema: StructType, glob: str = "*", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format("parquet").schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a parquet table with at least one file is there."""
    try:
        spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def append_stream(
    stream: DataFrame, target: str, checkpoint: str, keys: Sequence[str], order: str, within: str | None = None, known: DataFrame | None = None
) -> StreamingQuery:
    """Adds the rows whose key is new; every batch owns the partition `batch_id` of the target.

    The memory of keys is Spark's own state: one aggregate per key holds when it came first and last (the
    batch's clock, which a replay repeats) and its first row by arrival, then `order`. A batch reads the
    state of its own keys and nothing of the target; a key is new if all its rows came with this batch.
    Keys compare as text, nulls like empty text. A new checkpoint starts the numbering of batches, and so the
    target's partitions, anew. With many keys, set the session's state store to RocksDB.

    `within` names a key column by which the target is partitioned too, such as the day. `known` holds
    keys (a static table) that the target got from elsewhere.
    """
    columns = stream.columns
    arrived = keyed(stream.withColumn("_now", F.current_timestamp()).withColumn("_row", F.struct(*columns)), keys)
    per_key = arrived.groupBy(*key_names(keys)).agg(
        F.min("_now").alias("_first"), F.max("_now").alias("_last"), F.min_by("_row", F.struct("_now", order)).alias("_row")
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        added = batch.filter("_first = _last").select("_row.*")
        if known is not None:
            added = new_rows(added, known, keys, F.col(order))
        numbered = added.withColumn("batch_id", F.lit(batch_id).cast("long"))
        folders = [*([within] if within else []), "batch_id"]
        numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(target)

    return (
        per_key.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def upsert_partitions(batch: DataFrame, target: str, keys: Sequence[str], order: Sequence[str], partition: str) -> None:
    """Latest row per key, rewriting only the partitions the batch touches."""
    spark = batch.sparkSession
    merged = batch
    if exists(spark, target):
        touched = batch.select(partition).distinct()
        # Partition values are few, so the semi join prunes the scan of the target.
        merged = spark.read.parquet(target).join(touched, partition, "left_semi").select(*batch.columns).unionByName(batch)
    rest = [c for c in batch.columns if c not in keys]
    latest = last_wins(merged, keys, rest, F.struct(*order))
    # The target is an input too: write aside first, then replace its partitions.
    staged = materialized(latest)
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(target)


def upsert_stream(stream: DataFrame, target: str, checkpoint: str, keys: Sequence[str], order: Sequence[str], partition: str) -> StreamingQuery:
    """Series upsert; a late month is an ordinary update of its partition."""

    def write(batch: DataFrame, _batch_id: int) -> None:
        upsert_partitions(batch, target, keys, order, partition)

    return _available_now(stream, write, checkpoint)


def keep_first_stream(stream: DataFrame, target: str, checkpoint: str, keys: Sequence[str], event_time: str, delay: str) -> StreamingQuery:
    """First row per key with state bounded by the watermark."""
    unique = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))
    return (
        unique.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def keep_earliest_stream(stream: DataFrame, target: str, checkpoint: str, keys: Sequence[str], event_time: str, delay: str) -> StreamingQuery:
    """The row of each key that is first by event time, whatever order files come in within `delay`.

    Rows of a key less than `delay` apart are one session; its earliest row (ties by the other columns) is
    written when the watermark has passed the session, and the state is dropped.
    """
    columns = stream.columns
    rest = [c for c in columns if c != event_time]
    held = stream.withWatermark(event_time, delay).groupBy(F.session_window(event_time, delay), *[F.col(c).alias(f"_key_{c}") for c in keys]).agg(
        F.min(F.struct(event_time, *rest)).alias("_row")
    )
    return (
        held.select(*[F.col(f"_row.{c}").alias(c) for c in columns]).writeStream.format("parquet").option("path", target)
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )


def _available_now(stream: DataFrame, write, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def subfolder(root: str, name: str) -> str:
    return os.path.join(root, name)
