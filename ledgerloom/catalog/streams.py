"""Streaming queries: events staged as time-ordered files, then run with availableNow."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog.registry import query
from ledgerloom.fixtures import Tables
from ledgerloom.session import shared_folder
from ledgerloom.streaming import jobs


def _staged(t: Tables, frame: DataFrame, root: str) -> str:
    path = jobs.subfolder(root, "source")
    frame.repartitionByRange(4, "ts").write.parquet(path)
    return path


def _events(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.col("value").cast("decimal(18,2)").alias("value"))


def _halves(events: DataFrame) -> tuple[DataFrame, DataFrame, datetime]:
    """The events before and from the middle of the time they span."""
    span = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    middle = span["lo"] + (span["hi"] - span["lo"]) // 2
    return events.filter(F.col("ts") < F.lit(middle)), events.filter(F.col("ts") >= F.lit(middle)), middle


@query(
    "stream_append",
    """with m as (select make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2) as middle from events),
e as (select *, cast(ts as date) as day, row_number() over (partition by user_id, event_type, cast(ts as date) order by ts < middle, event_id) as k from events, m)
select event_id, ts, user_id, event_type, cast(value as decimal(18,2)) as value, day, ts < middle as second_run from e where k = 1""",
)
def stream_append(t: Tables) -> DataFrame:
    """Two runs, the newer half of the events first; a day that both halves hold keeps the first run's rows."""
    root = shared_folder(t.spark)
    events = _events(t).withColumn("day", F.to_date("ts"))
    old, new, middle = _halves(events)
    source, target = jobs.subfolder(root, "source"), jobs.subfolder(root, "target")
    for part in (new, old):
        part.write.mode("append").parquet(source)
        stream = jobs.file_stream(t.spark, source, events.schema)
        jobs.append_stream(stream, target, jobs.subfolder(root, "progress"), ["user_id", "event_type", "day"], "event_id", "day").awaitTermination()
    stored = t.spark.read.parquet(target)
    return stored.select("event_id", "ts", "user_id", "event_type", "value", "day", (F.col("ts") < F.lit(middle)).alias("second_run"))


@query(
    "stream_upsert",
    """select event_type as region, user_id as code, strftime(ts, '%Y.%m') as period, arg_max(cast(value as decimal(18,2)), event_id) as value, max(event_id) as event_id from events group by 1, 2, 3""",
)
def stream_upsert(t: Tables) -> DataFrame:
    root = shared_folder(t.spark)
    cells = _events(t).select(
        F.col("event_type").alias("region"), F.col("user_id").alias("code"), F.date_format("ts", "yyyy.MM").alias("period"), "value", "event_id", "ts"
    )
    source = _staged(t, cells, root)
    target = jobs.subfolder(root, "target")
    stream = jobs.file_stream(t.spark, source, cells.schema, files_per_batch=2).drop("ts")
    jobs.upsert_stream(stream, target, jobs.subfolder(root, "progress"), ["region", "code", "period"], ["event_id"], "period").awaitTermination()
    typed = t.spark.read.schema("region string, code bigint, value decimal(18,2), event_id bigint, period string").parquet(target)
    return typed.select("region", "code", "period", "value", "event_id")


@query("stream_keep_first", "select event_id, user_id, event_type from events")
def stream_keep_first(t: Tables) -> DataFrame:
    """Three runs over growing input: the older events, the newer ones, then altered copies of all
    events with new events far behind the watermark. First copies stay, late events are dropped."""
    root = shared_folder(t.spark)
    events = _events(t).select("event_id", "ts", "user_id", "event_type")
    old, new, middle = _halves(events)
    middle = F.lit(middle)
    copies = events.withColumn("event_type", F.lit("copy"))
    late = old.filter(F.col("ts") < middle - F.expr("interval 2 days")).withColumn("event_id", -1 - F.col("event_id"))
    source, target = jobs.subfolder(root, "source"), jobs.subfolder(root, "target")
    for part in (old, new, copies.unionByName(late)):
        part.write.mode("append").parquet(source)
        stream = jobs.file_stream(t.spark, source, events.schema)
        jobs.keep_first_stream(stream, target, jobs.subfolder(root, "progress"), ["event_id"], "ts", "1 day").awaitTermination()
    return t.spark.read.parquet(target).select("event_id", "user_id", "event_type")


@query(
    "stream_keep_earliest",
    """with g as (select *, ts - lag(ts) over (partition by user_id, event_type order by ts, event_id) as gap from events),
s as (select *, count(*) filter (where gap is null or gap >= interval 2 hours) over (partition by user_id, event_type order by ts, event_id) as n from g),
k as (select *, row_number() over (partition by user_id, event_type, n order by ts, event_id) as i from s)
select event_id, ts, user_id, event_type from k where i = 1""",
)
def stream_keep_earliest(t: Tables) -> DataFrame:
    """Files out of order: events of the hour before the middle come with the second run, beside newer ones; an
    event far ahead lets the watermark pass the last sessions."""
    root = shared_folder(t.spark)
    events = _events(t).select("event_id", "ts", "user_id", "event_type")
    old, new, middle = _halves(events)
    held = F.lit(middle - timedelta(hours=1))
    ahead = t.spark.createDataFrame([(-1, middle + timedelta(days=10_000), -1, "ahead")], events.schema)
    source, target = jobs.subfolder(root, "source"), jobs.subfolder(root, "target")
    for part in (old.filter(F.col("ts") < held), new.unionByName(old.filter(F.col("ts") >= held)), ahead):
        part.write.mode("append").parquet(source)
        stream = jobs.file_stream(t.spark, source, events.schema)
        progress = jobs.subfolder(root, "progress")
        jobs.keep_earliest_stream(stream, target, progress, ["user_id", "event_type"], "ts", "2 hours").awaitTermination()
    return t.spark.read.parquet(target).filter("event_id >= 0").select("event_id", "ts", "user_id", "event_type")
