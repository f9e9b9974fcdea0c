"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Items are cut into windows of ten words (an item of fewer words is one window) and windows into
shingles of five words (fewer, if the window has fewer). A document holds a window only if it holds all
its shingles, so the rarest one is enough to find candidates: shingles are ordered by their occurrences
in the documents, each window joins on its rarest, the offset of the shingle gives the start (positional
bound), and the window is verified by the shingles that cover it from its first to its last word (length
bound). Shingles are joined as text, so verified windows are exact.

Defined cases: null texts have no words; an item without words has no window; an item with a null id
marks its words but is not listed; repeated items count once, repeated documents are returned each; a
null doc_id is an id like any other; empty tables on either side give no hits; only doc_id, text and
item_id, text are read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.scale import materialized

WINDOW = 10
SHINGLE = 5
# Distinct item shingles that may be sent to every executor (about 60 bytes each); beyond this the
# shingles of the documents are shuffled to those of the items.
BROADCAST_ROWS = 500_000
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    """Words after lower-casing A-Z; plain ASCII text takes the fast way."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), _BREAKS), "")


def _runs(words: Column, width: int | Column) -> Column:
    """(pos, key) of every run of `width` words."""
    starts = F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.array_join(F.slice(words, i + 1, F.lit(width) if isinstance(width, int) else width), " ").alias("key")))


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, win, len): distinct windows of the items; `win` is the window's text."""
    worded = items.select(F.col("item_id").cast("string"), item_words(F.col("text").cast("string")).alias("words"))
    full = worded.filter(F.size("words") > 0).withColumn("len", F.least(F.size("words"), F.lit(WINDOW)))
    return full.select("item_id", "len", F.inline(_runs(F.col("words"), F.col("len")))).select(
        "item_id", F.col("key").alias("win"), "len"
    ).distinct()


def window_shingles(windows: DataFrame) -> DataFrame:
    """(win, len, width, pos, key) for the distinct windows."""
    cut = windows.select("win", "len").distinct().withColumn("width", F.least(F.col("len"), F.lit(SHINGLE)))
    return cut.select("win", "len", "width", F.inline(_runs(F.split("win", " "), F.col("width"))))


def _occurrences(docs: DataFrame, keys: DataFrame, widths: list[int]) -> DataFrame:
    """(rk, pos, key): item shingles in documents, and for each row one entry of the empty key whose
    position is the number of words. rk = (doc_id, hash of the text)."""
    text = F.col("text").cast("string")
    worded = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h")).alias("rk"), item_words(text).alias("words"))
    found = F.concat(F.array(F.struct(F.size("words").alias("pos"), F.lit("").alias("key"))), *[_runs(F.col("words"), w) for w in widths])
    return worded.select("rk", F.inline(found)).join(keys, "key").select("rk", "pos", "key")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per row: doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = docs.sparkSession
    windows = materialized(item_windows(items))
    cut = materialized(window_shingles(windows))
    widths = sorted(r.width for r in cut.select("width").distinct().collect())  # at most five numbers
    keys = cut.select("key").union(spark.range(1).select(F.lit("").alias("key"))).distinct()
    small = cut.select("key").distinct().count() <= BROADCAST_ROWS
    found = materialized(_occurrences(docs, F.broadcast(keys) if small else keys, widths))

    seen = found.filter("key <> ''")
    rarity = seen.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    whole = (
        cut.join(rarity, "key").groupBy("win", "len", "width")
        .agg(F.count(F.lit(1)).alias("held"), F.min(F.struct("df", "pos", "key")).alias("rarest"),
             F.min_by("key", "pos").alias("first"), F.max_by("key", "pos").alias("last"))
        .filter(F.col("held") == F.col("len") - F.col("width") + 1)
        .select("win", "len", "width", "first", "last", F.col("rarest.key").alias("key"), F.col("rarest.pos").alias("offset"))
    )
    candidates = seen.join(whole, "key").select("rk", (F.col("pos") - F.col("offset")).alias("start"), "win", "len", "width", "first", "last")
    candidates = candidates.filter("start >= 0").distinct()

    def at(column: str, place: Column) -> Column:
        return (F.col("rk") == F.col("_rk")) & (place == F.col("_pos")) & (F.col(column) == F.col("_key"))

    there = seen.select(F.col("rk").alias("_rk"), F.col("pos").alias("_pos"), F.col("key").alias("_key"))
    verified = (
        candidates.join(there, at("first", F.col("start")), "left_semi")
        .join(there, at("last", F.col("start") + F.col("len") - F.col("width")), "left_semi")
        .select("rk", "start", "len", "win")
    )
    hits = materialized(verified)

    ordered = Window.partitionBy("rk").orderBy("start", "len")
    before = F.max(F.col("start") + F.col("len")).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("start") + F.col("len")
    spans = hits.select("rk", "start", "len").distinct()
    marked = spans.withColumn("_new", F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(before, F.lit(0)))))
    n_hit = marked.groupBy("rk").agg(F.sum("_new").alias("n_hit"))
    named = hits.select("rk", "win").distinct().join(windows.filter("item_id is not null").select("item_id", "win"), "win")
    listed = named.groupBy("rk").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return (
        found.filter("key = ''").select("rk", F.col("pos").cast("long").alias("n_words"))
        .join(n_hit, "rk", "left").join(listed, "rk", "left")
        .select(
            F.col("rk.doc_id").alias("doc_id"), F.col("rk.h").alias("text_hash"), "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(items_of).cast("long").alias("n_items"),
            F.sha2(F.concat_ws(",", items_of), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows without a benchmark window, with all their columns."""
    gone = contamination(docs, items).filter("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_hash"]), "left_anti")
