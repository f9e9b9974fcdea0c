"""Near-duplicate classes by circulant MinHash.

One permutation scatters the shingles over the bins; a second one, shifted round by k, orders the bins
for coordinate k. So all coordinates of a shingle are one stretch of a single table. Rows of a few
coordinates make the bands; documents that share a band are candidates, and every link is confirmed
on the full shingle sets. A Limit says from which Jaccard percentage on texts are linked, and its bands.

Candidates stay linear in the number of documents. Texts with equal sets are one class. A small bucket
gives its pairs (at most SMALL per member). A large one links its members to one central leader only;
links among members that the leader does not account for are found exactly from their differences to
the leader: for r not linked to the leader and any a, |r ^ a| = p + q - 2 * overlap of the differences
(p, q long), so r and a must share many elements of their differences. Elements that one member alone
has cannot be shared; what remains decides who can have a partner at all, and a prefix join finds it.

Defined cases: null and empty texts, or texts without a word, have no set and stand alone; texts of
fewer than five words have their whole sequence as the one shingle; repeated rows are documents with
equal sets and are all returned; rows with a null id take part, and the smallest non-null id names the
component (null if there is none); an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import WordHashes, as_bytes, connected, map_slices, mixed, without
from ledgerloom.scale import materialized

SHINGLE = 5
COORDINATES = 256
BINS = 1 << 22
SMALL = 16

_ODD = np.random.default_rng(20_2).integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_ODD = np.random.default_rng(20_3).integers(0, 2**63, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Limit:
    """Texts are linked from `pct` on. Sets of sizes n, m with symmetric difference d are linked if
    apart * d <= whole * (n + m), in lowest terms."""

    pct: int
    bands: int
    rows: int

    @property
    def apart(self) -> int:
        return (100 + self.pct) // math.gcd(100 + self.pct, 100 - self.pct)

    @property
    def whole(self) -> int:
        return (100 - self.pct) // math.gcd(100 + self.pct, 100 - self.pct)

    @property
    def least_agreement(self) -> float:
        """Pairs whose estimate from all coordinates lies below are not verified: it is over five
        deviations of the estimate below the limit."""
        part = self.pct / 100
        return math.floor(100 * (part - 5.35 * math.sqrt(part * (1 - part) / COORDINATES))) / 100


# A pair right at either limit shares no band with a probability of 2e-8.
AT_85 = Limit(85, 30, 5)
AT_80 = Limit(80, 34, 4)


@cache
def _circulant() -> np.ndarray:
    """Row i = the second permutation read from i onwards, COORDINATES values, round the end."""
    order = np.random.default_rng(20_1).permutation(BINS).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[: COORDINATES - 1]]), COORDINATES)


def shingles(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    codes = hashes.of(words)
    if len(codes) < SHINGLE:
        total = (codes * _ODD[: len(codes)]).sum(keepdims=True) + np.uint64(len(codes))
    else:
        total = sum(codes[j : len(codes) - SHINGLE + 1 + j] * _ODD[j] for j in range(SHINGLE))
    return np.unique(mixed(total))


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """The smallest shifted order of any bin, for each coordinate."""
    table, low = _circulant(), np.full(COORDINATES, BINS, np.int32)
    bins = (mixed(shingle_set + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)
    for at in range(0, len(bins), 2048):
        np.minimum(low, table[bins[at : at + 2048]].min(axis=0), out=low)
    return low


def band_keys(sig: np.ndarray, limit: Limit = AT_85) -> np.ndarray:
    rows = sig[: limit.bands * limit.rows].astype(np.uint64).reshape(limit.bands, limit.rows)
    return mixed((rows * _BAND_ODD[: limit.rows]).sum(axis=1) + np.arange(limit.bands, dtype=np.uint64)).view(np.int64)


def class_of(shingle_set: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingle_set.tobytes(), digest_size=16).digest() if len(shingle_set) else None


def _described(hashes: WordHashes, limit: Limit):
    def one(batch: pa.RecordBatch) -> dict:
        n, cls, bands, low = [], [], [], []
        for text in as_bytes(batch):
            s = shingles(text, hashes)
            n.append(len(s))
            cls.append(class_of(s))
            sig = signature(s) if len(s) else None
            bands.append(band_keys(sig, limit).tolist() if len(s) else None)
            low.append((sig & 0xFF).astype(np.uint8).tobytes() if len(s) else None)
        return {
            "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "n_shingles": pa.array(n, pa.int64()),
            "cls": pa.array(cls, pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64())),
            "low": pa.array(low, pa.binary()),
        }

    return one


def _sets(hashes: WordHashes):
    def one(batch: pa.RecordBatch) -> dict:
        found = [shingles(t, hashes) for t in as_bytes(batch)]
        return {
            "cls": pa.array([class_of(s) for s in found], pa.binary()),
            "items": pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64())),
        }

    return one


def _agreeing(least: float):
    def one(batch: pa.RecordBatch) -> dict:
        left, right = (np.frombuffer(b"".join(as_bytes(batch, c)), np.uint8).reshape(-1, COORDINATES) for c in ("low_a", "low_b"))
        keep = pa.array((left == right).mean(axis=1) >= least)
        return {"a": batch.column("a").filter(keep), "b": batch.column("b").filter(keep)}

    return one


def _is_link(inter: Column, size_a: Column, size_b: Column, limit: Limit) -> Column:
    return 100 * inter >= limit.pct * (size_a + size_b - inter)


def _small_pairs(shared: DataFrame, classes: DataFrame, limit: Limit) -> DataFrame:
    """Distinct pairs (a < b) of small buckets whose signatures agree enough."""
    groups = shared.filter(F.col("m") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list("cls")).alias("g"))
    firsts = groups.select("g", F.posexplode("g").alias("i", "a"))
    pairs = firsts.select("a", F.explode(F.slice("g", F.col("i") + 2, SMALL)).alias("b")).distinct()
    a, b = (classes.select(F.col("cls").alias(x), F.col("low").alias(f"low_{x}")) for x in "ab")
    return map_slices(pairs.join(a, "a").join(b, "b").select("a", "b", "low_a", "low_b"), _agreeing(limit.least_agreement), "a binary, b binary", "low_a")


def _stars(shared: DataFrame) -> DataFrame:
    """(leader, cls) of large buckets. The leader is the member that meets the most others over all its
    large buckets: the text that the others are variants of, and the same one in most buckets."""
    members = shared.filter(F.col("m") > SMALL)
    central = members.groupBy("cls").agg(F.sum("m").alias("mates"))
    members = members.select("key", "cls").join(central, "cls")
    leaders = members.groupBy("key").agg(F.min_by("cls", F.struct(-F.col("mates"), "cls")).alias("leader"))
    return members.select("key", "cls").join(leaders, "key").filter("cls <> leader").select("leader", "cls").distinct()


def _links_beside(star: DataFrame, limit: Limit) -> DataFrame:
    """Links between members of a star of which at least one is not linked to the leader.

    All in whole numbers: with the limit's A = apart and W = whole, sets of sizes n, m with symmetric
    difference d are linked if A d <= W (n + m). A member r that is not linked to the leader has
    A p >= W (|r| + |leader|) + 1. A partner a of r overlaps it in o = (p + q - d) / 2 elements, so
    - r needs o >= p - d, and d is at most W (|r| + 100 |r| / pct) / A;
    - a needs 2 A o >= 1 + A q + W (|leader| - |a|).
    Only elements that some other member also has count towards o. Pairs must meet in the first
    (elements - o + 1) of either side, taken from the rarest; they are verified on the whole differences.
    """
    sizes = star.groupBy("leader").agg(F.count_if(~F.col("linked")).alias("open"), F.count(F.lit(1)).alias("members"))
    star = star.join(materialized(sizes.filter("open > 0 and members > 1").select("leader")), "leader", "left_semi")
    elements = star.select("leader", "cls", F.explode("delta").alias("e"))
    common = elements.groupBy("leader", "e").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    held = elements.join(common, ["leader", "e"])
    counts = held.groupBy("leader", "cls").agg(F.count(F.lit(1)).alias("nn"))
    apart, whole = limit.apart, limit.whole
    most_apart = F.floor(whole * (F.col("n") + F.floor(F.col("n") * 100 / limit.pct)) / apart)
    as_probe = F.greatest(F.lit(1), F.col("p") - most_apart)
    as_partner = F.greatest(F.lit(1), F.ceil((1 + apart * F.col("p") + whole * (F.col("n_leader") - F.col("n"))) / (2 * apart)))
    able = materialized(
        star.select("leader", "cls", "n", "n_leader", "linked", "p").join(counts, ["leader", "cls"])
        .withColumn("probe_take", F.when(~F.col("linked"), F.col("nn") - as_probe + 1))
        .withColumn("partner_take", F.col("nn") - F.when(F.col("linked"), as_partner).otherwise(F.greatest(as_partner, as_probe)) + 1)
        .filter("probe_take > 0 or partner_take > 0").select("leader", "cls", "linked", "probe_take", "partner_take")
    )
    rarest_first = Window.partitionBy("leader", "cls").orderBy("k", "e")
    ranked = held.join(able, ["leader", "cls"]).withColumn("rank", F.row_number().over(rarest_first))
    ranked = materialized(ranked.filter("rank <= greatest(probe_take, partner_take)"))
    probes = ranked.filter("rank <= probe_take").select("leader", "e", F.col("cls").alias("a"), (F.col("partner_take") > 0).alias("pa"))
    partners = ranked.filter("rank <= partner_take").select("leader", "e", F.col("cls").alias("b"), F.col("linked").alias("lb"))
    met = probes.join(partners, ["leader", "e"]).filter("a <> b and (lb or pa)").select("leader", "a", "b").distinct()

    def side(x: str) -> DataFrame:
        return star.select("leader", F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("delta").alias(f"d_{x}"))

    verified = met.join(side("a"), ["leader", "a"]).join(side("b"), ["leader", "b"])
    between = F.size("d_a") + F.size("d_b") - 2 * F.size(F.array_intersect("d_a", "d_b"))
    return verified.filter(apart * between <= whole * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def near_links(docs: DataFrame, described: DataFrame, limit: Limit = AT_85) -> DataFrame:
    """Confirmed links (a, b) between classes, `described` by the same limit; with the links inside classes they have all components."""
    known = described.filter("cls is not null")
    classes = materialized(
        known.groupBy("cls").agg(
            F.min_by(F.struct("bands", "low"), F.struct("doc_id", "text_hash")).alias("x"),
            F.min(F.struct("doc_id", "text_hash")).alias("rep"),
        ).select("cls", "x.*", "rep")
    )
    keys = classes.select("cls", F.explode("bands").alias("key"))
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    shared = materialized(keys.join(sizes, "key"))
    pairs, stars = materialized(_small_pairs(shared, classes, limit)), materialized(_stars(shared))
    needed = (
        pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).union(stars.select("leader")).union(stars.select("cls")).distinct()
    )
    reps = classes.select("cls", "rep").join(needed, "cls").select(F.col("rep.doc_id").alias("_id"), F.col("rep.text_hash").alias("_hash"))
    texts = docs.join(reps, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left_semi").select("text")
    sets = materialized(map_slices(texts, _sets(WordHashes()), "cls binary, items array<long>"))

    def side(name: str) -> DataFrame:
        return sets.select(F.col("cls").alias(name), F.col("items").alias(f"s_{name}"))

    inter = F.size(F.array_intersect("s_a", "s_b"))
    linked = pairs.join(side("a"), "a").join(side("b"), "b").filter(_is_link(inter, F.size("s_a"), F.size("s_b"), limit)).select("a", "b")
    met = stars.join(side("leader"), "leader").join(side("cls"), "cls").select(
        "leader", "cls", F.size("s_leader").alias("n_leader"), F.size("s_cls").alias("n"),
        F.array_except("s_cls", "s_leader").alias("added"), F.array_except("s_leader", "s_cls").alias("removed"),
    )
    removed = F.transform("removed", lambda x: F.bitwise_not(x))
    star = materialized(
        met.withColumn("linked", _is_link(F.col("n") - F.size("added"), F.col("n"), F.col("n_leader"), limit))
        .select("leader", "cls", "n_leader", "n", "linked", F.concat("added", removed).alias("delta"))
        .withColumn("p", F.size("delta"))
        .dropDuplicates(["leader", "cls"])
    )
    return linked.union(star.filter("linked").select("leader", "cls")).union(_links_beside(star, limit))


def _labelled(docs: DataFrame, limit: Limit) -> tuple[DataFrame, DataFrame]:
    """(cls, label, least) of every class of equal sets, where label is the same within a component; and the described rows."""
    described = materialized(
        map_slices(
            docs, _described(WordHashes(), limit),
            "doc_id long, text_hash long, n_shingles long, cls binary, bands array<long>, low binary",
        )
    )
    labels = connected(near_links(docs, described, limit), "a", "b")
    per_class = described.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least")).join(
        labels.withColumnRenamed("node", "cls"), "cls", "left"
    ).withColumn("label", F.coalesce("label", "cls"))
    return materialized(per_class.select("cls", "label", "least")), described


def _components(docs: DataFrame, limit: Limit) -> DataFrame:
    per_class, described = _labelled(docs, limit)
    least = per_class.groupBy("label").agg(F.min("least").alias("component_id"))
    named = per_class.join(least, "label").select("cls", "component_id")
    return (
        described.select("doc_id", "text_hash", "n_shingles", "cls")
        .join(named, "cls", "left")
        .withColumn("component_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
        .select("doc_id", "text_hash", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )


def _picked(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text, F.xxhash64(text).alias("text_hash"))


def near_duplicates(docs: DataFrame, limit: Limit = AT_85) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    return _components(_picked(docs), limit).drop("text_hash")


def keep_one_of_each(docs: DataFrame, limit: Limit = AT_85) -> DataFrame:
    """One row of each component, with all its columns: of the smallest id (a null id last), then of the
    smallest text hash. So near copies without an id, or that share an id, leave one row like others do.
    Rows without words are no near copies of anything; they stay, one of each id and text."""
    labels, described = _labelled(_picked(docs), limit)
    mine = F.struct(F.col("doc_id").isNull().alias("_no"), "doc_id", "text_hash")
    worded = described.filter("cls is not null").join(labels, "cls").withColumn("_mine", mine)
    best = worded.groupBy("label").agg(F.min("_mine").alias("_best"))
    gone = worded.join(best, "label").filter(F.col("_mine") != F.col("_best")).select("doc_id", "text_hash")
    left = without(docs, materialized(gone))
    again = described.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("doc_id", "text_hash")
    again = materialized(again)
    if again.isEmpty():
        return left
    repeats = again.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    same = docs["doc_id"].eqNullSafe(repeats["_id"]) & (F.xxhash64(docs["text"].cast("string")) == repeats["_hash"])
    once = without(docs, materialized(gone.unionByName(again)))
    twice = left.join(repeats, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(twice)
