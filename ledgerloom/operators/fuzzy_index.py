"""Candidate pairs for the fuzzy tests: filter by keys that matching values must share, then verify.

Every generator gives a superset of the pairs its test accepts, by an equi join on the scope (such as a
template page) and a key. Keys hold most of a value, so that a prefix common to a whole chart of accounts
is no key, and containment looks up one part of the short value, the one that is rarest among the long ones.
Where many values begin alike, `bits_by_place` tells which places tell them apart, and the cuts go by these.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate, combinations
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.scale import shuffled

# Values up to this length are cut by patterns; longer ones into pieces of which one must agree.
PATTERN_LENGTH = 32
# Longest window of digits that is a key; a longer number is looked up by its first digits.
WINDOW = 16
# Longest values that are compared by edit distance before a pair leaves the lookup.
EDITED = 64
# Values of which one task holds the keys; each has up to 36 for its own length and some for the next ones.
VALUES = 1 << 13
# Sizes of the parts by which a contained text is looked up: the largest that it has.
GRAMS = (1, 2, 3, 6)
_BETWEEN = "\u0001"


def parts_for(spark: SparkSession, values: int) -> int | None:
    """Tasks over which the keys of so many values are dealt; None where the session's own number is enough."""
    parts = -(-values // VALUES)
    return parts if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def bits_by_place(values: DataFrame, value: str) -> dict[int, list[float]]:
    """For each length up to PATTERN_LENGTH, the bits that each place adds to the one before it: none where the
    places of a common beginning follow from one another. Counted over all values; a few hundred numbers."""
    n = F.length(value)
    places = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        i.alias("place"), F.when(i > 1, F.substr(F.col(value), i - 1, F.lit(1))).otherwise("").alias("before"), F.substr(F.col(value), i, F.lit(1)).alias("char")
    ))
    seen = values.filter(n.between(1, PATTERN_LENGTH)).select(n.alias("len"), F.inline(places))
    chars = seen.groupBy("len", "place", "before", "char").agg(F.count(F.lit(1)).alias("n"))
    weight = lambda c: F.sum(c * F.log2(c))
    befores = chars.groupBy("len", "place", "before").agg(F.sum("n").alias("n"), weight(F.col("n")).alias("w"))
    bits = befores.groupBy("len", "place").agg(((weight(F.col("n")) - F.sum("w")) / F.sum("n")).alias("bits"))
    out: dict[int, list[float]] = {}
    for row in sorted(bits.collect()):
        out.setdefault(row["len"], []).append(max(row["bits"], 0.0))
    # A length that no value has is cut like the next smaller one.
    for n in range(min(out, default=PATTERN_LENGTH) + 1, PATTERN_LENGTH + 1):
        out.setdefault(n, [*out[n - 1], 0.0])
    return out


def _edges(bits: Sequence[float], parts: int) -> list[int]:
    """Cuts into `parts` parts of about the same bits, one place each at least."""
    # A place without bits counts for a little, so that parts without any are cut by their length.
    until = list(accumulate((b + 0.01 for b in bits), initial=0.0))
    edges = [0]
    for i in range(1, parts):
        wanted = until[-1] * i / parts
        edges.append(min(range(edges[-1] + 1, len(bits) - parts + i + 1), key=lambda e: abs(until[e] - wanted)))
    return [*edges, len(bits)]


def kept_positions(length: int, differing: int, most: int, bits: Sequence[float] | None = None) -> list[list[tuple[int, int]]]:
    """Ways to keep parts of a value so that two values of `length` characters that differ in at most
    `differing` places agree in one of them: (start, size) of the parts, 1-based. The value is cut into as
    many parts as give at most `most` ways, of the same length or, with `bits`, of as many bits each, and each
    way leaves `differing` of them out."""
    if differing == 0:
        return [[(1, length)]]
    parts = max([m for m in range(differing + 1, length + 1) if comb(m, differing) <= most], default=min(length, differing + 1))
    edges = _edges(bits, parts) if bits else [length * i // parts for i in range(parts + 1)]
    ways = []
    for out in combinations(range(parts), differing):
        kept: list[tuple[int, int]] = []
        for i in range(parts):
            if i in out:
                continue
            at, size = edges[i] + 1, edges[i + 1] - edges[i]
            if kept and kept[-1][0] + kept[-1][1] == at:
                kept[-1] = (kept[-1][0], kept[-1][1] + size)
            else:
                kept.append((at, size))
        ways.append(kept)
    return ways


def _patterns(spark: SparkSession, differ_pct: int, most: int, bits: dict[int, list[float]] | None) -> DataFrame:
    """A few thousand lines: (len, way, parts, upto) for every length up to PATTERN_LENGTH."""
    rows = [
        (n, i, way, way[-1][0] + way[-1][1] - 1)
        for n in range(1, PATTERN_LENGTH + 1)
        for i, way in enumerate(kept_positions(n, n * differ_pct // 100, most, (bits or {}).get(n)))
    ]
    return spark.createDataFrame(rows, "len int, way int, parts array<struct<at:int,size:int>>, upto int")


def near_keys(
    values: DataFrame, value: str, differ_pct: int, longer: Column, most: int = 36, bits: dict[int, list[float]] | None = None, among: DataFrame | None = None
) -> DataFrame:
    """The rows with (len, way, piece): one for each way in which a value of up to `longer` characters may
    agree with this one while at most `differ_pct` percent of the longer one's places differ. Both sides must be
    cut by the same `bits`; `among` (len) leaves out lengths that the other side has no keys for."""
    size = F.length(value)
    lens = values.filter(size > 0).withColumn("len", F.explode(F.sequence(size, longer)))
    if among is not None:
        lens = lens.join(F.broadcast(among), "len", "left_semi")
    # By hint, as lines made here have no known size and the values would be sent to the driver in their place.
    short = lens.join(F.broadcast(_patterns(values.sparkSession, differ_pct, most, bits)), "len").filter(F.col("upto") <= size)
    pick = F.transform("parts", lambda p: F.substr(F.col(value), p["at"], p["size"]))
    short = short.withColumn("piece", F.array_join(pick, _BETWEEN)).drop("parts", "upto")
    parts = F.floor(F.col("len") * differ_pct / 100).cast("int") + 1
    cut = lambda i: F.floor(F.col("len").cast("long") * i / parts).cast("int")
    pieces = F.transform(
        F.sequence(F.lit(0), parts - 1),
        lambda i: F.struct(i.alias("way"), F.substr(F.col(value), cut(i) + 1, cut(i + 1) - cut(i)).alias("piece"), (cut(i + 1) <= size).alias("whole")),
    )
    long = lens.filter(F.col("len") > PATTERN_LENGTH).select("*", F.inline(F.filter(pieces, lambda p: p["whole"]))).drop("whole")
    return short.select(*long.columns).unionByName(long)


def near_pairs(
    left: DataFrame, right: DataFrame, scope: Sequence[str], a: str, b: str, differ_pct: int, length_pct: int | None, most: int = 36, parts: int | None = None,
    bits: dict[int, list[float]] | None = None,
) -> DataFrame:
    """Pairs of rows whose values `a` (left) and `b` (right) may agree in all but `differ_pct` percent of their
    places. Lengths differ by at most one, or by `length_pct` percent of the longer. Values and keys are dealt over
    `parts` tasks where it is given (see `parts_for`), so that no task's keys grow with the input. Each key takes
    all columns along, so that few are best. `bits`: see `bits_by_place`."""

    def longer(value: str) -> Column:
        n = F.length(value)
        return n + 1 if length_pct is None else F.floor(n * 100 / (100 - length_pct)).cast("int")

    def lengths(df: DataFrame, value: str, upto: Column) -> DataFrame:
        n = F.length(value)
        return df.filter(n > 0).select(n.alias("n"), upto.alias("upto")).distinct().select(F.explode(F.sequence("n", "upto")).alias("len")).distinct()

    of_a, of_b = lengths(left, a, F.length(a)), lengths(right, b, F.length(b))
    near_a, near_b = lengths(left, a, longer(a)), lengths(right, b, longer(b))
    if parts:
        left, right = left.repartition(parts, a), right.repartition(parts, b)
    # The number first: joins sort by their keys in order, and the scope is the same in many rows.
    keys = ["_key", *scope]

    def keyed(df: DataFrame) -> DataFrame:
        # A number sorts faster than three columns and takes less room; keys that share one are told apart by the test.
        one = df.withColumn("_key", F.xxhash64("len", "way", "piece")).drop("len", "way", "piece")
        return one.repartition(parts, *keys) if parts else one

    # One of the two has the length that the key stands for; two shorter ones never meet under it.
    own_a = keyed(near_keys(left, a, differ_pct, F.length(a), most, bits, near_b))
    all_b = keyed(near_keys(right, b, differ_pct, longer(b), most, bits, of_a))
    less_a = keyed(near_keys(left, a, differ_pct, longer(a), most, bits, of_b).filter(F.length(a) < F.col("len")))
    own_b = keyed(near_keys(right, b, differ_pct, F.length(b), most, bits, near_a))
    # Places that differ are as many edits at least; this is much cheaper than the test, and leaves few pairs to shuffle.
    longest = F.greatest(F.length(a), F.length(b))
    edits = F.floor(longest * differ_pct / 100).cast("int")
    near = (longest > EDITED) | (F.call_function("levenshtein", F.col(a), F.col(b), edits) >= 0)
    met = own_a.join(shuffled(all_b), keys).unionByName(less_a.join(shuffled(own_b), keys))
    return met.filter(near).drop("_key")


def digit_pairs(shorts: DataFrame, longs: DataFrame, scope: Sequence[str], short: str, long: str) -> DataFrame:
    """Pairs whose digits `short` (three at least) lie inside the digits `long`, of which they are 40 % at least."""
    n = F.length(long)
    sizes = F.filter(F.sequence(F.lit(3), F.lit(WINDOW)), lambda w: (w <= n) & ((w * 10 >= n * 4) | (w == WINDOW)))
    windows = F.flatten(F.transform(sizes, lambda w: F.transform(F.sequence(F.lit(1), n - w + 1), lambda i: F.substr(F.col(long), i, w))))
    parts = longs.filter(n >= 3).withColumn("piece", F.explode(F.array_distinct(windows)))
    asked = shorts.filter(F.length(short) >= 3).withColumn("piece", F.left(short, F.lit(WINDOW)))
    held = asked.join(shuffled(parts), ["piece", *scope]).drop("piece")
    return held.filter(F.contains(long, F.col(short)) & ((n - F.length(short)) <= n * F.lit(0.6)))


def _grams(value: str, sizes: Column) -> Column:
    n = F.length(value)
    each = F.transform(sizes, lambda w: F.transform(F.sequence(F.lit(1), n - w + 1), lambda i: F.substr(F.col(value), i, w)))
    return F.array_distinct(F.flatten(each))


def _gram_size(n: Column) -> Column:
    return F.greatest(*[F.when(n >= w, w) for w in GRAMS])


def contained_pairs(shorts: DataFrame, longs: DataFrame, scope: Sequence[str], short: str, long: str) -> DataFrame:
    """Pairs whose text `short` lies inside the text `long`. A short text is looked up by its rarest part of the
    largest size in GRAMS that it has, counted among the long texts of its scope before any pair is made."""
    n = F.length(long)
    asked = shorts.filter(F.length(short) > 0)
    size = _gram_size(F.length(short))
    # One row, of the four sizes at most.
    sizes = asked.agg(F.collect_set(size).alias("_sizes"))
    held = longs.filter(n > 0).crossJoin(F.broadcast(sizes)).withColumn("gram", F.explode(_grams(long, F.filter("_sizes", lambda w: w <= n)))).drop("_sizes")
    keys = [*scope, short]
    grams = asked.select(*keys).distinct().withColumn("gram", F.explode(_grams(short, F.array(size))))
    counts = held.groupBy(*scope, "gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = grams.join(shuffled(counts), ["gram", *scope], "left").groupBy(*keys).agg(
        F.min_by("gram", F.struct(F.coalesce("_n", F.lit(0)), "gram")).alias("gram"), F.min(F.coalesce("_n", F.lit(0))).alias("_least")
    ).filter("_least > 0").drop("_least")
    return asked.join(shuffled(rarest), list(reversed(keys))).join(shuffled(held), ["gram", *scope]).filter(F.contains(F.col(long), F.col(short))).drop("gram")
