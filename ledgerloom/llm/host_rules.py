"""Quality rules with host verdicts.

A document is measured by itself; rule failures are counted by host (`source`), each host's failure
rate is shrunk towards the rate of all documents with a beta prior fitted to the hosts, and the verdict
on the host is joined back to its documents. A host fails if one rule, or any of the rules together, fails
on more than `host_limit` of its documents by the shrunk rate.

Defined cases: a null text has no words and fails the length rule; a null host is no host, its
documents stand for themselves; repeated rows are measured and returned each; texts of any length
are measured whole; a rate equal to the limit is not above it; an empty table gives
an empty result; columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import as_bytes, map_slices, text_hash, without
from ledgerloom.scale import materialized

SPACES = b"\t\n\x0b\x0c\r "
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MEASURES = "doc_id long, source string, text_hash long, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


@dataclass(frozen=True)
class HostRules:
    """min_words and max_repeat_pct are the base rules; the others only count towards the host."""

    min_words: int = 20
    max_repeat_pct: int = 30
    max_symbol_pct: int = 10
    max_dup_lines_pct: int = 10
    max_word_chars: int = 15
    host_limit: float = 0.5
    max_strength: float = 1e6

    def failures(self) -> dict[str, Column]:
        words, chars = F.col("n_words"), F.col("word_chars")
        return {
            "short": words < self.min_words,
            "repeats": 100 * F.col("n_repeat_words") > self.max_repeat_pct * words,
            "symbols": 100 * F.col("n_symbols") > self.max_symbol_pct * chars,
            "dup_lines": 100 * F.col("n_dup_lines") > self.max_dup_lines_pct * F.col("n_lines"),
            "long_words": chars > self.max_word_chars * words,
        }


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in an 8-word window found at least twice. Windows get exact numbers by
    doubling: a pair of numbers of half windows is numbered anew."""
    if len(words) <= WINDOW:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    codes = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    step = 1
    while step < WINDOW:
        pairs = codes[:-step] * (int(codes.max()) + 1) + codes[step:]
        codes = np.unique(pairs, return_inverse=True)[1]
        step *= 2
    counts = np.bincount(codes)
    if counts.max() < 2:
        return 0
    starts = np.flatnonzero(counts[codes] > 1)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + WINDOW, -1)
    return int((np.cumsum(depth) > 0).sum())


def measured_text(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    spaces = len(text) - len(text.translate(None, SPACES))
    return (
        len(words),
        len(text.decode("utf-8", "replace")) - spaces,
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def _measure(batch: pa.RecordBatch) -> dict:
    rows = [measured_text(t) for t in as_bytes(batch)]
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    columns = dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}
    return {"doc_id": batch.column("doc_id"), "source": batch.column("source"), "text_hash": batch.column("text_hash")} | {
        n: pa.array(columns[n], pa.int64()) for n in names
    }


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_hash and the five counts of each row's whole text."""
    picked = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"), text_hash().alias("text_hash"))
    return map_slices(picked, _measure, MEASURES)


def host_rates(measured: DataFrame, rules: HostRules) -> DataFrame:
    """One row per host: n, and the shrunk failure rate of each rule and of any rule.

    The prior of a rule is Beta(m z, (1 - m) z): m is the share of all documents that fail, and z follows from
    how far the hosts' rates spread beyond what drawing their documents explains (moments of the
    beta-binomial). z is large when hosts do not differ. Some forty numbers reach the driver.
    """
    fails = rules.failures()
    fails["any"] = reduce(or_, fails.values())
    hosts = measured.filter("source is not null").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(f"f_{r}") for r, c in fails.items()]
    )
    n = F.col("n").cast("double")
    sums = hosts.agg(
        F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("n1"), F.sum(n * n).alias("n2"),
        *[F.sum(f"f_{r}").alias(f"k_{r}") for r in fails], *[F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / n).alias(f"q_{r}") for r in fails],
    ).first()
    shrunk = []
    for r in fails:
        mean, strength = _prior(sums["hosts"], sums["n1"] or 0, sums["n2"] or 0.0, sums[f"k_{r}"] or 0, sums[f"q_{r}"] or 0.0, rules.max_strength)
        shrunk.append(((F.col(f"f_{r}") + mean * strength) / (F.col("n") + strength)).alias(f"rate_{r}"))
    return hosts.select("source", "n", *shrunk)


def _prior(hosts: int, n1: int, n2: float, k: int, q: float, most: float) -> tuple[float, float]:
    """Mean and strength from sums over hosts: documents, their squares, failures, failures squared by documents."""
    mean = k / n1 if n1 else 0.0
    within, room = mean * (1 - mean), n1 - n2 / n1 - (hosts - 1) if n1 else 0.0
    rho = ((q - k * k / n1) / within - (hosts - 1)) / room if within and room else 0.0
    return mean, min(max(1 / rho - 1, 1.0), most) if rho > 0 else most


def _verdicts(docs: DataFrame, rules: HostRules | None) -> DataFrame:
    """Per row: what was measured, base_failed, host_failed and kept."""
    rules = rules or HostRules()
    measured = materialized(measures(docs))
    rates = host_rates(measured, rules)
    bad = F.greatest(*[F.col(c) for c in rates.columns if c.startswith("rate_")]) > rules.host_limit
    # Written, so that Spark knows its size: a short list is sent to all, a long one meets the hosts by shuffle.
    rejected = materialized(rates.filter(bad).select("source", F.lit(True).alias("host_failed")))
    fails = rules.failures()
    base = fails["short"] | fails["repeats"]
    return (
        measured.filter("source is not null").join(rejected, "source", "left")
        .unionByName(measured.filter("source is null").withColumn("host_failed", F.lit(False)))
        .withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
        .withColumn("base_failed", base)
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
    )


def host_quality(docs: DataFrame, rules: HostRules | None = None) -> DataFrame:
    """Per row: doc_id, the counts, base_failed, host_failed and kept."""
    return _verdicts(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed", "kept"
    )


def keep_good(docs: DataFrame, rules: HostRules | None = None) -> DataFrame:
    """The rows that base rules and host verdicts accept, with all their columns. Each row is judged by its
    own text and host, also where rows share an id or have none."""
    return without(docs, _verdicts(docs, rules).filter(~F.col("kept")).select("doc_id", "source", "text_hash"))
