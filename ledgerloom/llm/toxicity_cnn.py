"""Toxicity by a convolutional text classifier.

A word is the sum of hashed embeddings of itself and its beginnings. Filters of one to three words slide
over the whole text, the largest response of each filter is pooled, and a logistic layer scores them. The
network is trained in numpy on a bounded sample of labelled rows (SAMPLE per label). Every document is
scored once; thresholds then follow from counts of all labelled rows outside the held-out fold by score, for
each language, where the language is guessed from the words alone. Rows that the network was fitted on
score too well: they count for the class rate, but the scores of their class are taken from the other rows.
The score is shifted so that 0.5 is the threshold.

Defined cases: empty and null texts are one empty word and get the network's score for it; a null id
counts as the empty text for the folds; rows without a label are not learned from, of repeated labels of
one document the higher counts; of equal logits none goes first, they share a bin and a side of the threshold;
texts of any length are scored whole; without both labels to learn from, every score is 0; repeated rows are
scored each; only doc_id, text and, for the language words of training rows, lang are read.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import as_bytes, fold, map_slices
from ledgerloom.scale import materialized

SAMPLE = 1500
# Longest text, in bytes, that the network is fitted on; longer ones are scored like all others.
LONGEST = 1 << 16
BUCKETS, DIM = 1 << 17, 12
WIDTHS, FILTERS = (1, 2, 3), 6
BEGINNINGS = (3, 4, 5, 6)
LEAST_DOCS = 4
EPOCHS, RATE = 5, 0.1
# A language with fewer rows of a label that were not fitted on takes the common threshold.
LEAST_POSITIVES = 15
# Logits are counted in bins of 1 / BINS up to FARTHEST on either side of 0.
BINS, FARTHEST = 32, 100
_EDGES = re.compile(r"^\W+|\W+$")


@dataclass
class Network:
    embedding: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    lang_words: np.ndarray  # (BUCKETS, languages), log-likelihoods
    fitted: list[int]  # ids of the rows it was trained on, at most 2 * SAMPLE distinct ones


def features(word: bytes) -> list[int]:
    """Buckets of a word: itself and its beginnings (missing ones fall to the word's own bucket)."""
    text = _EDGES.sub("", word.decode("utf-8", "replace").lower())
    whole = zlib.crc32(text.encode()) % BUCKETS
    return [whole, *(zlib.crc32(f"{n}^{text[:n]}".encode()) % BUCKETS if len(text) > n else whole for n in BEGINNINGS)]


def _indexed(texts: list[bytes | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Features of the distinct words (the last row is the empty word), and each text as word numbers."""
    number: dict[bytes, int] = {}
    rows = [np.array([number.setdefault(w, len(number)) for w in (t or b"").split()], np.int64) for t in texts]
    table = np.array([features(w) for w in number] + [[BUCKETS] * (1 + len(BEGINNINGS))], np.int64)
    return table, [r if len(r) else np.array([len(number)]) for r in rows]


def _vectors(embedding: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum of the embeddings; the bucket after the last is the zero vector."""
    return np.vstack([embedding, np.zeros((1, DIM), np.float32)])[table].sum(axis=1)


def _sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _train(texts: list[bytes | None], labels: np.ndarray) -> Network:
    rng = np.random.default_rng(7)
    table, rows = _indexed(texts)
    seen = np.zeros((2, BUCKETS + 1))
    for row, y in zip(rows, labels):
        seen[y, np.unique(table[row])] += 1
    totals = np.maximum(1, np.bincount(labels, minlength=2))
    odds = np.log((seen[1] + 1) / (totals[1] + 2)) - np.log((seen[0] + 1) / (totals[0] + 2))
    known = seen.sum(axis=0) >= LEAST_DOCS
    embedding = rng.normal(0, 0.01, (BUCKETS + 1, DIM)).astype(np.float32)
    embedding[:, 0] = np.clip(odds, -1, 4) * 0.2  # starts from the words' own evidence
    embedding[~known] = 0
    embedding[BUCKETS] = 0
    filters = {w: rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    for w in WIDTHS:
        filters[w][:, 0, :] = 0.5 + 0.1 * rng.random((w, FILTERS))
    bias, out, out_bias = np.zeros(FILTERS * len(WIDTHS), np.float32), np.full(FILTERS * len(WIDTHS), 0.2, np.float32), -1.0
    squares = {name: 1e-3 for name in ("out", "bias", "out_bias")} | {w: np.full_like(filters[w], 1e-3) for w in WIDTHS}
    row_squares = np.full(BUCKETS + 1, 1e-3, np.float32)
    for _ in range(EPOCHS):
        for d in rng.permutation(len(rows)):
            words = np.concatenate([rows[d], [len(table) - 1] * (max(WIDTHS) - 1)])
            uniq, place = np.unique(words, return_inverse=True)
            x = embedding[table[uniq]].sum(axis=1)[place]
            n, tops, pooled = len(rows[d]), [], []
            for w in WIDTHS:
                z = sum(x[j : n + j] @ filters[w][j] for j in range(w))
                tops.append(z.argmax(axis=0))
                pooled.append(z[tops[-1], np.arange(FILTERS)])
            raw = np.concatenate(pooled) + bias
            act = np.maximum(raw, 0)
            slope = _sigmoid(float(act @ out) + out_bias) - labels[d]
            back = slope * out * (raw > 0)
            for name, g in (("out", slope * act + 1e-4 * out), ("bias", back), ("out_bias", slope)):
                squares[name] = squares[name] + g * g
                step = RATE * g / np.sqrt(squares[name])
                if name == "out":
                    out = (out - step).astype(np.float32)
                elif name == "bias":
                    bias = (bias - step).astype(np.float32)
                else:
                    out_bias -= float(step)
            for i, w in enumerate(WIDTHS):
                g = back[i * FILTERS : (i + 1) * FILTERS]
                if not g.any():
                    continue
                for j in range(w):
                    at = tops[i] + j
                    grad = x[at].T * g
                    squares[w][j] += grad * grad
                    per_word = filters[w][j].T * g[:, None]
                    filters[w][j] -= RATE * grad / np.sqrt(squares[w][j])
                    for word, pg in zip(words[at], per_word):
                        slots = table[word][known[table[word]]]
                        row_squares[slots] += float(pg @ pg)
                        np.subtract.at(embedding, slots, RATE * pg / np.sqrt(row_squares[slots])[:, None])
            embedding[BUCKETS] = 0
    return Network(embedding[:BUCKETS], filters, bias, out, out_bias, np.zeros((BUCKETS, 1), np.float32), [])


def _scores(net: Network, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(logit, language number) of each whole text."""
    table, rows = _indexed(texts)
    vectors, pad = _vectors(net.embedding, table), max(WIDTHS) - 1
    empty = len(table) - 1
    sizes = np.array([len(r) for r in rows])
    starts = np.concatenate([[0], np.cumsum(sizes + pad)[:-1]])
    words = np.full(int((sizes + pad).sum()) + pad, empty, np.int64)
    inside = np.zeros(len(words), bool)
    for row, at in zip(rows, starts):
        words[at : at + len(row)] = row
        inside[at : at + len(row)] = True
    total, pooled = len(words) - pad, []
    for w in WIDTHS:
        z = sum((vectors @ net.filters[w][j])[words[j : total + j]] for j in range(w))
        z[~inside[:total]] = -np.inf
        pooled.append(np.maximum.reduceat(z, starts, axis=0))
    logits = np.maximum(np.hstack(pooled) + net.bias, 0) @ net.out + net.out_bias
    evidence = np.vstack([net.lang_words, np.zeros((1, net.lang_words.shape[1]), np.float32)])[table[:, 0]]
    return logits.astype(float), np.add.reduceat(evidence[words[:total]], starts, axis=0).argmax(axis=1)


def score_bin(logit: Column) -> Column:
    return F.floor(F.greatest(F.lit(-FARTHEST), F.least(F.lit(FARTHEST), logit)) * BINS).cast("int")


def counted(scored: DataFrame, labels: DataFrame, fitted: list[int]) -> list:
    """Labelled rows outside the held-out fold by language, score bin, label and whether the network was fitted
    on them. What reaches the driver is bounded by the bins, not by the rows."""
    spark = scored.sparkSession
    known = spark.createDataFrame([(d,) for d in fitted], "doc_id long").withColumn("_fitted", F.lit(True))
    judged = _usable(labels).join(F.broadcast(known), "doc_id", "left")  # at most 2 * SAMPLE rows
    return scored.join(judged, "doc_id").groupBy(
        "language", score_bin(F.col("logit")).alias("bin"), "toxic", F.coalesce("_fitted", F.lit(False)).alias("fitted")
    ).agg(F.count(F.lit(1)).alias("n")).collect()


def thresholds(counts: list, languages: int) -> np.ndarray:
    """The logit of best F1 for each language at the class rate of all its rows; languages in which few
    rows of a label were not fitted on take the common one.

    The rows of a label weigh as much as there are of it, fitted on or not, and are spread over the bins
    like those that were not fitted on (like all of them, if there is no other).
    """
    at = np.zeros((languages, 2, 2, 2 * FARTHEST * BINS + 1))
    for r in counts:
        at[r.language, r.toxic, int(r.fitted), r.bin + FARTHEST * BINS] += r.n

    def best(x: np.ndarray) -> float:
        new, total = x[:, 0].sum(axis=1, keepdims=True), x.sum(axis=(1, 2))[:, None]
        rows = np.where(new > 0, x[:, 0] * (total / np.maximum(new, 1)), x[:, 1])
        held = np.flatnonzero(rows.sum(axis=0))[::-1]
        hit, taken = np.cumsum(rows[1, held]), np.cumsum(rows[:, held].sum(axis=0))
        k = int((2 * hit / (taken + hit[-1])).argmax())
        next_top = held[k + 1] + 1 if k + 1 < len(held) else held[k]
        return (held[k] + next_top) / 2 / BINS - FARTHEST

    if not at.any():
        return np.zeros(languages)
    common = best(at.sum(axis=0))
    return np.array([best(x) if x[:, 0].sum(axis=1).min() >= LEAST_POSITIVES else common for x in at])


def _usable(labels: DataFrame) -> DataFrame:
    return labels.filter((fold(5) != 0) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def learn(docs: DataFrame, labels: DataFrame) -> Network | None:
    """Trains on at most SAMPLE ids of either label outside the held-out fold, taken in the order of a hash, with one
    text for each id (of the smallest hash) and none of more than LONGEST bytes, so what is gathered is bounded;
    every fifth of them is left out, so that small tables keep rows of both labels to set thresholds by."""
    usable, picked = _usable(labels), None
    for y in (0, 1):
        part = usable.filter(F.col("toxic") == y).orderBy(F.xxhash64(F.col("doc_id"), F.lit(11)), "doc_id").limit(SAMPLE)
        picked = part if picked is None else picked.union(part)
    rows = docs.select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string")).join(
        F.broadcast(picked), "doc_id"  # at most 2 * SAMPLE rows
    ).filter(F.octet_length(F.coalesce("text", F.lit(""))) <= LONGEST)
    one_each = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "lang")).alias("x"))
    rows = one_each.select("doc_id", "toxic", "x.text", "x.lang").orderBy("doc_id").toArrow()
    texts, y, lang = as_bytes(rows.combine_chunks().to_batches()[0]) if rows.num_rows else [], np.array(rows.column("toxic").to_pylist(), np.int64), rows.column("lang").to_pylist()
    if len(set(y.tolist())) < 2:
        return None
    check = np.arange(len(y)) % 5 == 0
    net = _train([t for t, c in zip(texts, check) if not c], y[~check])
    names = sorted({x for x in lang if x is not None}) or [""]
    counts = np.full((BUCKETS, len(names)), 0.1)
    for t, x in zip(texts, lang):
        if x is not None and t:
            words = np.array([zlib.crc32(_EDGES.sub("", w.decode("utf-8", "replace").lower()).encode()) % BUCKETS for w in t.split()], np.int64)
            np.add.at(counts, (words, names.index(x)), 1)
    net.lang_words = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    net.fitted = sorted({d for d, c in zip(rows.column("doc_id").to_pylist(), check) if not c})
    return net


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    net = learn(docs, labels)
    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if net is None:
        scored = picked.select("doc_id", F.lit(0.0).alias("score"))
    else:

        def one(batch: pa.RecordBatch) -> dict:
            logits, lang = _scores(net, as_bytes(batch))
            return {"doc_id": batch.column("doc_id"), "logit": logits, "language": lang.astype(np.int32)}

        found = materialized(map_slices(picked, one, "doc_id long, logit double, language int"))
        shifts = thresholds(counted(found, labels, net.fitted), net.lang_words.shape[1])
        shift = F.element_at(F.array(*[F.lit(float(x)) for x in shifts]), F.col("language") + 1)
        away = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("logit") - shift))
        scored = found.select("doc_id", (1 / (1 + F.exp(-away))).alias("score"))
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
