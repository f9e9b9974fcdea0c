"""Language identification as a mixture.

Each language has a distribution over hashed byte trigrams, counted over all training documents. A
document is a mixture of languages; its proportions are fitted by expectation-maximisation, and the
set of languages is the one of best penalised likelihood among nested sets of its strongest languages,
from one up to all learned languages. A larger set is fitted unless a bound on the likelihood of every
mixture shows that it cannot win, so leaving it out changes no result.

Defined cases: a null text or one without a letter (Unicode category L) is `und` with score 0; so is every text when no
language could be learned; a null id counts as the empty text for the folds; rows with a null lang
are not learned from; repeated rows are scored each; ties go to the language first by name; a text of any
length is fitted whole, by the counts of its distinct trigrams; columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import fold, map_slices, sliced, text_hash, without

BUCKETS = 1 << 16
ROUNDS = 10
# Trigrams overlap threefold, so the likelihood counts a third.
OVERLAP = 3
UNKNOWN = "und"

_PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def has_letter(text: str) -> bool:
    """Whether a character is of Unicode's category L; other signs that count as alphanumeric (², ½, Ⅷ) are none."""
    return any(c.isalpha() and unicodedata.category(c)[0] == "L" for c in text)


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams whose middle byte belongs to a letter, of the lower-cased text."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_PLAIN) + b" ", np.uint8)
    a = raw.astype(np.uint32)
    joined = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
    hashed = ((joined * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16)
    return hashed[a[1:-1] != 32]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in sliced(batches):
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            if text and lang is not None:
                counts = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                counts += np.bincount(trigrams(text), minlength=BUCKETS)
    for lang, counts in totals.items():
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(seen), pa.string()), "bucket": seen.astype(np.int32), "n": counts[seen]})


def learn(train: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their trigram probabilities (buckets x languages).

    Counts cover every training row. What reaches the driver is bounded by BUCKETS numbers per language.
    """
    counted = train.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(_count, "lang string, bucket int, n long")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs, buckets, n = rows.column("lang").to_pylist(), rows.column("bucket").to_numpy(), rows.column("n").to_numpy()
    names = sorted(set(langs))
    place = {x: i for i, x in enumerate(names)}
    counts = np.zeros((BUCKETS, len(names)))
    np.add.at(counts, (buckets, np.fromiter((place[x] for x in langs), np.int64, len(langs))), n)
    smoothed = counts + 0.5
    return names, (smoothed / smoothed.sum(axis=0)).astype(np.float32) if names else counts.astype(np.float32)


def _fit(prob: np.ndarray, n: np.ndarray, doc: np.ndarray, starts: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM over the languages of `mask` (documents x languages): proportions and log-likelihoods."""
    share = mask / mask.sum(axis=1, keepdims=True)
    total = np.add.reduceat(n, starts)[:, None]
    for _ in range(ROUNDS):
        part = prob * share[doc]
        part *= (n / part.sum(axis=1))[:, None]
        share = np.add.reduceat(part, starts, axis=0) / total
    return share, _likelihood((prob * share[doc]).sum(axis=1), n, starts)


def _likelihood(mix: np.ndarray, n: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(n * np.log(mix), starts, dtype=np.float64)


def _highest(prob: np.ndarray, n: np.ndarray, doc: np.ndarray, starts: np.ndarray, share: np.ndarray) -> np.ndarray:
    """A bound on the log-likelihood of each document under any mixture. The likelihood is concave, so no
    mixture gains more over `share` than N log(max_j sum_i n_i p_ij / (N mix_i)); the rest is for rounding."""
    mix = (prob * share[doc]).sum(axis=1)
    total = np.add.reduceat(n, starts, dtype=np.float64)
    each = n / mix
    slope = np.max([np.add.reduceat(p * each, starts, dtype=np.float64) for p in prob.T], axis=0) / total
    reached = _likelihood(mix, n, starts)
    return reached + total * np.log(np.maximum(slope, 1)) + 1e-6 * np.abs(reached)


def proportions(texts: list[str], model: np.ndarray) -> np.ndarray:
    """Language proportions of texts that each have at least one trigram."""
    found = [np.unique(trigrams(t), return_counts=True) for t in texts]
    sizes = np.array([len(b) for b, _ in found])
    doc, starts = np.repeat(np.arange(len(texts)), sizes), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    prob = model[np.concatenate([b for b, _ in found])]
    n = np.concatenate([c for _, c in found]).astype(np.float32)
    langs = model.shape[1]
    share, _ = _fit(prob, n, doc, starts, np.ones((len(texts), langs), np.float32))
    order = np.argsort(-share, axis=1, kind="stable")
    best = np.zeros_like(share)
    np.put_along_axis(best, order[:, :1], 1, axis=1)
    tokens = np.add.reduceat(n, starts, dtype=np.float64)
    top = _likelihood(prob[np.arange(len(n)), order[doc, 0]], n, starts) / OVERLAP
    highest = _highest(prob, n, doc, starts, share) / OVERLAP
    for k in range(2, langs + 1):
        penalty = 0.5 * (k - 1) * np.log(tokens)
        able = np.flatnonzero(highest - penalty > top)
        if not len(able):
            break
        inside, sub_sizes = np.isin(doc, able), sizes[able]
        sub_doc, sub_starts = np.repeat(np.arange(len(able)), sub_sizes), np.concatenate([[0], np.cumsum(sub_sizes)[:-1]])
        mask = np.zeros((len(able), langs), np.float32)
        np.put_along_axis(mask, order[able, :k], 1, axis=1)
        fitted, likelihood = _fit(prob[inside], n[inside], sub_doc, sub_starts, mask)
        value = likelihood / OVERLAP - penalty[able]
        better = value > top[able]
        top[able[better]] = value[better]
        best[able[better]] = fitted[better]
    return best


def predict(docs: DataFrame, names: list[str], model: np.ndarray) -> DataFrame:
    """Per row: doc_id, text_hash, lang_pred, score (share of that language), languages (the selected set)."""

    def one(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").to_pylist()
        ready = [i for i, t in enumerate(texts) if names and t and has_letter(t)]
        lang, score, chosen = [UNKNOWN] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
        if ready:
            share = proportions([texts[i] for i in ready], model)
            for i, row in zip(ready, share):
                lang[i], score[i] = names[int(row.argmax())], min(1.0, float(row.max()))
                chosen[i] = [names[j] for j in np.flatnonzero(row > 0)]
        return {
            "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "lang_pred": pa.array(lang, pa.string()), "score": score,
            "languages": pa.array(chosen, pa.list_(pa.string())),
        }

    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_hash().alias("text_hash"))
    return map_slices(picked, one, "doc_id long, text_hash long, lang_pred string, score double, languages array<string>")


def language_mixture(docs: DataFrame) -> DataFrame:
    """Learns from the rows outside the held-out fold and predicts for every row."""
    names, model = learn(docs.filter((fold(3) != 1) & F.col("lang").isNotNull()))
    return predict(docs, names, model).drop("text_hash").withColumn("held_out", fold(3) == 1)


def keep_identified(docs: DataFrame, least_share: float = 0.4) -> DataFrame:
    """The rows of which one language has at least `least_share`, with all their columns. Where no
    language can be learned, there is no verdict and all rows stay. Each row is judged by its own text,
    also where rows share an id or have none."""
    names, model = learn(docs.filter((fold(3) != 1) & F.col("lang").isNotNull()))
    if not names:
        return docs
    gone = predict(docs, names, model).filter((F.col("lang_pred") == UNKNOWN) | (F.col("score") < least_share))
    return without(docs, gone.select("doc_id", "text_hash"))
