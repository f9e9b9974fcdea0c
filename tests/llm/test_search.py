"""Lexical search, exact top-k and clustering against brute force, on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import shallot_kmeans, treap_search, vectors, vertical_topk

VECTORS = "vec_id long, embedding array<float>, label int, v int, score string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vector_rows(n=230, width=64, seed=4):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(5, width))
    rows = [(i, [float(x) for x in (centers[i % 5] + rng.normal(size=width) * 0.6) / 8], i % 5, 1, "s") for i in range(n)]
    rows += [rows[20], rows[40], (None, rows[3][1], 0, 1, "s"), (900, None, 0, 1, "s"), (920, [None] + rows[1][1][1:], 0, 1, "s")]
    rows += [(940, [float("nan")] + rows[1][1][1:], 0, 1, "s"), (960, [float("inf")] * width, 0, 1, "s"), (None, None, None, None, None)]
    rows += [(1000 + i, rows[0][1], 0, 1, "s") for i in range(60)]  # copies: ties
    rows += [(2000, [1e9] * width, 0, 1, "s")]
    return rows


def whole(row, factor, width=None):
    v = row[1]
    if v is None or any(x is None or not math.isfinite(x) or abs(x) >= vectors.LARGEST / factor for x in v) or width and len(v) != width:
        return None
    return [math.floor(factor * float(np.float32(x))) for x in v]


def top_by_hand(rows, k=20, every=20):
    kept = [(i, r[0], whole(r, 64)) for i, r in enumerate(rows) if whole(r, 64) is not None]
    out = Counter()
    for i, q, a in kept:
        if q is None or q % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a, b)), c is None, c or 0, c) for j, c, b in kept if j != i), key=lambda x: x[:3])
        for rank, (s, _, _, c) in enumerate(scored[:k], 1):
            out[(q, rank, c, -s)] += 1
    return out


@pytest.mark.parametrize("block_rows", [8192, 37])
def test_top_k(spark, block_rows):
    rows = vector_rows() + [(3000, [0.5] * 10, 0, 1, "s"), (3020, [], 0, 1, "s"), (3040, [0.25] * 70, 0, 1, "s")]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = Counter(tuple(r) for r in vertical_topk.top_k(df, block_rows=block_rows).collect())
    assert got == top_by_hand(rows)


def test_top_k_of_few_and_none(spark):
    few = [(0, [1.0, 0.0], 0, 1, "s"), (1, [0.5, 0.5], 0, 1, "s"), (20, [-1.0, 0.0], 0, 1, "s")]
    got = [tuple(r) for r in vertical_topk.top_k(spark.createDataFrame(few, VECTORS)).collect()]
    assert Counter(got) == top_by_hand(few) and len(got) == 4
    assert vertical_topk.top_k(spark.createDataFrame([], VECTORS)).count() == 0
    assert vertical_topk.top_k(spark.createDataFrame([few[1]], VECTORS)).count() == 0


@pytest.mark.parametrize("large", [1, 1 << 25])
def test_survivors_are_all_that_reach(large):
    rng = np.random.default_rng(1)
    q, x = rng.integers(-60, 60, (9, 64)).astype(np.int32), rng.integers(-60, 60, (64, 500)).astype(np.int32)
    q[:, :8] *= large // 64 or 1
    x[:8] *= large // 64 or 1
    score = q.astype(object) @ x.astype(object)
    least = np.array([float(sorted(row)[-15]) for row in score])
    qi, xi, s = vertical_topk.survivors(q, x, least)
    assert {(int(a), int(b), int(c)) for a, b, c in zip(qi, xi, s)} >= {(i, j, int(score[i, j])) for i in range(9) for j in range(500) if score[i, j] >= least[i]}
    assert all(score[i, j] == v for i, j, v in zip(qi, xi, s)) and len(qi) < 9 * 500 / 3


def clusters_by_hand(rows, count=8, rounds=10):
    kept = [(r[0], np.array(whole(r, 1024, 64), object)) for r in rows if whole(r, 1024, 64) is not None]
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), tuple(v)) for i, v in kept if i is not None)
    centers = [np.array(v, object) for _, v in named[:count]]

    def near(v):
        return min((int(((v - c) ** 2).sum()), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        centers = [
            np.array([int(sum(v[d] for (_, v), a in zip(kept, at) if a == j)) // at.count(j) for d in range(64)], object) if j in at else c
            for j, c in enumerate(centers)
        ]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    per = Counter()
    for _, j, d in found:
        per[j] += d
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return Counter((i, j, d, per[j], sum(per.values()), hashes[j]) for i, j, d in found)


@pytest.mark.parametrize("block_rows", [4096, 50])
def test_clusters(spark, block_rows):
    rows = vector_rows() + [(3000, [0.5] * 10, 0, 1, "s")]
    got = shallot_kmeans.clusters(spark.createDataFrame(rows, VECTORS).repartition(3), block_rows=block_rows)
    assert Counter(tuple(r) for r in got.collect()) == clusters_by_hand(rows)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bounds_")]


def test_clusters_of_few_and_none(spark):
    few = [(i, [0.1 * (i % 3)] * 64, 0, 1, "s") for i in range(5)]
    for rows in (few, few[:1], [few[0]] * 12):
        got = Counter(tuple(r) for r in shallot_kmeans.clusters(spark.createDataFrame(rows, VECTORS)).collect())
        assert got == clusters_by_hand(rows)
    assert shallot_kmeans.clusters(spark.createDataFrame([], VECTORS)).count() == 0


def test_bounds_skip_most_distances():
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(2000, 16)) * 40 + rng.integers(0, 6, 2000)[:, None] * 900).astype(np.int32)
    centers = x[:6].astype(np.int64)
    state, moved, looked = None, np.zeros(6), []
    plain = shallot_kmeans._squared
    for _ in range(8):
        count = [0]

        def counted(rows, c, which):
            count[0] += len(rows)
            return plain(rows, c, which)

        shallot_kmeans._squared = counted
        try:
            state = shallot_kmeans.assigned(x, centers, moved, state)
        finally:
            shallot_kmeans._squared = plain
        all_d = np.square(x[:, None].astype(np.int64) - centers[None]).sum(2)
        assert (state["near"] == all_d.argmin(1)).all()
        looked.append(count[0])
        new = np.array([x[state["near"] == j].astype(np.int64).sum(0) // max(1, (state["near"] == j).sum()) if (state["near"] == j).any() else centers[j] for j in range(6)])
        moved, centers = np.sqrt(np.square(new - centers).sum(1).astype(float)), new
    assert looked[-1] < 0.4 * looked[0]


def search_by_hand(rows, items, k=50):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    docs = [(r[0], Counter(terms(r[1]))) for r in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, total = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = Counter()
    for item, text in {(i, t) for i, t, *_ in items}:
        scored = []
        for i, c, n in docs:
            m = 50 + (50 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1):
            out[(item, rank, i, -s)] += 1
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(5000)] + ["Été", "straße", "日本", "A1", "a1"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(400)]
    rows += [(500 + i, rows[7][1]) for i in range(80)] + [rows[9], rows[9], (None, rows[7][1]), (None, rows[8][1]), (600, None), (601, ""), (602, "-- !?"), (603, " ".join(rng.choice(words) for _ in range(30_000))), (604, "ÀÉ_x² Straße")]
    items = [(1, rows[7][1]), (2, "w1 w2 W3, ÉTÉ"), (3, None), (4, "never seen"), (5, "?!"), (None, "straße 日本 a1 A1"), (2, "w1 w2 W3, ÉTÉ"), (2, "w5"), (7, rows[300][1] + " " + rows[301][1])]
    return rows, items


@pytest.mark.parametrize("block_docs, block_words, sent", [(4096, 1 << 19, 1 << 24), (40, 900, 1 << 24), (60, 1 << 19, 0)])
def test_search(spark, texts, monkeypatch, block_docs, block_words, sent):
    rows, items = texts
    monkeypatch.setattr(treap_search, "PIECE_BYTES", 600)
    docs = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "doc_id long, text string, score int, terms string, rank int").repartition(3)
    asked = spark.createDataFrame([(*x, "z", 3) for x in items], "item_id long, text string, term string, doc_id int")
    index = treap_search.build(docs, block_docs, block_words)
    got = Counter(tuple(r) for r in treap_search.search(index, asked, broadcast_bytes=sent).collect())
    assert got == search_by_hand(rows, items)


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, "a")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "b")], "item_id long, text string")
    assert treap_search.search(treap_search.build(none), items).count() == 0
    assert treap_search.search(treap_search.build(some), items.limit(0)).count() == 0
    assert [r.doc_id for r in treap_search.search(treap_search.build(some), items).collect()] == [1]


def test_treap_holds_every_point():
    rng = np.random.default_rng(5)
    cells = np.unique(rng.integers(0, 1 << 11, (3000, 2)) >> rng.integers(0, 9, (3000, 1)), axis=0)
    impact = rng.integers(1, 10**6, len(cells))
    grown = treap_search.grown(cells[:, 0], cells[:, 1], impact, 11)
    tree = treap_search.Tree({"height": 11} | {n: v.tobytes() for n, v in grown.items()})
    found = {}

    def down(cell, level, row, doc):
        if tree.mask[cell] == 0:
            p = tree.point[cell]
            assert tree.point_row[p] >> (11 - level) == row and tree.point_doc[p] >> (11 - level) == doc
            found[(int(tree.point_row[p]), int(tree.point_doc[p]))] = int(tree.maximum[cell])
            return int(tree.maximum[cell])
        best, child = 0, tree.first_child[cell]
        for quadrant in range(4):
            if tree.mask[cell] >> quadrant & 1:
                best, child = max(best, down(child, level + 1, 2 * row + quadrant // 2, 2 * doc + quadrant % 2)), child + 1
        assert best == tree.maximum[cell]
        return best

    down(0, 0, 0, 0)
    assert found == {(int(r), int(d)): int(v) for (r, d), v in zip(cells, impact)}
