"""Ranked lexical search over K2-treaps of the term-document grid.

Documents are indexed in blocks, in the partition where they lie. A block's grid has a row for each of its
terms (most frequent first) and a column for each document (shortest first); a point is a term in a document,
its value the impact of that term there. The grid is cut into quadrants again and again; a cell stores which
quadrants have points and the largest impact below it, and a cell with one point ends there (a compressed
quadtree). Cells are numbered level by level, so that the first child of a cell follows from counting bits.

A search starts at the root with one path for each of the item's terms, each bound to its row. A document
range has the sum of weight * largest impact over the paths that still lie in it as its bound. The best
ranges of every item are halved together, the row paths going down into both halves; a range in which every
path has come to a single point gives exact scores. Ranges below the item's k-th best score so far are
dropped. Ranges are taken in groups of the best, which grow from step to step, so that numpy works on whole
groups; the k best are carried from block to block of a partition.

Items go to the executors in one piece up to BROADCAST_BYTES of terms and weights (checked before), and
beyond in pieces by an equi join on cells of index blocks.

Defined cases: a null text has no terms; documents without a term are counted nowhere and never found; equal
scores go by smaller doc_id, unknown ids last; repeated documents are ranked each; repeated items (equal id
and text) are answered once; an item without terms, or whose terms occur nowhere, has no rows; only doc_id,
text and item_id are read; a text of any length is one column of a block that may hold it alone; empty
tables give no row. Scores are whole numbers of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import as_bytes, materialized, sliced
from ledgerloom.llm.vectors import rows_of
from ledgerloom.session import shared_folder

K = 50
BLOCK_DOCS = 4096
BLOCK_WORDS = 1 << 19
# Ranges of an item halved in the first step, and how this number grows with each further step; at most so many
# paths go down at once, which bounds a worker's memory.
FIRST_RANGES, GROWTH = 32, 1.5
MOST_PATHS = 1 << 17
BROADCAST_BYTES = 16 << 20
# Blocks of a row group of the written index.
ROW_GROUP = 1
PIECE_BYTES = 4 << 20
BLOCKS_PER_CELL = 16
SPREAD = 256

# Bytes that are no part of a term become blanks; A-Z become a-z. Bytes from 0x80 on are parts of letters.
TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
POPCOUNT = np.array([bin(i).count("1") for i in range(16)], np.int32)

BLOCK_SCHEMA = (
    "height int, doc_ids binary, known binary, terms string, dfs array<int>, masks binary, maxima binary, point_rows binary, point_docs binary"
)


@dataclass(frozen=True)
class Index:
    """The written blocks and the two numbers that impacts depend on."""

    blocks: DataFrame
    n_docs: int
    n_terms: int


def term_list(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TERM_BYTES).split()


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms with repeats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_terms = total = 0
        for batch in batches:
            for part in sliced(iter([batch])):
                for text in as_bytes(part):
                    n = len(term_list(text))
                    with_terms += n > 0
                    total += n
        yield pa.RecordBatch.from_pydict({"n": pa.array([with_terms], pa.int64()), "total": pa.array([total], pa.int64())})

    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return int(sums[0] or 0), int(sums[1] or 0)


def _spread(v: np.ndarray) -> np.ndarray:
    """Bits of a 32-bit number, each followed by a zero."""
    v = v.astype(np.uint64)
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << np.uint64(shift))) & np.uint64(keep)
    return v


def grown(rows: np.ndarray, docs: np.ndarray, impact: np.ndarray, height: int) -> dict[str, np.ndarray]:
    """The cells of all levels, one after the other. A mask of 0 marks a cell with a single point."""
    code = (_spread(rows) << np.uint64(1)) | _spread(docs)
    order = np.argsort(code)
    code, rows, docs, impact = code[order], rows[order], docs[order], impact[order]
    masks, maxima, point_rows, point_docs = [], [np.array([impact.max()], np.uint32)], [], []
    inner = np.arange(len(code))
    for level in range(height):
        child = code[inner] >> np.uint64(2 * (height - level - 1))
        starts = np.flatnonzero(np.r_[True, child[1:] != child[:-1]])
        single = np.diff(starts, append=len(child)) == 1
        if level + 1 == height:
            single[:] = True
        parent = child[starts] >> np.uint64(2)
        first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
        own = np.bitwise_or.reduceat((1 << (child[starts] & np.uint64(3)).astype(np.int64)).astype(np.uint8), first)
        if level:
            mask = np.zeros(len(was_single), np.uint8)
            mask[~was_single] = own
            masks.append(mask)
        else:
            masks.append(own)
        maxima.append(np.maximum.reduceat(impact[inner], starts).astype(np.uint32))
        ends = inner[starts[single]]
        point_rows.append(rows[ends])
        point_docs.append(docs[ends])
        inner = inner[~np.repeat(single, np.diff(starts, append=len(child)))]
        was_single = single
        if not len(inner):
            break
    masks.append(np.zeros(len(was_single), np.uint8))
    return {
        "masks": np.concatenate(masks), "maxima": np.concatenate(maxima),
        "point_rows": np.concatenate(point_rows).astype(np.int32), "point_docs": np.concatenate(point_docs).astype(np.int32),
    }


class _Words(dict):
    """Term -> number in order of appearance."""

    def __missing__(self, term: bytes) -> int:
        value = self[term] = len(self)
        return value


class _Block:
    """Documents on their way into a block."""

    def __init__(self) -> None:
        self.words, self.ids, self.known, self.sizes, self.terms, self.total = _Words(), [], [], [], [], 0

    def add(self, doc_id: int | None, terms: list[bytes]) -> None:
        self.ids.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.sizes.append(len(terms))
        self.terms.append(np.fromiter(map(self.words.__getitem__, terms), np.int32, len(terms)))
        self.total += len(terms)

    def row(self, n_docs: int, n_terms: int) -> pa.RecordBatch:
        sizes, vocabulary = np.array(self.sizes, np.int64), len(self.words)
        by_size = np.argsort(sizes, kind="stable")
        column = np.empty(len(sizes), np.int64)
        column[by_size] = np.arange(len(sizes))
        key, tf = np.unique(np.repeat(column, sizes) * vocabulary + np.concatenate(self.terms), return_counts=True)
        docs, term = key // vocabulary, key % vocabulary
        df = np.bincount(term, minlength=vocabulary)
        by_df = np.argsort(-df, kind="stable")
        place = np.empty(vocabulary, np.int64)
        place[by_df] = np.arange(vocabulary)
        m = 50 + (50 * sizes[by_size] * n_docs) // n_terms
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[docs])
        height = max(1, (vocabulary - 1).bit_length(), (len(sizes) - 1).bit_length())
        tree = grown(place[term], docs, impact, height)
        names = list(self.words)
        values = {
            "height": pa.array([height], pa.int32()),
            "doc_ids": pa.array([np.array(self.ids, np.int64)[by_size].tobytes()], pa.binary()),
            "known": pa.array([np.array(self.known, bool)[by_size].tobytes()], pa.binary()),
            "terms": pa.array([b" ".join(names[i] for i in by_df).decode()], pa.string()),
            "dfs": pa.array([df[by_df].astype(np.int32)], pa.list_(pa.int32())),
        }
        return pa.RecordBatch.from_pydict(values | {n: pa.array([v.tobytes()], pa.binary()) for n, v in tree.items()})


def build(docs: DataFrame, block_docs: int = BLOCK_DOCS, block_words: int = BLOCK_WORDS) -> Index:
    """Indexes every document with a term."""
    n_docs, n_terms = corpus_size(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for batch in sliced(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch)):
                if terms := term_list(text):
                    if block.total and (len(block.ids) >= block_docs or block.total + len(terms) > block_words):
                        yield block.row(n_docs, n_terms)
                        block = _Block()
                    block.add(doc_id, terms)
        if block.total:
            yield block.row(n_docs, n_terms)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path = shared_folder(docs.sparkSession)
    # A reader then holds one block at a time, not a whole file of them.
    rows.mapInArrow(run, BLOCK_SCHEMA).write.option("parquet.block.row.count.limit", ROW_GROUP).parquet(path)
    return Index(docs.sparkSession.read.parquet(path), n_docs, n_terms)


class Tree:
    """A block's cells, ready for going down."""

    def __init__(self, row: dict):
        self.height = row["height"]
        self.mask = np.frombuffer(row["masks"], np.uint8)
        self.maximum = np.frombuffer(row["maxima"], np.uint32)
        self.point_row = np.frombuffer(row["point_rows"], np.int32)
        self.point_doc = np.frombuffer(row["point_docs"], np.int32)
        below = POPCOUNT[self.mask]
        self.first_child = 1 + np.cumsum(below, dtype=np.int32) - below
        single = self.mask == 0
        self.point = np.cumsum(single, dtype=np.int32) - single


@dataclass
class Ranges:
    """Document ranges of items: `start` and `size` say which of the paths (cell, row, weight) lie in each."""

    item: np.ndarray
    level: np.ndarray
    doc: np.ndarray
    bound: np.ndarray
    size: np.ndarray
    cell: np.ndarray
    row: np.ndarray
    weight: np.ndarray

    def picked(self, keep: np.ndarray) -> Ranges:
        paths = np.repeat(keep, self.size)
        return Ranges(
            self.item[keep], self.level[keep], self.doc[keep], self.bound[keep], self.size[keep], self.cell[paths], self.row[paths], self.weight[paths]
        )

    def joined(self, *others: Ranges) -> Ranges:
        return Ranges(*[np.concatenate([getattr(x, n) for x in (self, *others)]) for n in self.__dataclass_fields__])


def _halved(tree: Tree, ranges: Ranges, half: int) -> Ranges:
    """The lower (0) or upper (1) half of each range, with the paths that go on in it."""
    owner = np.repeat(np.arange(len(ranges.item), dtype=np.int32), ranges.size)
    shift = (tree.height - 1 - ranges.level).astype(np.int32)[owner]
    mask = tree.mask[ranges.cell]
    quadrant = (2 * ((ranges.row >> shift) & 1) + half).astype(np.uint8)
    goes = (mask >> quadrant) & 1 == 1
    child = tree.first_child[ranges.cell] + POPCOUNT[mask & ((np.uint8(1) << quadrant) - np.uint8(1))]
    ended = np.flatnonzero(mask == 0)
    child[ended] = ranges.cell[ended]
    goes[ended] = (tree.point_doc[tree.point[child[ended]]] >> shift[ended]) & 1 == half
    at = np.flatnonzero(goes)
    child = child[at]
    ends = tree.mask[child] == 0
    wrong = np.zeros(len(at), bool)
    wrong[ends] = tree.point_row[tree.point[child[ends]]] != ranges.row[at[ends]]
    at, child = at[~wrong], child[~wrong]
    own = owner[at]
    starts = np.flatnonzero(np.diff(own, prepend=-1))
    up, weight = own[starts], ranges.weight[at]
    bound = np.add.reduceat(weight.astype(np.int64) * tree.maximum[child], starts) if len(starts) else np.zeros(0, np.int64)
    return Ranges(
        ranges.item[up], ranges.level[up] + 1, 2 * ranges.doc[up] + half, bound, np.diff(starts, append=len(at)), child, ranges.row[at], weight
    )


class Best:
    """The k best documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.item, self.score, self.ids, self.known = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))

    def add(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, score])
        ids, known = np.concatenate([self.ids, ids]), np.concatenate([self.known, known])
        order = np.lexsort((ids, ~known, -score, item))
        starts = np.flatnonzero(np.diff(item[order], prepend=-1))
        rank = np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order)))
        last = order[rank == self.k - 1]
        self.least[item[last]] = score[last]
        keep = order[rank < self.k]
        self.item, self.score, self.ids, self.known = item[keep], score[keep], ids[keep], known[keep]


def _exact(tree: Tree, ranges: Ranges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, document, score) of ranges whose paths have all come to a point."""
    owner = np.repeat(np.arange(len(ranges.item)), ranges.size)
    key = (owner << 32) | tree.point_doc[tree.point[ranges.cell]].astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, value = key[order], (ranges.weight.astype(np.int64) * tree.maximum[ranges.cell])[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    score = np.add.reduceat(value, starts) if len(starts) else np.zeros(0, np.int64)
    return ranges.item[key[starts] >> 32], key[starts] & 0xFFFFFFFF, score


def descend(tree: Tree, ids: np.ndarray, known: np.ndarray, ranges: Ranges, best: Best) -> None:
    """Best-first over document ranges of all items, until no range can beat the item's k-th score."""
    width = FIRST_RANGES
    while len(ranges.item):
        order = np.lexsort((-ranges.bound, ranges.item))
        starts = np.flatnonzero(np.diff(ranges.item[order], prepend=-1))
        rank = np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order)))
        first = np.argsort(rank, kind="stable")
        first = first[rank[first] < int(width)]
        paths = np.cumsum(ranges.size[order[first]])
        now = np.zeros(len(order), bool)
        now[order[first[(paths <= MOST_PATHS) | (paths == paths[0])]]] = True
        width *= GROWTH
        taken = ranges.picked(now)
        halves = _halved(tree, taken, 0).joined(_halved(tree, taken, 1))
        halves = halves.picked(halves.bound >= best.least[halves.item])
        open_paths = np.r_[0, np.cumsum(tree.mask[halves.cell] != 0)]
        ends = np.cumsum(halves.size)
        done = open_paths[ends] == open_paths[ends - halves.size]
        item, doc, score = _exact(tree, halves.picked(done))
        good = score >= best.least[item]
        best.add(item[good], score[good], ids[doc[good]], known[doc[good]])
        ranges = ranges.picked(~now).joined(halves.picked(~done)) if not now.all() else halves.picked(~done)
        ranges = ranges.picked(ranges.bound >= best.least[ranges.item])


class Questions:
    """Items as arrays: which of the distinct terms each has, and their weights."""

    def __init__(self, items: list[tuple[list[str], list[int]]]):
        self.count = len(items)
        number = _Words()
        self.item = np.repeat(np.arange(len(items)), [len(t) for t, _ in items])
        self.term = np.array([number[t] for terms, _ in items for t in terms], np.int64)
        self.weight = np.array([w for _, weights in items for w in weights], np.int64)
        self.terms = list(number)

    def search(self, row: dict, best: Best) -> None:
        """Adds one block's documents to the best."""
        place = {t: i for i, t in enumerate(row["terms"].split(" "))}
        rows = np.array([place.get(t, -1) for t in self.terms], np.int64)[self.term] if len(self.term) else self.term
        here = np.flatnonzero((rows >= 0) & (self.weight > 0))
        if not len(here):
            return
        tree, item = Tree(row), self.item[here]
        starts = np.flatnonzero(np.diff(item, prepend=-1))
        n = len(starts)
        full = np.full(n, np.iinfo(np.int64).max)
        ranges = Ranges(
            item[starts], np.zeros(n, np.int64), np.zeros(n, np.int64), full, np.diff(starts, append=len(here)),
            np.zeros(len(here), np.int32), rows[here].astype(np.int32), self.weight[here].astype(np.int32),
        )
        descend(tree, np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["known"], bool), ranges, best)


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM_PATTERN), F.lit(0)))


def weighted(index: Index, items: DataFrame) -> DataFrame:
    """(item_key, item_id, terms, weights) of the items that have a term of the index."""
    text = F.col("text").cast("string")
    own = items.select("item_id", text.alias("_t")).distinct().select(
        F.xxhash64(F.col("item_id").cast("string"), F.col("item_id").isNull(), "_t").alias("item_key"), "item_id", F.explode(_terms(F.col("_t"))).alias("term")
    )
    # one row for each block and term, cut to the items' terms before it is added up
    listed = index.blocks.select(F.posexplode(F.split("terms", " ")).alias("at", "term"), "dfs").select("term", F.col("dfs")[F.col("at")].alias("df"))
    df = listed.join(own.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * index.n_docs + 2)) / (2 * F.col("df") + 1))).cast("long")
    return own.join(df, "term").groupBy("item_key").agg(
        F.first("item_id").alias("item_id"), F.collect_list(F.struct("term", weight.alias("w"))).alias("tw")
    ).select("item_key", "item_id", F.col("tw.term").alias("terms"), F.col("tw.w").alias("weights"))


FOUND_SCHEMA = "item_key long, doc_id long, score long"


def _found(keys: np.ndarray, best: Best) -> pa.RecordBatch:
    columns = [pa.array(keys[best.item]), pa.array(best.ids, mask=~best.known), pa.array(best.score)]
    return pa.RecordBatch.from_arrays(columns, ["item_key", "doc_id", "score"])


def _with_broadcast(index: Index, items: DataFrame, k: int) -> DataFrame:
    rows = items.select("item_key", "terms", "weights").collect()
    keys = np.array([r.item_key for r in rows], np.int64)
    sent = index.blocks.sparkSession.sparkContext.broadcast([(list(r.terms), list(r.weights)) for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions = Questions(sent.value)
        best = Best(questions.count, k)
        for batch in batches:
            for row in rows_of(batch):
                questions.search(row, best)
        yield _found(keys, best)

    return index.blocks.drop("dfs").mapInArrow(run, FOUND_SCHEMA)


def _with_join(index: Index, items: DataFrame, size: int, k: int) -> DataFrame:
    """Pieces of the items meet every cell of blocks in an equi join."""
    count = index.blocks.count()
    cells = max(1, min(count, SPREAD), -(-count // BLOCKS_PER_CELL))
    pieces = items.withColumn("piece", F.pmod("item_key", F.lit(-(-size // PIECE_BYTES)))).groupBy("piece").agg(
        F.collect_list(F.struct("item_key", "terms", "weights")).alias("pack")
    )
    sent = pieces.select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), "pack").repartition(cells, "cell")
    own = F.pmod(F.xxhash64("doc_ids", "known"), F.lit(cells)).cast("int")
    met = index.blocks.drop("dfs").withColumn("cell", own).repartition(cells, "cell").join(sent, "cell").drop("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                questions = Questions([(x["terms"], x["weights"]) for x in row["pack"]])
                best = Best(questions.count, k)
                questions.search(row, best)
                yield _found(np.array([x["item_key"] for x in row["pack"]], np.int64), best)

    return met.mapInArrow(run, FOUND_SCHEMA)


def search(index: Index, items: DataFrame, k: int = K, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0."""
    items = materialized(weighted(index, items))
    size = items.agg(F.sum(F.size("terms") * 16 + F.aggregate("terms", F.lit(0), lambda n, t: n + F.octet_length(t)))).first()[0] or 0
    found = _with_broadcast(index, items, k) if size <= broadcast_bytes else _with_join(index, items, size, k)
    order = Window.partitionBy("item_key").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
    return ranked.join(items.select("item_key", "item_id"), "item_key").select("item_id", "rank", "doc_id", "score")
