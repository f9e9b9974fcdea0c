"""Word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie with two roots, for beginnings of words and for continuations. Every node has a
failure link, and the number of tokens that are finished when it is taken is stored with it, so the greedy
longest-match length of a word is a sum of stored numbers in one pass over its characters; no piece is built.

Defined cases: null and empty texts have no tokens; a word that the vocabulary cannot spell is one unknown
token; repeated rows are counted each; an empty table gives an empty result; only doc_id and text are read.
The vocabulary is read by the driver and sent along (32,000 pieces).
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import REMEMBERED, map_slices
from ledgerloom.llm.sentencepiece_codec import MARK, MODEL_FILE, NORMAL, model_bytes, parse_model

CONTINUED = "##"
_WORDS = re.compile(r"\w+|[^\w\s]")


def vocabulary(path: str = MODEL_FILE) -> list[str]:
    """Word pieces of a SentencePiece vocabulary: marked pieces begin words, the others continue them; single
    characters do both."""
    found = set()
    for piece, _, kind in parse_model(model_bytes(path)).pieces:
        if kind == NORMAL and MARK not in piece[1:] and piece != MARK:
            found.add(piece[1:] if piece[0] == MARK else CONTINUED + piece)
            if len(piece) == 1:
                found.add(piece)
    return sorted(found)


class Automaton(dict):
    """Word -> number of tokens; lengths of words met are remembered up to a bound."""

    def __init__(self, vocab: Iterable[str]):
        super().__init__()
        # nodes 0 (start) and 1 (continuation)
        self.next: list[dict[str, int]] = [{}, {}]
        self.fail: list[int] = [-1, -1]
        self.popped: list[int] = [0, 0]
        ends: set[int] = set()
        for piece in vocab:
            at, rest = (1, piece[len(CONTINUED):]) if piece.startswith(CONTINUED) and len(piece) > len(CONTINUED) else (0, piece)
            for c in rest:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.fail.append(-1)
                    self.popped.append(0)
                at = self.next[at][c]
            ends.add(at)
        queue = deque([0, 1])
        while queue:
            parent = queue.popleft()
            for c, node in self.next[parent].items():
                queue.append(node)
                if node in ends:
                    self.fail[node], self.popped[node] = 1, 1
                    continue
                at, count = self.fail[parent], self.popped[parent]
                while at >= 0 and c not in self.next[at]:
                    count, at = count + self.popped[at], self.fail[at]
                if at >= 0:
                    self.fail[node], self.popped[node] = self.next[at][c], count

    def length(self, word: str) -> int:
        at = total = 0
        for c in word:
            while c not in self.next[at]:
                if self.fail[at] < 0:
                    return 1
                total += self.popped[at]
                at = self.fail[at]
            at = self.next[at][c]
        while at != 1:
            if self.fail[at] < 0:
                return 1
            total += self.popped[at]
            at = self.fail[at]
        return total

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = self.length(word)
        return value


_BUILT: dict[int, Automaton] = {}


def token_counts(docs: DataFrame, vocab: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_tokens."""
    pieces = tuple(vocabulary() if vocab is None else vocab)
    key = hash(pieces)

    def one(batch: pa.RecordBatch) -> dict:
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = Automaton(pieces)
        lengths = _BUILT[key].__getitem__
        words = [_WORDS.findall(t) if t else [] for t in batch.column("text").to_pylist()]
        return {
            "doc_id": batch.column("doc_id"), "n_words": pa.array([len(w) for w in words], pa.int64()),
            "n_tokens": pa.array([sum(map(lengths, w)) for w in words], pa.int64()),
        }

    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_slices(picked, one, "doc_id long, n_words long, n_tokens long")
