"""SentencePiece models on the tokenizers library.

The model's protobuf is parsed into pieces, scores, types and the two specifications it needs; from them
the normaliser, the marker for spaces, the unigram scores (or, for a model of merges, the merges in the
order of their scores) and the byte fallback are rebuilt. Texts are cut where no piece can reach across (before
a marker that follows another character), every distinct cut of a slice is encoded once by
encode_batch, decoded again and compared with the sentencepiece library.

round_trip says whether decode(ids) gives the text back; a text that itself holds the marker, or that the
model's normaliser changes, does not come back. Where a model has a character map or joins spaces, each
whole text is also encoded by the library, so that parity covers the normaliser.

Defined cases: null and empty texts have no tokens, and are whole and equal by definition; texts of any
length are encoded whole; repeated rows are encoded each; an empty table gives an empty result; only doc_id and text are read. The model file is
read by the driver and sent along (about half a megabyte).
"""

from __future__ import annotations

import heapq
import os
import re
import struct
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

from ledgerloom.llm.common import map_slices

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNIGRAM, MERGES = 1, 2
NORMAL, UNKNOWN, DEFINED, BYTE = 1, 2, 4, 6
# Cuts of either memory of a worker; some 200 bytes each.
REMEMBERED = 1 << 18
# Threads of one worker, cuts per call of the library, and words that are joined to one text.
THREADS, BATCH, JOINED = "2", 1 << 13, 64


@dataclass
class Model:
    """What a model file says; field numbers and defaults are those of the public .proto file."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True

    @property
    def unknown(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; fixed-width values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        tag = varint()
        width = {0: None, 1: 8, 5: 4}.get(tag & 7, -1)
        if width is None:
            yield tag >> 3, varint()
        else:
            width = varint() if width < 0 else width
            yield tag >> 3, raw[at : at + width]
            at += width


def parse_model(raw: bytes) -> Model:
    model = Model()
    for number, value in _fields(raw):
        if number == 1:
            piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
            model.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            spec = dict(_fields(value))
            model.kind, model.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(_fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix, model.squeeze_spaces = bool(spec.get(3, 1)), bool(spec.get(4, 1))
    return model


def _ordered_merges(model: Model) -> list[tuple[str, str]]:
    """Every split of a piece into two pieces, best score first; the parts that come first in the
    vocabulary decide between splits of one piece."""
    ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind == NORMAL}
    found = []
    for piece, i in ids.items():
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in ids and right in ids:
                found.append((-model.pieces[i][1], i, ids[left], ids[right], left, right))
    return [(x[4], x[5]) for x in sorted(found)]


def build_tokenizer(model: Model) -> Tokenizer:
    """Normaliser, model and decoder of the library; encode() gives whole texts' ids without special tokens."""
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown, model.byte_fallback)
    else:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(
            vocab, _ordered_merges(model), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback
        )
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(MARK)] if model.dummy_prefix else []
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    tokenizer.decoder = decoders.Sequence(
        [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])]
    )
    return tokenizer


def _grouped(texts: list[str | None], most: int = 1 << 19) -> Iterator[list[str | None]]:
    """The texts in groups of about `most` characters, at least one text each."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t or "")
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


# The cuts of a text that begins with a marker: all of them do.
_MARKED = re.compile(f"{MARK}+[^{MARK}]*")


class Codec:
    """Encoder and decoder of one worker, with a memory of cuts."""

    def __init__(self, raw: bytes, judged: bool = True):
        self.judged = judged  # whether cuts are decoded and compared with the library
        self.remembered = REMEMBERED if judged else 2 * REMEMBERED
        self.model = parse_model(raw)
        self.whole = build_tokenizer(self.model)
        self.plain = Tokenizer(self.whole.model)
        defined = [AddedToken(p, normalized=False) for p, _, kind in self.model.pieces if kind == DEFINED]
        if defined:
            self.plain.add_tokens(defined)
            self.whole.add_tokens(defined)
        self.pieces = [p for p, _, _ in self.model.pieces]
        self.scores = {p: (s, i) for i, (p, s, kind) in enumerate(self.model.pieces) if kind == NORMAL}
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.pieces)
        mixed = any(re.match(f"{MARK}{MARK}+[^{MARK}]", p) for p in self.pieces)
        self.cuts = None if crossing or mixed else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        kinds = Counter(kind for _, _, kind in self.model.pieces)
        # Merges stay inside a cut, and every character has ids whose bytes add up to its own, so words encoded together can be
        # told apart again; and a text is its words, each with a marker in front.
        parted = bool(self.cuts) and self.model.kind == MERGES and self.model.byte_fallback and kinds[BYTE] == 256 and not defined
        self.worded = parted and not judged and self.model.dummy_prefix and not self.model.charsmap and not self.model.squeeze_spaces
        self.sizes = np.array([1 if kind == BYTE else len(p.encode()) if kind == NORMAL else 0 for p, _, kind in self.model.pieces])
        self.judge = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.known: dict[str, bytes] = {}  # ids of a cut or a bare word, as 32-bit numbers
        self.before: dict[str, bytes] = {}  # the memory that filled up last; cuts met again move over
        self.lossy: set[str] = set()
        self.differing: set[str] = set()

    def spaces(self, n: int) -> list[int]:
        """Ids of a run of n markers of a model of merges: all space runs may share one score, where the
        leftmost pair goes first; the library's merges are ordered by pair instead."""
        piece, before, after = [MARK] * n, list(range(-1, n - 1)), [*range(1, n), n]
        heap: list[tuple[float, int, str, str]] = []

        def offer(i: int) -> None:
            j = after[i] if 0 <= i < n else n
            if j < n and piece[i] + piece[j] in self.scores:
                heapq.heappush(heap, (-self.scores[piece[i] + piece[j]][0], i, piece[i], piece[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if piece[i] != left or j >= n or piece[j] != right:
                continue
            piece[i], piece[j], after[i] = left + right, "", after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [self.scores[p][1] if p in self.scores else self.model.unknown for p in piece if p]

    def _spaced(self, cut: str, ids: list[int]) -> list[int]:
        """The ids of a cut with several leading markers, from the ids of its last marker and word."""
        run = len(cut) - len(cut.lstrip(MARK))
        alone = bool(ids) and self.pieces[ids[0]] == MARK
        return self.spaces(run if alone else run - 1) + ids[alone:]

    def learn(self, cuts: Iterable[str]) -> dict[str, bytes]:
        """The ids of each distinct cut. Cuts not met yet are encoded, decoded, and compared with the sentencepiece library."""
        met = dict.fromkeys(cuts)
        found = dict(zip(met, map(self.known.get, met)))
        new = [c for c, ids in found.items() if ids is None]
        if len(self.known) + len(new) > self.remembered:
            self.before, self.known = self.known, {}
        if self.before:
            again = {c: self.before[c] for c in new if c in self.before}
            found.update(again)
            self.known.update(again)
            new = [c for c in new if c not in again]
        for at in range(0, len(new), BATCH):
            fresh = self._encoded(new[at : at + BATCH])
            found.update(fresh)
            self.known.update(fresh)
        return found

    def _joined(self, words: list[str]) -> dict[str, bytes] | None:
        """The ids of words with a marker in front, JOINED of them encoded as one text; None if the ids do not part
        where the words do."""
        texts = [MARK + MARK.join(words[at : at + JOINED]) for at in range(0, len(words), JOINED)]
        ids = np.array([i for e in self.plain.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], np.int32)
        ends = np.cumsum(self.sizes[ids])
        wanted = np.cumsum(np.array([len(w) if w.isascii() else len(w.encode()) for w in words]) + len(MARK.encode()))
        last = np.searchsorted(ends, wanted)
        if last[-1] != len(ids) - 1 or not np.array_equal(ends[last], wanted):
            return None
        raw, edges = ids.tobytes(), [0, *((last + 1) * ids.itemsize).tolist()]
        return {word: raw[lo:hi] for word, lo, hi in zip(words, edges, edges[1:])}

    def _encoded(self, new: list[str]) -> dict[str, bytes]:
        words = [c for c in new if not c.startswith(MARK)] if self.worded else []
        if not words:
            return self._each(new)
        found = self._joined(words)
        if found is None:
            found = dict(zip(words, self._each([MARK + w for w in words]).values()))
        rest = [c for c in new if c.startswith(MARK)] if len(words) < len(new) else []
        return found | self._each(rest) if rest else found

    def _each(self, new: list[str]) -> dict[str, bytes]:
        core, run = new, MARK * 2
        spaced = [i for i, c in enumerate(new) if c.startswith(run)] if self.cuts and self.model.kind == MERGES else []
        if spaced:
            core = list(new)
            for i in spaced:
                core[i] = MARK + new[i].lstrip(MARK)
        found = [e.ids for e in self.plain.encode_batch_fast(core, add_special_tokens=False)]
        for i in spaced:
            found[i] = self._spaced(new[i], found[i])
        if not self.judged:
            return {cut: array("i", ids).tobytes() for cut, ids in zip(new, found)}
        texts = [c.removeprefix(MARK) if self.model.dummy_prefix else c for c in new]
        texts = [t.replace(MARK, " ") for t in texts]
        back = self.whole.decode_batch(found, skip_special_tokens=False)
        judged = self.judge.encode(texts, num_threads=1)
        if back != texts:
            self.lossy.update(cut for cut, text, again in zip(new, texts, back) if again != text)
        if judged != found:
            # the library writes nothing for an empty text, where a lone marker stands inside a longer one
            self.differing.update(cut for cut, text, ids, other in zip(new, texts, found, judged) if ids != other and text)
        return {cut: array("i", ids).tobytes() for cut, ids in zip(new, found)}

    def normalized(self, text: str) -> str:
        """The text as the rebuilt normaliser gives it; where that has no character map and keeps runs of
        spaces, it is the marker in front and in place of each space."""
        if self.model.charsmap or self.model.squeeze_spaces:
            return self.whole.normalizer.normalize_str(text)
        return (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text alone, without telling whether it comes back."""
        out = []
        for group in _grouped(texts):
            cuts = [self._words(t) or self._cut(self.normalized(t)) if t else [] for t in group]
            held = self.known
            fresh = self.learn(set(chain.from_iterable(cuts)).difference(held))
            if self.known is not held:  # the memory was full, and the cuts are dealt over old and new
                held = held | fresh
            out += [np.frombuffer(b"".join(map(held.__getitem__, row)), np.int32) for row in cuts]
        return out

    def _words(self, text: str) -> list[str]:
        """The words of a text with single spaces between them, which stand for its cuts; none for other texts."""
        if not self.worded or "  " in text or text[0] == " " or text[-1] == " " or MARK in text:
            return []
        return text.split(" ")

    def _cut(self, normal: str) -> list[str]:
        if not self.cuts:
            return [normal] * bool(normal)
        return (_MARKED if normal.startswith(MARK) else self.cuts).findall(normal)

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, bool, bool]]:
        """(ids, round trip is whole, equal to the sentencepiece library) of each text."""
        out = []
        for group in _grouped(texts):
            normal = [self.normalized(t) if t else "" for t in group]
            cuts = [self.cuts.findall(t) if self.cuts else [t] * bool(t) for t in normal]
            met = [list(map(self.known.get, row)) for row in cuts]
            missing = [cut for row, found in zip(cuts, met) if None in found for cut, ids in zip(row, found) if ids is None]
            fresh = self.learn(missing) if missing else {}
            for text, plain, row, found in zip(group, normal, cuts, met):
                if None in found:
                    found = [fresh[cut] if ids is None else ids for cut, ids in zip(row, found)]
                ids = np.frombuffer(b"".join(found), np.int32)
                whole = (not self.lossy or self.lossy.isdisjoint(row)) and self._comes_back(text, plain)
                equal = not self.differing or self.differing.isdisjoint(row)
                if self.judged and text and (self.model.charsmap or self.model.squeeze_spaces):
                    equal = self.judge.encode(text) == ids.tolist()
                out.append((ids, whole, equal))
        return out

    def _comes_back(self, text: str | None, normal: str) -> bool:
        """Whether the normalised text still tells the text: no marker of its own, nothing changed or joined."""
        return not text or MARK not in text and (normal.removeprefix(MARK) if self.model.dummy_prefix else normal).replace(MARK, " ") == text

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.whole.decode_batch([list(x) for x in ids], skip_special_tokens=False)


@cache
def codec(raw: bytes, judged: bool = True) -> Codec:
    # The library's pool would take a thread for every core of the machine in every worker; it reads this when it starts.
    os.environ.setdefault("RAYON_NUM_THREADS", THREADS)
    return Codec(raw, judged)


def model_bytes(path: str = MODEL_FILE) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str = MODEL_FILE) -> DataFrame:
    """Per row: doc_id, ids, n_tokens, round_trip, parity."""
    raw = model_bytes(path)

    def one(batch: pa.RecordBatch) -> dict:
        rows = codec(raw).encode(batch.column("text").to_pylist())
        sizes = [len(x[0]) for x in rows]
        flat = np.concatenate([x[0] for x in rows]) if rows else np.zeros(0, np.int32)
        return {
            "doc_id": batch.column("doc_id"),
            "ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat, pa.int32())),
            "n_tokens": pa.array(sizes, pa.int64()),
            "round_trip": pa.array([x[1] for x in rows], pa.bool_()), "parity": pa.array([x[2] for x in rows], pa.bool_()),
        }

    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_slices(picked, one, "doc_id long, ids array<int>, n_tokens long, round_trip boolean, parity boolean")


def encoder(path: str = MODEL_FILE) -> tuple[Callable[[list[str | None]], list[np.ndarray]], int, int]:
    """(texts -> ids of each, size of the vocabulary, the end id), without the comparisons of `encode`."""
    raw = model_bytes(path)
    pieces = [p for p, _, _ in parse_model(raw).pieces]
    end = pieces.index("</s>") if "</s>" in pieces else len(pieces)
    return (lambda texts: codec(raw, False).ids(texts)), len(pieces), end


def decode(encoded: DataFrame, path: str = MODEL_FILE) -> DataFrame:
    """Per row: doc_id, text; null ids give a null text."""
    raw = model_bytes(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column("ids").to_pylist()
                texts = codec(raw).decode([x or [] for x in ids])
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "text": pa.array([None if x is None else t for x, t in zip(ids, texts)], pa.string())})

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")
