"""The encoder without comparisons gives the ids of the one with them."""

from __future__ import annotations

import numpy as np
from ledgerloom.llm import sentencepiece_codec


def test_ids_alone_are_those_of_encode():
    raw = sentencepiece_codec.model_bytes()
    texts = [None, "", " ", "  a  b ", "a  ", "▁x▁▁ y", "one two  three one", "语言 the\nend", "one two  three one"] * 2
    alone, judged = sentencepiece_codec.Codec(raw, False), sentencepiece_codec.Codec(raw)
    for part in (texts[:5], texts[5:], texts):
        got, want = alone.ids(part), [ids for ids, _, _ in judged.encode(part)]
        assert len(got) == len(want) and all(np.array_equal(a, b) for a, b in zip(got, want))


class Counted:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, inner):
        self.inner, self.texts = inner, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.inner.encode_batch_fast(texts, **options)


def test_new_cuts_are_encoded_many_at_once():
    raw = sentencepiece_codec.model_bytes()
    odd = ["<s>", "</s>", "<unk>", "<0x41>", "\U0001f642x", "语言\n", "\x00", "é ", "a▁b", "▁▁", "x" * 400]
    words = [f"w{i}o{i * i}" for i in range(640)] + [f"{a}{b}" for a in odd for b in odd]
    texts = [" ".join(words[at : at + 100]) for at in range(0, len(words), 100)] + ["  ".join(words[-60:]), words[5], "", None]
    want = [ids for ids, _, _ in sentencepiece_codec.Codec(raw).encode(texts)]
    alone = sentencepiece_codec.Codec(raw, False)
    alone.plain = counted = Counted(alone.plain)
    assert all(np.array_equal(a, b) for a, b in zip(alone.ids(texts[:6]), want))
    assert counted.texts < 600 / 4
    assert all(np.array_equal(a, b) for a, b in zip(alone.ids(texts), want))
    small, parted = sentencepiece_codec.Codec(raw, False), sentencepiece_codec.Codec(raw, False)
    small.remembered = 100  # full again and again, with cuts that move over
    parted.sizes = parted.sizes + 1  # ids that do not part where the cuts do
    for one in (small, parted):
        for part in (texts[:3], texts[2:5], texts, texts[::-1]):
            expected = [want[next(i for i, t in enumerate(texts) if t is x or t == x)] for x in part]
            assert all(np.array_equal(a, b) for a, b in zip(one.ids(part), expected))
