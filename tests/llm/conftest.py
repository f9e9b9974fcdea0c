from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, key string, score double"


def words(rng: random.Random, n: int, size: int = 400) -> list[str]:
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    """Nulls, empty and long texts, repeated rows, copies, a large group of variants, benchmark passages."""
    rng = random.Random(5)
    base = words(rng, 120)
    texts: list[str | None] = [None, "", " \n\t ", "one two", "One  TWO", "a b c d e f", "Été À É élan É", "#$% *** ###\n\n***", " ".join(base)]
    for _ in range(40):
        changed = list(base)
        for _ in range(rng.randrange(1, 7)):
            at = rng.randrange(len(changed))
            if rng.random() < 0.3:
                del changed[at]
            else:
                changed[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(changed))
    for _ in range(25):
        texts.append(" ".join(words(rng, rng.randrange(20, 90))))
    texts += [texts[60], texts[60].upper(), " ".join(words(rng, 9000, 10**6)), "same line\nsame line\n" * 30]
    texts += ["start " + " ".join(f"q{i}" for i in range(14)) + " end", "Q0-q1, q2 q3 q4 q5 q6 q7 q8 q9 tail", "kurz und gut", "x q1 q2 q3"]
    out = [(i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], len(t or ""), 7, "k", 0.5) for i, t in enumerate(texts)]
    out += [out[20], (None, texts[60], "en", "a", 1, 7, "k", 0.5), (None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def items(spark):
    rows = [(1, " ".join(f"q{i}" for i in range(14)), "z"), (2, "Kurz, und", "z"), (3, None, "z"), (4, "...", "z"), (None, "x q1", "z"), (2, "Kurz, und", "z")]
    return spark.createDataFrame(rows, "item_id long, text string, len string")
