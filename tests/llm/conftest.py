from __future__ import annotations

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from siteloom.llm.queries import prepare, tokenizer  # noqa: E402

SMALL = "/root/testdata/sf0.001"
#: columns whose names the operators use inside
CLASHING = "row long, score string, kept string, bucket int, `a.b` int, block long, n int, component long"


@pytest.fixture(scope="session")
def ready(spark):
    return prepare(spark)


@pytest.fixture(scope="session")
def path():
    return tokenizer()


def odd_texts() -> list[tuple[int, str | None, str | None, str | None]]:
    """(doc_id, text, lang, source): copies, near copies, shared passages, ties, empty and very long texts, odd characters."""
    draw = random.Random(5)
    vocabulary = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8))) for _ in range(400)]

    def prose(n: int) -> list[str]:
        return [draw.choice(vocabulary) for _ in range(n)]

    texts: list[str | None] = [None, "", " \t\n", None, "", "a", "A", "a b c d", "A b\tC d", "one two three four five"]
    texts += ["", "12 34", "%%% $$$", "é", "日本 語 日本", "word\x0bword\x0cword\rword\x1cword word", "x\x00y z"]
    for size in (3, 5, 6, 7, 8, 9, 12, 20, 45, 80, 150, 400):
        base = prose(size)
        texts += [" ".join(base), " ".join(base).upper(), "\n".join(base), " ".join(base) + " "]
        for edits in (1, 1, 2, 3, size // 20 + 1, size // 10 + 1):
            near = base.copy()
            for _ in range(edits):
                at = draw.randrange(len(near) + 1)
                near[at : at + draw.randint(0, 1)] = [draw.choice(vocabulary)] * draw.randint(0, 1)
            texts.append(" ".join(near))
        chain = base.copy()
        for _ in range(5):
            chain[draw.randrange(size)] = draw.choice(vocabulary)
            texts.append(" ".join(chain))
    passage = prose(60)
    for _ in range(25):
        texts.append(" ".join(prose(draw.randint(0, 60)) + passage[: draw.choice([34, 35, 36, 60])] + prose(draw.randint(0, 60))))
    texts += ["tick tock " * 60, "tick tock " * 300, "same " * 34, "same " * 35, "same " * 36, "same " * 500]
    texts.append(" ".join(prose(40_000)))
    texts.append("unbroken" * 40_000)
    rows = [(i, t, ("en", "de", None)[i % 3], ("b", "a", None, "c", "a")[i % 5]) for i, t in enumerate(texts)]
    return rows + [rows[12], rows[60], rows[60]]


@pytest.fixture(scope="session")
def odd():
    return odd_texts()


@pytest.fixture(scope="session")
def docs(ready, odd):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING
    rows = [(i, t, lang, s, len(t or ""), 1, "x", "y", 2, 3, 4, 5, 6) for i, t, lang, s in odd]
    return ready.createDataFrame(rows, schema).repartition(7, "doc_id").cache()


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def small(ready):
    return ready.read.parquet(f"{SMALL}/documents.parquet")
