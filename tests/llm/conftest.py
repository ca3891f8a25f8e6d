from __future__ import annotations

import random

import pytest

#: Nulls, empty and short texts, white space only, ties, repeats, one very long text.
ODD = [None, "", "a", "one two", " \t\n ", "Ünï cödé — 漢字 😀", "same words here " * 40, "same words here " * 40, "x" * 70_000, "\x1c odd \x85 space　s"]


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): random words, exact and near copies, shared passages, periodic texts."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeghinorstuü") for _ in range(rng.randint(2, 8))) for _ in range(4000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 160))) for _ in range(60)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts += [f"{t}\n{passage} {t[:50]}" for t in texts[:6]]
    texts += texts[10:14]
    for t in texts[20:26]:
        some = t.split()
        if len(some) > 8:
            some[len(some) // 2] = "changed"
        texts.append(" ".join(some))
    texts += ["na " * 200, "ab" * 300, passage.upper()]
    return [(k, t) for k, t in enumerate(ODD + texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")
