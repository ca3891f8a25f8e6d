"""Every stage of the pipeline, as it is set up there, against a plain version."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest

from graphspark.llm import severity

from ..conftest import DATA
from .test_dedup import WORD, near_truth

pipeline = pytest.importorskip("corpus_pipeline")
P = pytest.importorskip("public_tokenizers")


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def good(text: str) -> bool:
    w, n_lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    if len(w) < 10:
        return False
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    seen = Counter(windows)
    if 100 * len({p for k, x in enumerate(windows) if seen[x] > 1 for p in range(k, k + 5)}) > 20 * len(w):
        return False
    chars, again = sum(map(len, w)), len(n_lines) - len(set(n_lines))
    kinds = Counter(unicodedata.category(c) for c in text)
    letters = sum(n for k, n in kinds.items() if k[0] == "L")
    return not (
        4 * len(re.findall(r"[#*$%&|<>]", text)) > len(w) or (10 * again > 3 * len(n_lines) and again >= 3)
        or chars > 25 * len(w) or 2 * chars < 3 * len(w) or 5 * kinds["Lu"] > 3 * chars or 2 * letters < chars
    )


def toxic(model: severity.Severity, text: str) -> bool:
    """By the names, weights and thresholds of the model alone."""
    words, z = re.findall(r"[^\W\d_]+", text.lower()), 0.0
    for name, weight in zip(model.names, model.weights, strict=True):
        n = sum(w == name[1:] if name[0] == "w" else len(w) > len(name) - 1 and w.startswith(name[1:]) for w in words)
        z += weight * math.log1p(n)
    return 1 / (1 + math.exp(min(60, max(-60, model.thresholds[0] - z)))) >= 0.5


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(pipeline.STAGES)
    texts = {d: r.text or "" for d, r in rows_of(docs).items()}

    model = severity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    now = stages["toxicity"](spark, docs, DATA)
    want = {d: t for d, t in texts.items() if not toxic(model, t)}
    assert {d: r.text or "" for d, r in rows_of(now).items()} == want

    now = stages["quality rules"](spark, now, DATA)
    want = {d: t for d, t in want.items() if good(t)}
    assert {d: r.text for d, r in rows_of(now).items()} == want and len(want) < len(texts)

    before = want
    now = stages["MinHash near-dedup"](spark, now, DATA)
    want = {d: before[d] for d, (_, _, first) in near_truth(before.items(), width=5).items() if first}
    assert {d: r.text for d, r in rows_of(now).items()} == want and len(want) < len(before)

    now = stages["substring dedup"](spark, now, DATA)
    split = {d: WORD.findall(t) for d, t in want.items()}
    seen = Counter(tuple(w[k : k + 35]) for w in split.values() for k in range(len(w) - 34))
    for d, w in split.items():
        gone = {p for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for p in range(k, k + 35)}
        want[d] = " ".join(x for p, x in enumerate(w) if p not in gone)
    got = rows_of(now)
    assert {d: r.text for d, r in got.items()} == want and now.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in got.values())

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    pieces: dict[int, list] = {}
    for r in stages["packing"](spark, now, DATA).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for d, t in want.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        at = sorted(pieces[d], key=lambda r: r.start)
        assert np.frombuffer(b"".join(bytes(r.ids) for r in at), "<u4").tolist() == ids
    assert set(pieces) == set(want)
