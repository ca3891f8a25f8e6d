"""Repeated passages, previous factors and near duplicates against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphspark.llm import lpf, neardup, queries, substrings, superminhash, words
from graphspark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def saved(docs, tmp_path) -> str:
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_passages(spark, docs, corpus, tmp_path):
    split = {d: WORD.findall(t or "") for d, t in corpus}
    seen = Counter(tuple(w[k : k + 35]) for w in split.values() for k in range(len(w) - 34))
    want = {}
    for d, w in split.items():
        gone = {p for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for p in range(k, k + 35)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        want[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert any(n for _, n, _ in want.values())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op3_cover_anchors(spark, saved(docs, tmp_path)).collect()}
    assert got == want


@pytest.mark.parametrize("fan", [1, 3])
def test_groups_of_blocks_change_nothing(spark, docs, fan):
    """Many small blocks that meet in groups first, and in finer buckets then."""
    docs = docs.repartition(6, "doc_id")
    one = substrings.dedup_passages(docs)
    many = substrings.dedup_passages(docs, block_bytes=4000, fan=fan)
    assert one.where("n_removed > 0").count() and one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()
    one = lpf.dedup_bytes(docs)
    many = lpf.dedup_bytes(docs, block_bytes=4000, fan=fan)
    assert one.where("n_removed > 0").count() and one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


@pytest.mark.parametrize("window", [1, 2, 5, 8, 14, 21, 35, 50])
def test_covers_meet_at_every_distance(window):
    period, cover = substrings.cover_for(window)
    assert window - period + 1 >= 1
    for d in range(period):
        assert any((k + d) % period in cover for k in cover)


def test_passages_keep_columns(spark):
    rows = [(1, "a b c " * 20, 5), (1, "a b c " * 20, 6), (None, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    out = substrings.dedup_passages(df, counts=False)
    assert out.columns == df.columns and sorted(r.n_words for r in out.collect()) == [5, 6, 7]
    assert {r.n_words for r in substrings.dedup_passages(df).collect()} == {60, 0}


def test_previous_factors(spark, docs, corpus, tmp_path):
    seen, want = set(), {}
    for d, t in corpus:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            w = raw[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        want[d] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op5_previous_factors(spark, saved(docs, tmp_path)).collect()}
    assert got == want


def test_lpf_array_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(20):
        text = rng.integers(97, 100, 120).astype(np.uint8)
        most = int(rng.integers(1, 20))
        starts = np.arange(120 - most + 1)
        raw = text.tobytes()
        want = []
        for i in starts:
            same = lambda j, i=i: next((k for k in range(most) if raw[i + k] != raw[j + k]), most)
            want.append(max((same(j) for j in range(i)), default=0))
        assert lpf.longest_previous_factor(text, starts, starts, most, exact=True).tolist() == want


def test_nearest_smaller():
    v = np.random.default_rng(1).permutation(500)
    want = [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(500)]
    assert lpf.nearest_smaller(v).tolist() == want


def near_truth(corpus, width=2):
    low = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
    sets = {}
    for d, t in corpus:
        w = WORD.findall((t or "").translate(low))
        sets[d] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def test_near_duplicates(spark, docs, corpus, tmp_path):
    want = near_truth(corpus)
    assert any(not kept for _, _, kept in want.values())
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op6_superminhash(spark, saved(docs, tmp_path)).collect()}
    assert got == want


@pytest.mark.parametrize("block", [1, 3])
def test_blocks_of_a_group(spark, docs, corpus, block):
    """Blocks of few members give what one block gives."""
    want = {d: c for d, (_, c, _) in near_truth(corpus).items()}
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, width=2, block=block).collect()} == want


def test_a_large_group_with_a_chain_and_a_part_of_its_own(spark):
    """Near copies of one text, a chain of texts that leads away from it, and others that
    are candidates only."""
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(120)]

    def changed(text, m):
        out = list(text)
        for k in rng.choice(len(out), m, replace=False):
            out[k] = f"x{rng.integers(10**6)}"
        return out

    rows = [(k, changed(base, 2)) for k in range(40)]
    step = base
    for k in range(40, 52):
        step = changed(step, 4)
        rows.append((k, step))
    away = changed(base, 14)
    rows += [(k, changed(away, 2)) for k in range(52, 70)]
    corpus = [(k, " ".join(t)) for k, t in rows]
    want = {d: c for d, (_, c, _) in near_truth(corpus).items()}
    assert 1 < len(set(want.values())) < 40
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    for block in (5, 1000):
        assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df, width=2, block=block).collect()} == want


@pytest.mark.parametrize("share", range(20, 101, 5))
def test_banding_finds_the_similarity(share):
    bands, rows = neardup.banding(share)
    assert bands * rows <= neardup.SLOTS and (1 - (share / 100) ** rows) ** bands <= neardup.MISSED
    assert 1 <= neardup.least_equal(share, bands * rows) <= bands * rows


@pytest.mark.parametrize("share", [50, 80, 95])
def test_recall_just_above_the_threshold(spark, share):
    """Pairs whose similarity lies at most five hundredths above the asked one."""
    rng = np.random.default_rng(share)
    rows, want, k = [], {}, 0
    while len(want) < 200:
        n = int(rng.integers(60, 250))
        a = [f"w{x}" for x in rng.integers(0, 10**6, n)]
        at, m = int(rng.integers(0, n)), int(rng.integers(1, n // 2))
        b = [*a[:at], *(f"v{x}" for x in rng.integers(0, 10**6, m)), *a[at + m :]]
        x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
        if share <= 100 * len(x & y) / len(x | y) <= share + 5:
            rows += [(k, " ".join(a)), (k + 1, " ".join(b))]
            want[k + 1] = k
            k += 2
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), share=share).collect()}
    assert sum(got[b] == a for b, a in want.items()) >= 0.99 * len(want)


def test_forest_connects_what_the_matrix_connects():
    rng = np.random.default_rng(4)
    for _ in range(50):
        n = int(rng.integers(2, 30))
        near = rng.random((n, n)) < 1.2 / n
        near |= near.T
        np.fill_diagonal(near, False)
        u, v = neardup.forest(near, list(range(n)), np.arange(n))
        assert len(u) <= 2 * n and all(near[a, b] for a, b in zip(u, v, strict=True))
        reach = [near.astype(int) + np.eye(n, dtype=int), np.eye(n, dtype=int)]
        for a, b in zip(u, v, strict=True):
            reach[1][a, b] = reach[1][b, a] = 1
        full = [np.linalg.matrix_power(r, n) > 0 for r in reach]
        assert (full[0] == full[1]).all()


def test_keep_first_keeps_columns(spark):
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(3, text, "a"), (1, text + " more", "b"), (None, text, "c"), (4, None, "d"), (5, "", "e")], "doc_id long, text string, bands string")
    # the row without an id counts as -1 and stands for the group
    assert sorted(r.bands for r in neardup.keep_first(df).collect()) == ["c", "d", "e"]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**64, 1500, dtype=np.uint64)
    a, b = np.unique(pool[:1000]), np.unique(pool[200:1200])
    s = superminhash.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 512)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.08
    assert (superminhash.signatures(np.concatenate([a[::-1].copy(), b]), np.array([0, len(a), len(a) + len(b)]), 512) == s).all()


def test_words_at_borders():
    texts = [b" a  bc\n", b"", b"d", b"e f"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    starts, ends, first = words.word_spans(data, offsets)
    assert [bytes(data[s:e]) for s, e in zip(starts, ends, strict=True)] == [b"a", b"bc", b"d", b"e", b"f"]
    assert first.tolist() == [0, 2, 2, 3, 5]


def test_components_without_collecting(spark):
    edges = spark.range(1, 200).where("id % 20 <> 0").select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {k: (k - 1) // 20 * 20 + 1 for k in range(1, 201)}
    assert components(edges.where("false")).count() == 0


def test_empty_tables(nothing):
    assert substrings.dedup_passages(nothing).count() == 0
    assert lpf.dedup_bytes(nothing).count() == 0
    assert neardup.near_duplicates(nothing).count() == 0
