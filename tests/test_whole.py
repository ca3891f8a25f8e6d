"""Whole tables, not a prefix of their ids, against brute force."""

from __future__ import annotations

import hashlib
import random
from datetime import datetime, timedelta

import numpy as np

from .conftest import DATA, ROOT
from graphspark.domain import path_queries, text_queries
from graphspark.operators import temporal
from graphspark.registry import IDS, QUERIES


def test_context_of_every_document(spark):
    """Documents 50 and above have their lines too."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for doc, text in docs:
        at = text.splitlines()
        want |= {(doc, n): "|".join(at[max(0, n - 1) : n + 2]) for n in range(len(at))}
    got = {(r.doc_id, r.n): r.context for r in QUERIES["context_window_all"](spark, DATA).collect()}
    assert max(doc for doc, _ in got) >= 50
    assert got == want


def test_digest_of_every_document(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.sha for r in QUERIES["content_digest_all"](spark, DATA).collect()}
    assert max(got) >= 100
    assert got == {doc: hashlib.sha256(text.encode()).hexdigest() for doc, text in docs}


def test_overlaps_are_counted_whole(spark):
    """Close and far, equal and empty intervals, and one without an end."""
    pick, day = random.Random(7), datetime(2020, 1, 1)
    cut = [(pick.randint(0, 150), pick.choice([0, 0, 1, 5, 90])) for _ in range(200)]
    rows = [(day + timedelta(days=a), day + timedelta(days=a + n)) for a, n in cut] * 2
    want = sum(a[0] < b[1] and a[1] > b[0] for k, a in enumerate(rows) for b in rows[:k])
    df = spark.createDataFrame([*rows, (day, None)], "start timestamp, end timestamp")
    assert [int(r.pairs) for r in temporal.overlap_count(df).collect()] == [want]
    assert [int(r.pairs) for r in temporal.overlap_count(df.where("false")).collect()] == [0]


def test_range_join_takes_every_interval(spark, duck):
    sql = "SELECT epoch(least(o_orderdate, l_shipdate)) AS s, epoch(greatest(o_orderdate, l_shipdate)) AS e FROM lineitem JOIN orders ON o_orderkey = l_orderkey"
    s, e = (np.array(x) for x in zip(*duck.sql(sql).fetchall(), strict=True))
    want = sum(int(((s[k] < e[:k]) & (e[k] > s[:k])).sum()) for k in range(len(s)))
    assert [int(r.pairs) for r in QUERIES["range_join_all"](spark, DATA).collect()] == [want]


def _near(rows, asked, k=3):
    ids, e = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    out = set()
    for k_ in np.flatnonzero(np.isin(ids, asked)):
        sim = np.round(e @ e[k_], 5)
        out |= {(int(ids[k_]), int(ids[j]), f"{sim[j]:.5f}") for j in [j for j in np.lexsort((ids, -sim)) if ids[j] != ids[k_]][:k]}
    return out


def test_neighbours_of_every_hundredth_vector(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()
    asked = [r.vec_id for r in rows if r.vec_id % 100 == 0]
    assert len(asked) == 5 and max(asked) >= 5
    assert {(r.q, r.vec_id, str(r.sim)) for r in QUERIES["vector_topk_all"](spark, DATA).collect()} == _near(rows, asked)


def test_neighbours_over_several_blocks(spark, monkeypatch):
    """Equal vectors, which tie across blocks, and one without a direction."""
    monkeypatch.setattr(text_queries, "ASKED", 3)
    monkeypatch.setattr(text_queries, "SEARCHED", 7)
    pick = random.Random(3)
    rows = [(k, [1.0, 2.0, 3.0] if k % 4 == 0 else [pick.uniform(-1, 1) for _ in range(3)]) for k in range(60)]
    df = spark.createDataFrame([*rows, (60, [0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    got = {(r.q, r.vec_id, str(r.sim)) for r in text_queries.nearest(df, df.where("vec_id % 5 = 0")).collect()}
    assert got == _near(df.where("vec_id < 60").collect(), list(range(0, 60, 5)))


def test_third_hop_and_degree(spark):
    e = [("s1", "p1"), ("s1", "n1"), ("s2", "n1"), ("s2", "p2"), ("s1", "p3"), ("s3", "p3"), ("s3", "p4"), ("s1", "p1")]
    both = spark.createDataFrame([*e, *[(b, a) for a, b in e]], "src string, dst string")
    got = {(r.node, r.hops, r.degree) for r in path_queries.expand(both, "p1", 3).collect()}
    assert got == {("s1", 1, 3), ("n1", 2, 2), ("p3", 2, 2), ("s2", 3, 2), ("s3", 3, 2)}


def test_ledger_claims_nothing_absent():
    """What the ledger calls absent is no query's id."""
    rows = [line.split("|") for line in (ROOT / "COVERAGE.md").read_text().splitlines() if line.startswith("| ")]
    absent = {r[1].strip() for r in rows if r[2].strip() == "absent"}
    assert not absent & {i for ids in IDS.values() for i in ids}


def test_overlaps_are_counted_by_resource(spark):
    pick, day = random.Random(9), datetime(2020, 1, 1)
    rows = [(k % 4, day + timedelta(days=a), day + timedelta(days=a + n)) for k, (a, n) in enumerate((pick.randint(0, 150), pick.choice([0, 0, 1, 5, 90])) for _ in range(200))]
    want = {g: sum(a[0] == b[0] == g and a[1] < b[2] and a[2] > b[1] for k, a in enumerate(rows) for b in rows[:k]) for g in range(4)}
    df = spark.createDataFrame(rows, "g int, start timestamp, end timestamp")
    assert {r.g: int(r.pairs) for r in temporal.overlap_count(df, "g").collect()} == want
