"""Shards, packing and linear BPE against the public libraries."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers as P  # noqa: E402

from graphspark.llm import bpe, packing, token_store, units  # noqa: E402

POOL = "ab  \n\t\x1c\x85 'sé漢ßtion theing1234.,!😀́\r的日本語"


def noise(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_units_equal_library(name, spaced, corpus):
    enc = units.UnitEncoder(P.path(name), spaced)
    texts = [t or "" for _, t in corpus] + noise(800, 3)
    want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode_all(texts)] == want


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_columns_equal_library(name, spaced, corpus, monkeypatch):
    """Arrays and strings, known and new units, tables that overflow: all give the library's ids."""
    monkeypatch.setattr(units, "CACHE", 2000)
    enc = units.UnitEncoder(P.path(name), spaced)
    texts = [t or "" for _, t in corpus] + noise(400, 6) + ["", " ", "Don't!! l'été... a×b÷c éà.** (x)  ###", "Ünïcode,,  word\n\nÆon!?\t.", "\xa0", ""]
    want = [[*e.ids, 7] for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for k in range(0, len(texts), 97):
        for _ in range(2):
            ids, at = enc.encode_column(pa.array(texts[k : k + 97]), 7)
            assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want[k : k + 97]


def test_linear_bpe_equals_merges(corpus):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.LinearBpe(bpe.read_ranks(path), P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for text in [t or "" for _, t in corpus] + noise(800, 4) + ["".join(t.split()) for _, t in corpus[20:60]]:
        ids = own.encode(text)
        assert ids == lib.encode_ordinary(text)
        assert own.decode(ids) == text.encode()
    texts = [t or "" for _, t in corpus] + noise(300, 8)
    ids, at = own.encode_column(pa.array(texts), None)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == lib.encode_ordinary_batch(texts)


def grammar(ids, offsets, vocabulary):
    form = token_store.layout(vocabulary)
    shard = token_store.Shard(token_store.pack_shard(np.arange(len(offsets) - 1), ids, offsets, form))
    assert (shard.all() == ids).all() and shard.all().dtype == np.uint32
    lengths = [len(token_store.expand(np.array([form.first + k], form.kind), shard.rules, form.first)) for k in range(len(shard.rules))]
    assert lengths == shard.lengths.tolist()
    for row in range(len(offsets) - 1):
        part = ids[offsets[row] : offsets[row + 1]]
        assert (shard.document(row) == part).all()
        assert (shard.slice(row, len(part) // 3, len(part) // 2) == part[len(part) // 3 : len(part) // 3 + len(part) // 2]).all()
    return shard, form


@pytest.mark.parametrize(("alphabet", "vocabulary"), [(50, 50_257), (3, 100), (50, 70_000), (70_000, 70_001), (65_000, 65_536)])
def test_repair_round_trip_and_slices(alphabet, vocabulary):
    """Vocabularies beyond 16 bits, or that leave no room in them, get wider symbols."""
    rng = np.random.default_rng(1)
    ids = (vocabulary - 1 - rng.integers(0, alphabet, 20_000)).astype(np.uint32)
    offsets = np.sort(np.concatenate([[0, 0, 20_000], rng.integers(0, 20_000, 40)]))
    shard, form = grammar(ids, offsets, vocabulary)
    assert form.width == (2 if vocabulary < 60_000 else 4)
    if alphabet < 100:
        assert len(shard.rules) and len(shard.symbols) < 20_000


def test_repair_refuses_unknown_ids():
    with pytest.raises(ValueError, match="not below"):
        token_store.pack_shard(np.arange(1), np.array([5, 9], np.uint32), np.array([0, 2]), token_store.layout(9))
    with pytest.raises(ValueError, match="refers to itself"):
        token_store.expansion_lengths(np.array([[1, 9]]), 9)


@pytest.mark.parametrize("kind", ["run", "two", "copies", "words"])
def test_repair_ends_when_no_pair_pays(kind):
    """Afterwards no pair has as many uses, without overlap and within documents, as pay for a rule."""
    rng = np.random.default_rng(7)
    ids = {"run": np.zeros(5000), "two": np.tile([1, 2], 2500), "copies": np.tile(rng.integers(0, 900, 50), 100), "words": np.minimum(rng.zipf(1.3, 5000), 999)}[kind].astype(np.uint32)
    offsets = np.array([0, 1700, 1700, 3333, 5000])
    shard, form = grammar(ids, offsets, 1000)
    uses, last = {}, {}
    for row in range(4):
        symbols = shard.symbols[shard.starts[row] : shard.starts[row + 1]].tolist()
        for k, pair in enumerate(zip(symbols, symbols[1:], strict=False)):
            if last.get(pair) != (row, k - 1):
                uses[pair], last[pair] = uses.get(pair, 0) + 1, (row, k)
    assert max(uses.values(), default=0) < form.least


def test_store_tokens(spark, docs, corpus, nothing):
    enc = units.UnitEncoder(P.path("byte_bpe_50k.json"), True)
    start = 0
    got = {r.doc_id: r for r in token_store.store_tokens(docs).collect()}
    for doc, text in corpus:
        raw = enc.encode(text or "") + np.array([0], "<u4").tobytes()
        assert (got[doc].start, got[doc].n_tokens, bytes(got[doc].ids)) == (start, len(raw) // 4, raw)
        start += len(raw) // 4
    assert token_store.store_tokens(nothing).count() == 0


def brute_cuts(places, penalty, size, each=0):
    best = [0] + [10**9] * (len(places) - 1)
    for j in range(1, len(places)):
        for i in range(j):
            n = int(places[j] - places[i])
            if n <= size:
                pad = 0 if n & (n - 1) == 0 else size - n
                best[j] = min(best[j], best[i] + pad + each + int(penalty[j]))
    return best[-1]


def test_monotone_queue_equals_all_cuts():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(1, 160))
        ends = np.unique(np.append(rng.integers(1, n + 1, 4), n))
        places, penalty = packing.cut_places(n, ends, np.unique(rng.integers(1, n + 1, 12)), step=8)
        cuts = packing.best_cuts(places, penalty, 32, True)
        assert cuts[0] == 0 and cuts[-1] == len(places) - 1
        sizes = np.diff(places[cuts])
        cost = sum(0 if s & (s - 1) == 0 else 32 - s for s in sizes.tolist()) + int(penalty[cuts[1:]].sum())
        assert sizes.max() <= 32 and cost == brute_cuts(places, penalty, 32)
        dear = packing.best_cuts(places, penalty, 32, True, 6)
        sizes = np.diff(places[dear])
        cost = sum(6 if s & (s - 1) == 0 else 38 - s for s in sizes.tolist()) + int(penalty[dear[1:]].sum())
        assert len(dear) <= len(cuts) and cost == brute_cuts(places, penalty, 32, 6)


def test_sequences_are_nearly_as_few_as_can_be(spark):
    """Whole windows: at most two in a hundred sequences beyond ids / 2048, and little padding."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        rows = packing.pack_documents(docs).groupBy("sequence_id").agg({"length": "sum"}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    sizes = [r[1] for r in rows]
    least = -(-sum(sizes) // 2048)
    assert least <= len(sizes) <= 1.02 * least + 1
    assert sum(2048 - s for s in sizes if s & (s - 1)) < 0.02 * sum(sizes)


def test_pack_documents(docs, corpus, nothing):
    enc = units.UnitEncoder(P.path("word_bpe_49k.json"), False)
    rows = packing.pack_documents(docs).collect()
    whole: dict[int, list] = {}
    windows: dict[int, list] = {}
    for r in rows:
        whole.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    for doc, text in corpus:
        raw = enc.encode(text or "") + np.array([1], "<u4").tobytes()
        pieces = sorted(whole[doc], key=lambda r: r.start)
        assert b"".join(bytes(p.ids) for p in pieces) == raw
        assert [p.start for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
        assert {p.doc_tokens for p in pieces} == {len(raw) // 4}
    for pieces in windows.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
        assert sum(p.length for p in pieces) <= 2048
        assert [p.doc_id for p in pieces] == sorted(p.doc_id for p in pieces)
    assert packing.pack_documents(nothing).count() == 0


def test_bpe_frames(docs, corpus, nothing):
    coded = bpe.bpe_encode(docs, decode=True)
    assert {r.doc_id: bytes(r.decoded) for r in coded.collect()} == {d: (t or "").encode() for d, t in corpus}
    assert {r.doc_id: bytes(r.decoded) for r in bpe.bpe_decode(coded).collect()} == {d: (t or "").encode() for d, t in corpus}
    assert bpe.bpe_encode(nothing).count() == 0


def test_query_digests(spark, docs, corpus, tmp_path):
    import tiktoken

    from graphspark.llm import queries

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    enc = units.UnitEncoder(P.path("byte_bpe_50k.json"), True)
    got = {r.doc_id: r.ids_crc32 for r in queries.op4_repair_token_store(spark, str(tmp_path)).collect()}
    assert got == {d: zlib.crc32(enc.encode(t or "") + bytes(4)) for d, t in corpus}

    bare = units.UnitEncoder(P.path("word_bpe_49k.json"), False)
    whole = {d: bare.encode(t or "") + np.array([1], "<u4").tobytes() for d, t in corpus}
    pieces = queries.op7_pack_sequences(spark, str(tmp_path)).collect()
    assert sum(p.length for p in pieces) == sum(len(x) // 4 for x in whole.values())
    assert all(p.ids_crc32 == zlib.crc32(whole[p.doc_id][4 * p.start : 4 * (p.start + p.length)]) for p in pieces)

    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op10_linear_bpe(spark, str(tmp_path)).collect()}
    for d, t in corpus:
        ids = lib.encode_ordinary(t or "")
        assert rows[d] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
