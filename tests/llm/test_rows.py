"""TIFF pages, quality rules, severity, main text, and the pipeline."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest

from graphspark.llm import htmlcut, quality, queries, severity, tiff

from ..conftest import DATA


def test_op1(spark, docs, corpus, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in queries.op1_tiff_pages(spark, str(tmp_path)).collect()}
    assert len(rows) == len(corpus)
    for d, t in corpus:
        raw = (t or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = rows[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        media = tiff.encode_tiff(full)
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(media), hashlib.sha256(media).hexdigest(), tiff.feature(full))


@pytest.mark.parametrize("blocks", range(1, 36, 3))
def test_every_layout(blocks):
    rng = np.random.default_rng(blocks)
    payload = rng.integers(0, 256, 576 * blocks, dtype=np.uint8).tobytes()[: 576 * blocks // 2] + b"\7" * (576 * blocks - 576 * blocks // 2)
    pages = list(tiff.decode_pages(tiff.encode_tiff(payload)))
    assert b"".join(p["pixels"] for p in pages) == payload and not any(p["error"] for p in pages)


@pytest.mark.parametrize("size", [0, 1, 2, 300, 5000, 70_000])
def test_lzw_and_packbits(size):
    raw = (b"abcabc" * size)[:size] + np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(raw)) == raw
    assert tiff.packbits_decode(tiff.packbits_encode(raw, 64)) == raw


def test_big_endian_planes_of_16_bits():
    """Two planes of 3 x 2 samples of 16 bits, most significant byte first, differenced."""
    samples = np.array([[[1, 500], [2, 400], [4, 60000]], [[9, 1], [8, 2], [7, 3]]], np.uint16)
    planes = [samples[:, :, k].copy() for k in (0, 1)]
    for p in planes:
        p[:, 1:] = p[:, 1:] - p[:, :-1]
    data = [p.astype(">u2").tobytes() for p in planes]
    head = struct.pack(">2sHI", b"MM", 42, 8 + 24)
    at = 8 + 24 + 2 + 12 * 11 + 4
    entries = [(256, 3, 1, 3 << 16), (257, 3, 1, 2 << 16), (258, 3, 2, (16 << 16) | 16), (259, 3, 1, 1 << 16), (262, 3, 1, 1 << 16), (273, 4, 2, at), (277, 3, 1, 2 << 16), (278, 3, 1, 2 << 16), (279, 4, 2, at + 8), (284, 3, 1, 2 << 16), (317, 3, 1, 2 << 16)]
    body = struct.pack(">H", len(entries)) + b"".join(struct.pack(">HHII", *e) for e in entries) + b"\0" * 4
    media = head + data[0] + data[1] + body + struct.pack(">4I", 8, 20, 12, 12)
    (page,) = tiff.decode_pages(media)
    assert page["error"] is None
    assert (np.frombuffer(page["pixels"], ">u2").reshape(2, 3, 2) == samples).all()


def test_bad_media(spark):
    good = tiff.encode_tiff(b"x" * 576)
    loop = bytearray(good)
    struct.pack_into("<I", loop, len(loop) - 4, struct.unpack_from("<I", good, 4)[0])
    media = spark.createDataFrame([(1, None), (2, b"no"), (3, good[:-40]), (4, bytes(loop)), (5, good)], "doc_id long, media binary")
    rows = {r.doc_id: r for r in tiff.tiff_pages(media, keep=["doc_id"]).collect()}
    assert [bool(rows[k].error) for k in range(1, 6)] == [True, True, True, True, False]
    assert tiff.tiff_pages(media.limit(0), keep=["doc_id"]).count() == 0


def patched(media: bytes, tag: int, count: int | None = None, value: int | None = None, kind: int | None = None) -> bytes:
    """The first directory's entry of a tag with another count, value or type."""
    out = bytearray(media)
    (at,) = struct.unpack_from("<I", out, 4)
    for k in range(struct.unpack_from("<H", out, at)[0]):
        place = at + 2 + 12 * k
        if struct.unpack_from("<H", out, place)[0] == tag:
            for x, form, off in ((kind, "<H", 2), (count, "<I", 4), (value, "<I", 8)):
                if x is not None:
                    struct.pack_into(form, out, place + off, x)
    return bytes(out)


def test_every_broken_tag_is_told(spark):
    """Counts of nothing, values of nothing, values beyond the file, huge pages, and noise."""
    good, rng = tiff.encode_tiff(b"x" * 5760), np.random.default_rng(3)
    broken = [patched(good, tag, count=c, value=v) for tag in (256, 257, 258, 259, 273, 277, 278, 279, 317, 322, 323, 324, 325) for c, v in ((0, None), (None, 0), (1, 2**31), (2**31, None))]
    for _ in range(200):
        noise = bytearray(good)
        for place in rng.integers(0, len(good), 12):
            noise[place] = rng.integers(0, 256)
        broken.append(bytes(noise))
    for media in broken:
        for page in tiff.decode_pages(media):
            assert page["error"] is not None or page["pixels"] is not None
    assert any(p["error"] for p in tiff.decode_pages(patched(good, 278, value=0)))
    rows = tiff.tiff_pages(spark.createDataFrame([(k, m) for k, m in enumerate(broken[:40])], "doc_id long, media binary"), keep=["doc_id"]).collect()
    assert {r.doc_id for r in rows} == set(range(40))
    with pytest.raises(ValueError, match="page columns"):
        tiff.tiff_pages(spark.createDataFrame([(b"", 1)], "media binary, width int"), keep=["width"])


@pytest.mark.parametrize(("bits", "samples", "order"), [(32, 1, "<"), (32, 3, ">"), (16, 2, "<")])
def test_floating_point_predictor(bits, samples, order):
    """Written by hand: bytes by significance, then differenced, one row after the other."""
    values = np.random.default_rng(bits + samples).normal(0, 100, (3, 5, samples)).astype(f"f{bits // 8}")
    rows = []
    for row in values:
        planes = row.reshape(-1).astype(f">f{bits // 8}").view(np.uint8).reshape(-1, bits // 8).T.reshape(-1)
        rows.append(bytes((int(b) - (int(planes[k - samples]) if k >= samples else 0)) % 256 for k, b in enumerate(planes)))
    data = b"".join(rows)
    at = 8 + len(data) + len(data) % 2
    entries = [(256, 3, 1, 5), (257, 3, 1, 3), (258, 3, 1, bits), (259, 3, 1, 1), (262, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, samples), (278, 3, 1, 3), (279, 4, 1, len(data)), (317, 3, 1, 3), (339, 3, 1, 3)]
    pack = lambda kind, value: struct.pack(order + ("HH" if kind == 3 else "I"), *((value, 0) if kind == 3 else (value,)))
    body = struct.pack(order + "H", len(entries)) + b"".join(struct.pack(order + "HHI", t, k, n) + pack(k, v) for t, k, n, v in entries) + b"\0" * 4
    head = {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, at)
    (page,) = tiff.decode_pages(head + data + b"\0" * (len(data) % 2) + body)
    assert page["error"] is None
    assert (np.frombuffer(page["pixels"], f"{order}f{bits // 8}").reshape(values.shape) == values).all()


def test_quality_against_plain_python(spark, docs, corpus):
    import re

    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for d, t in corpus:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen: dict[tuple, list[int]] = {}
        for k in range(len(w) - 4):
            seen.setdefault(tuple(w[k : k + 5]), []).append(k)
        repeated = len({p for places in seen.values() if len(places) > 1 for k in places for p in range(k, k + 5)})
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeated)
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 10 or 100 * repeated > 20 * len(w))
        assert r.kept == (r.failed_rule is None) and not (r.base_failed and r.kept)


def test_order_of_rules_changes_nothing(docs):
    a = quality.judge(docs, list(quality.RULES)).select("doc_id", "kept")
    b = quality.judge(docs, list(quality.RULES)[::-1]).select("doc_id", "kept")
    assert a.exceptAll(b).isEmpty()


def test_greedy_order_is_conditional():
    """b rejects most, but of what a leaves only one document; c is dear."""
    found = [(0b011, 50), (0b001, 10), (0b010, 1), (0b100, 30), (0, 100)]
    assert quality.greedy(["a", "b", "c"], found, {"a": 1.0, "b": 1.0, "c": 5.0}) == ["a", "c", "b"]
    assert quality.greedy(["a", "b", "c"], found, {"a": 9.0, "b": 1.0, "c": 5.0}) == ["b", "c", "a"]
    assert quality.greedy(["a", "b"], [], {"a": 1.0, "b": 1.0}) == ["a", "b"]


def test_plan_of_a_sample(docs, nothing):
    assert sorted(quality.plan_cascade(docs)) == sorted(quality.RULES)
    assert quality.plan_cascade(nothing) == list(quality.RULES)


def test_keep_good_keeps_columns(spark, nothing):
    df = spark.createDataFrame([(1, "word " * 3, 1), (2, " ".join(f"word{k}" for k in range(40)), 2)], "doc_id long, text string, n_words int")
    out = quality.keep_good(df)
    assert out.columns == df.columns and [tuple(r) for r in out.select("doc_id", "n_words").collect()] == [(2, 2)]
    assert quality.keep_good(nothing).count() == 0
    assert quality.judge(nothing).count() == 0


def test_severity_on_held_out(spark):
    import random

    rng = random.Random(1)
    clean = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 8))) for _ in range(800)]
    bad = ["scumbag", "vilefoo", "vilebar"]
    rows = []
    for k in range(900):
        w = [rng.choice(clean) for _ in range(60)]
        if k % 5 == 0:
            for _ in range(rng.randint(1, 6)):
                w[rng.randrange(60)] = rng.choice(bad)
        rows.append((k, " ".join(w), int(k % 5 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows[:600]], "doc_id long, toxic int")
    model = severity.fit(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in severity.score(docs, model).collect()}
    held = rows[600:]
    assert sum(got[k].toxic == bool(y) for k, _, y in held) / len(held) > 0.98
    assert all(abs(r.severity) <= 2 for r in got.values())
    kept = severity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.toxic for r in got.values())


def test_likelihood_and_gradient():
    """Against the definition of the model, written out, and finite differences."""
    rng = np.random.default_rng(6)
    dense = rng.random((40, 5)) * (rng.random((40, 5)) < 0.4)
    row, column = np.nonzero(dense)
    x, y, weight = severity.Sparse(row, column, dense[row, column], 40, 5), rng.integers(0, 4, 40), rng.random(40) + 0.5
    par = rng.normal(0, 1, 5 + 3)

    def loss(par):
        th = [par[5], par[5] + np.exp(par[6]), par[5] + np.exp(par[6]) + np.exp(par[7])]
        out = 0.15 * (par[:5] ** 2).sum()
        for k in range(40):
            below = [0.0, *(1 / (1 + np.exp(dense[k] @ par[:5] - t)) for t in th), 1.0]
            out -= weight[k] * np.log(below[y[k] + 1] - below[y[k]])
        return out

    value, gradient = severity.loss_and_gradient(par, x, y, weight, 0.3)
    assert abs(value - loss(par)) < 1e-9
    steps = [(loss(par + 1e-5 * e) - loss(par - 1e-5 * e)) / 2e-5 for e in np.eye(8)]
    assert np.allclose(gradient, steps, atol=1e-6)
    weights, thresholds = severity.fit_ordinal(x, y, 4)
    assert len(weights) == 5 and (np.diff(thresholds) > 0).all()


def test_labels_of_unknown_documents_take_no_place(spark):
    text = lambda k: " ".join(f"w{k}{j}" for j in range(9)) + (" scumbag vilefoo" if k % 2 else " kind")
    docs = spark.createDataFrame([(k, text(k)) for k in range(400)], "doc_id long, text string")
    labels = spark.range(0, 40_000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    model = severity.fit(docs, labels, sample=200)
    assert {r.doc_id for r in severity.score(docs, model).collect() if r.toxic} == {k for k in range(400) if k % 2}


def test_severity_without_labels(spark, docs):
    model = severity.fit(docs, spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int"))
    rows = severity.score(docs, model).collect()
    assert not any(r.toxic for r in rows) and all(r.severity == 0 for r in rows)


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a = "<p>no</p>";</script></head><body>
<header class="site"><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice">We use cookies.</div>
<article><h1>Title &amp; more</h1><p>First&nbsp;paragraph of the   article,
over two lines.<p>Short.<br><p>Second <b>paragraph</b> with a <a href="x">link</a> in it, long enough.</article>
<aside>Related: other things</aside><section id="comments"><p>A reader says that this is a very good article indeed, and long too.</p></section>
<form><label>Name</label><input></form><footer>&copy; 2026</footer>"""


def test_main_text():
    assert htmlcut.main_text(PAGE) == "Title & more\nFirst paragraph of the article, over two lines.\nShort.\nSecond paragraph with a link in it, long enough."
    assert htmlcut.main_text(PAGE[: PAGE.index("Second")]).endswith("Short.")
    for page in (None, "", "   ", "<nav>x</nav>", "<", "</p></p>", "<script>only", "<!-- open", "<p"):
        assert htmlcut.main_text(page) == ""


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article class="article-with-sidebar"><p>These are the words of the article.</p></article>', "These are the words of the article."),
        ('<article class="story-alert-box"><p>These are the words of the article.</p></article>', "These are the words of the article."),
        ('<article class="comment"><p>A reader has this to say about it.</p></article>', ""),
        ('<div class="content-sidebar"><p>Other things that are worth a look.</p></div>', ""),
        ("<!--><article><p>These are the words of the article.</p></article>", "These are the words of the article."),
        ("<!-- a --!><article><p>These are the words of the article.</p></article>", "These are the words of the article."),
        ('<article><p class="x>These are the words of the article.</p></article>', "These are the words of the article."),
    ],
)
def test_odd_markup(page, want):
    assert htmlcut.main_text(f"<html><body>{page}</body></html>") == want


def test_large_pages_take_linear_time():
    import time

    took = []
    for n in (2000, 16_000):
        page = "".join(f"<div><p>Block {k} has some words in it</p></div>" if k % 3 else f"<div><a href=x>link {k}</a></div>" for k in range(n))
        began = time.process_time()
        htmlcut.main_text(page)
        took.append(time.process_time() - began)
    assert took[1] < 32 * took[0]


def test_fitted_weights():
    """Drawn to what was given; link text tells boilerplate where links are menus."""
    nav = "".join(f"<li><a href=x>Place {k}</a></li>" for k in range(6))
    page = f"<nav><ul>{nav}</ul></nav><article><p>This is a long paragraph of many words that goes on for a while.</p></article>"
    fitted = htmlcut.fit_weights([page] * 20)
    assert fitted[1] < htmlcut.GIVEN[1] and fitted[0] > 0
    assert htmlcut.fit_weights([page] * 20, pull=1e6) == pytest.approx(htmlcut.GIVEN, abs=1e-3)
    assert htmlcut.fit_weights([]) == htmlcut.fit_weights(["<nav>x</nav>"]) == htmlcut.GIVEN


def test_cut_of_real_blocks_against_all_labellings():
    """Costs and edges of whole small pages."""
    for k in range(3):
        page = PAGE.replace("<header", "<div><p>Some words.</p></div>" * k + "<header")
        blocks = htmlcut.blocks_of(page)[:13]
        gain, edges = [int(htmlcut.SCALE * htmlcut.log_odds(b)) for b in blocks], htmlcut.edges_of(blocks)
        n = len(gain)
        every = (np.arange(2**n)[:, None] >> np.arange(n)) & 1 == 1
        g = np.array(gain)
        costs = np.where(every, np.maximum(-g, 0), np.maximum(g, 0)).sum(axis=1) + sum(c * (every[:, a] != every[:, b]) for a, b, c in edges)
        keep = htmlcut.minimum_cut(gain, edges)
        assert costs[sum(1 << i for i, x in enumerate(keep) if x)] == costs.min()


def test_minimum_cut_against_all_labellings():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        gain = rng.integers(-20, 21, n).tolist()
        edges = [(int(a), int(b), int(c)) for a in range(n) for b in range(a) for c in [rng.integers(0, 12)] if c > 4]
        cost = lambda keep: sum(g for g, k in zip(gain, keep, strict=True) if g > 0 and not k) - sum(g for g, k in zip(gain, keep, strict=True) if g < 0 and k) + sum(c for a, b, c in edges if keep[a] != keep[b])
        least = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(2**n))
        assert cost(htmlcut.minimum_cut(gain, edges)) == least


CLASH = ["doc_id", "text", "ids", "start", "length", "kept", "bucket", "block", "media", "y", "h", "part", "shard", "n_words", "component_id", "signature", "grade", "_media", "_html"]


def test_clashing_columns_and_odd_rows(spark):
    """Columns with the names of results and inner columns, null ids, nulls, ties and empty
    texts: every operator gives a result for each row it is asked about."""
    text = " ".join(f"word{k}" for k in range(60))
    extra = CLASH[2:]
    rows = [(d, t, *[7] * len(extra)) for d, t in [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "x " * 3000)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in extra))
    labels = spark.createDataFrame([(1, 0, 5), (4, 1, 5), (None, 1, 5)], "doc_id long, toxic int, h int")
    from graphspark.llm import bpe, lpf, neardup, packing, substrings, token_store

    assert tiff.page_digests(tiff.tiff_pages(tiff.encode_documents(docs).selectExpr("*", "length(media) AS media_bytes", "sha2(media, 256) AS media_sha256"), "media", ["doc_id", "n_bytes", "media_bytes", "media_sha256"])).count() == 6
    assert quality.judge(docs).count() == 6
    assert substrings.dedup_passages(docs, counts=False).columns == docs.columns
    assert token_store.store_tokens(docs).count() == 6
    assert lpf.dedup_bytes(docs).count() == 6
    assert neardup.near_duplicates(docs).count() == 6
    assert neardup.keep_first(docs).columns == docs.columns
    assert {r.doc_id for r in packing.pack_documents(docs).collect()} == {-1, 1, 2, 3, 4}
    assert severity.score(docs, severity.fit(docs, labels)).count() == 6
    assert bpe.bpe_encode(docs, decode=True).count() == 6
    pages = docs.selectExpr("*", "doc_id AS page_id", "text AS url", "text AS html")
    assert htmlcut.extract_main_text(pages).count() == 6
    with pytest.raises(ValueError, match="name of the result"):
        htmlcut.extract_main_text(pages, keep=("text",))


def test_op9_frame(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    rows = htmlcut.extract_main_text(df).collect()
    assert sorted(len(r.text) for r in rows)[0] == 0 and len(rows) == 3
    assert htmlcut.extract_main_text(df.limit(0)).count() == 0


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    left = None
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert sorted(out.columns) == sorted(docs.columns), name
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert left is None or ids <= left
        left = ids
        docs = out
    pieces = pipeline.run(spark, DATA)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == left
