"""Search, grading and scans on worked inputs, whose results were found by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphspark.functions import scalars, text
from graphspark.operators import grading


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column).first()[0]


def test_tokens():
    assert text.tokenize("  A-b c_1 ") == ["a-b", "c_1"]
    assert text.tokenize("") == []
    assert set(text.tokenize("㐀一二")) == {"㐀一二", "㐀", "一", "二", "㐀一", "一二"}
    assert "一" not in text.tokenize("一二三四五") and "一二三四五" in text.tokenize("一二三四五")


@pytest.mark.parametrize(
    ("path", "query", "want"),
    [
        # a.b is a token of 3 characters: 28 + 7 in each form of the path, twice
        ("x/a.b/c", "a.b", 140),
        # only the raw path has the hyphen: 28 + 7 there, nothing in the other
        ("x/a-b/c", "a-b", 70),
        ("x/a.b/c", "", 0), ("x/a.b/c", "   ", 0), ("x/a.b/c", " A.B ", 140),
    ],
)
def test_path_scores(spark, path, query, want):
    assert one(spark, text.score_path(F.col("p"), query), p=path) == want


def test_text_scores(spark):
    # the whole query: 25 + 6; the: twice 7; of: once 6
    assert one(spark, text.score_text(F.col("t"), " The of "), t="the of the") == 31 + 14 + 6
    assert one(spark, text.score_text(F.col("t"), ""), t="the") == 0


def test_lines(spark):
    for t in ["", "a", "a\n", "a\r\nb\x0bc\x0cd\re", "\n\n", "a\x1cb\x1dc\x1ed\x1fe", "a\x85b\u2028c\u2029", "\n a"]:
        assert one(spark, text.lines(F.col("t")), t=t) == t.splitlines()


@pytest.mark.parametrize("path", ["a", "a/b.md", "a b/c", ".x", "a/...", "é/ü"])
def test_safe_paths(spark, path):
    assert one(spark, scalars.safe_path(F.col("p")), p=path)


@pytest.mark.parametrize("path", ["", ".", "..", "./a", "a/../b", "a//b", "/a", "a/", " a", "a ", "a\\b", "a\nb", "a/.", "\u00a0a"])
def test_unsafe_paths(spark, path):
    assert not one(spark, scalars.safe_path(F.col("p")), p=path)


def test_replay_terms():
    assert text.replay_terms("Which of ISO-1 or ISO-1?") == (set(), ["Which", "of", "ISO-1", "or", "ISO-1"])
    assert text.replay_terms("什么是功能安全评估") == ({"安全评", "全评估"}, [])  # 能 is left out
    assert text.replay_terms("x “abc defg” y 「短」")[1] == ["abc", "defg"]


def test_gold_hits_and_symbols(spark):
    hit = lambda t, *g: one(spark, text.gold_hit(F.col("t"), F.array(*map(F.lit, g))), t=t)
    assert hit("1.5 mm", "1.5") and not hit("1x5 mm", "1.5")  # a literal, not a pattern
    assert hit("see ISO/FDIS 26262", "ISO.*26262")
    assert hit("it is + here", "__PLUS__") and not hit("it is ++ here", "__PLUS__")
    assert hit("an o here", "__OH__") and not hit("so", "__OH__") and not hit("an O here", "__OH__") and hit("无倾向", "__OH__")
    assert not hit("anything")
    first = lambda t: one(spark, text.first_symbol(F.col("t")), t=t)
    assert [first(t) for t in ("a + then ++", "a ++ then +", "an O", "no symbol", "不支持也不反对 ++", "3+++")] == ["+", "++", "o", None, "o", "++"]


def test_grades(spark):
    items = [
        ("m1", "dry-methodcell", "q", ["++"], []), ("m2", "dry-methodcell", "q", ["__PLUS__"], []), ("m3", "dry-methodcell", "q", ["o"], []),
        ("t1", "trap", "q", ["not in the book"], ["never looked at"]), ("t2", "trap", "q" * 50, ["not in the book"], []),
        ("p1", "prose", "q", ["four", "4.*"], ["pump"]), ("p2", "prose", "q", ["five"], ["pump"]), ("p3", "prose", "q", ["six"], ["pump"]), ("p4", "prose", "q", ["seven"], []),
    ]
    answers = [
        ("m1", "a", 1, "it is ++, not +"), ("m2", "a", 1, "it is ++"), ("m3", "a", 1, "O says the table"), ("t1", "a", 1, "that is not in the book"), ("t2", "a", 1, "x" * 70),
        ("p1", "a", 2, "wrong"), ("p1", "b", 1, "it is 44, as for the pump"), ("p2", "a", 1, "the pump"), ("p3", "a", 1, ""), ("p9", "a", 1, "no item"),
    ]
    rows = grading.graded(spark.createDataFrame(items, "id string, cat string, q string, fact array<string>, case array<string>"), spark.createDataFrame(answers, "id string, file string, line int, answer string"))
    got = {r.cat: tuple(r)[1:] for r in grading.report(rows).collect()}
    # n, answered, fact, case, both
    assert got == {"dry-methodcell": (3, 3, 2, None, None), "trap": (2, 2, 1, 0, 0), "prose": (4, 2, 1, 2, 1), "total": (9, 7, 4, 2, 1)}
    fails = {tuple(r) for r in grading.failures(rows).collect()}
    assert fails == {("m2", "fact", "q", "it is ++"), ("t2", "trap-fabricated", "q" * 36, "x" * 60), ("p2", "fact", "q", "the pump")}


def test_what_must_not_be_published(spark):
    texts = [("a", "fine\nsee /Users/me/x\n"), ("b", "/Users/<you>/x and /home/ok"), ("c", "k\nx\x02\n\x03"), ("d", "sk-" + "a" * 19), ("e", "x sk-" + "a" * 20 + " AKIA" + "A" * 16), ("f", None), ("g", "")]
    got = {tuple(r) for r in grading.content_findings(spark.createDataFrame(texts, "path string, text string")).collect()}
    assert got == {("a", "macOS personal absolute path", 2), ("c", "invalid control character in text candidate", 2), ("e", "OpenAI-style secret token", 1), ("e", "AWS access key", 1)}
    paths = ["a/.env", ".env.example", ".env.x", "b/.DS_Store", "k.PEM", ".key", "a.b/private/c", "privately/x", "x/sources/raw", "a\tb", "a/id_rsa"]
    found = {tuple(r) for r in grading.path_findings(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert found == {
        ("a/.env", "credential/config filename"), (".env.x", "credential/config filename"), ("a/id_rsa", "credential/config filename"), ("b/.DS_Store", "OS metadata file"),
        ("k.PEM", "secret or generated binary suffix"), ("a.b/private/c", "private/session/generated path component"), ("x/sources/raw", "forbidden private evidence path"), ("a\tb", "control character in candidate path"),
    }
