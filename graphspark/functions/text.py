"""Tokens, scores and matches of lexical search, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed by the search semantics: token characters, Han block, line ends, context lines looked at, hits per file.
TOKEN = r"[a-z0-9_+\-.]+"
HAN = "\u3400-\u9fff"
LINE_END = "\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x85\\u2028\\u2029]"
FIRST_LINES, MOST_HITS, NEAR_LINES = 200, 4, 2
#: Fixed values of the replay of retrieval: its Han block, the characters left out, its ASCII tokens, quoted text.
REPLAY_HAN, REPLAY_TOKEN, REPLAY_QUOTED = "一-鿿", r"[A-Za-z0-9.+\-]{2,}", "[「“]([^」”]{6,})[」”]"
REPLAY_STOP = "的了是什么怎么为什么请解释哪些一个这个它们和与在对有中里下从到被按能不吗呢多少分别指哪本书中出自答选项字母其"
#: Fixed values of grading: gold macros, and the symbols of a recommendation.
PLUS, OH = r"(?<![+])\+(?![+])", r"(?<![a-zA-Z])o(?![a-zA-Z])|无倾向|不支持也不反对"
SYMBOL = r"\+\+|(?<![+])\+(?![+])|(?<![a-zA-Z])[oO](?![a-zA-Z])|无倾向|不支持也不反对"


def lines(text: Column) -> Column:
    """The lines of a text; a last line end begins no line, and the empty text has none."""
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def tokenize(query: str) -> list[str]:
    """ASCII tokens of a query; its Han runs laid end to end give the whole, its 2- to
    4-grams, and single characters if it is no longer than 4.  Sorted and distinct."""
    low = query.strip().lower()
    out = set(re.findall(TOKEN, low))
    run = "".join(re.findall(f"[{HAN}]+", low))
    if run:
        out.add(run)
        for n in (2, 3, 4):
            out |= {run[k : k + n] for k in range(len(run) - n + 1)}
        if len(run) <= 4:
            out |= set(run)
    return sorted(out)


def occurrences(text: Column, term: Column) -> Column:
    """How often a term is found in a text without overlaps."""
    return F.when(F.length(term) == 0, 0).otherwise(((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.greatest(F.length(term), F.lit(1))).cast("long"))


def score_text(text: Column, query: str) -> Column:
    """25 + length for the whole query in the text, and for each term its count times
    4 + its length, which counts to 12 at most.  Spaces around the query don't count, and
    an empty one scores nothing."""
    low, whole = F.lower(text), query.strip().lower()
    out = F.when(low.contains(whole), 25 + len(whole)).otherwise(0).cast("long") if whole else F.lit(0).cast("long")
    for term in tokenize(query):
        out = out + occurrences(low, F.lit(term)) * (4 + min(len(term), 12))
    return out


def score_path(path: Column, query: str) -> Column:
    """Twice the scores of the path and of the path with _ and - as spaces."""
    return 2 * (score_text(path, query) + score_text(F.translate(path, "_-", "  "), query))


def replay_terms(question: str) -> tuple[set[str], list[str]]:
    """3-grams of Han segments without the characters left out, and ASCII tokens, as they
    are and as often as they are, of a question; text in quotes of six characters or more
    stands for it."""
    quoted = re.findall(REPLAY_QUOTED, question)
    text = " ".join(quoted) if quoted else question
    parts = re.findall(f"(?:(?![{REPLAY_STOP}])[{REPLAY_HAN}])+", text)
    return {x[k : k + 3] for x in parts for k in range(len(x) - 2)}, re.findall(REPLAY_TOKEN, text)


def replay_score(text: Column, question: str) -> Column:
    """How often a text has the grams of a question, and three times how often its tokens."""
    grams, tokens = replay_terms(question)
    out = F.lit(0).cast("long")
    for term, weight in [*((g, 1) for g in sorted(grams)), *((t, 3) for t in tokens)]:
        out = out + weight * occurrences(text, F.lit(term))
    return out


def gram_set(text: Column) -> Column:
    """ASCII tokens of two characters or more, and the 3-grams of Han runs."""
    runs = F.regexp_extract_all(text, F.lit(f"([{HAN}]+)"), F.lit(1))
    grams = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) < 3, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 2), lambda k: F.substring(r, k, F.lit(3))))))
    return F.array_distinct(F.concat(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]{2,})"), F.lit(1)), grams))


def gold_hit(text: Column, golds: Column) -> Column:
    """Whether a text has any of its golds: a macro, a pattern if it has .*, else a literal."""

    def one(gold: Column) -> Column:
        return F.when(gold == "__PLUS__", text.rlike(PLUS)).when(gold == "__OH__", text.rlike(OH)).when(gold.contains(".*"), F.rlike(text, gold)).otherwise(text.contains(gold))

    return F.coalesce(F.exists(golds, one), F.lit(False))


def first_symbol(text: Column) -> Column:
    """The first recommendation symbol, ++, + or o, where O and two phrases stand for o;
    null if there is none."""
    found = F.regexp_extract(text, f"({SYMBOL})", 1)
    return F.when(found == "", F.lit(None)).when(found.startswith("+"), found).otherwise("o")


def gold_symbol(golds: Column) -> Column:
    return F.when(F.array_contains(golds, "++"), "++").when(F.array_contains(golds, "__PLUS__"), "+").otherwise("o")
