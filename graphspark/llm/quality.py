"""Quality rules as a short-circuit cascade, in DataFrame operations only.

Counts of words, symbols, repeated lines and repeated five-word windows are made for every
document.  The base rules follow from them; documents that pass go through a cascade of
further rules.  On a sample of about ``SAMPLE`` documents (hashes of doc_id below a share of
their range), never more than twice as many, one aggregate tells which rules reject together,
and each rule's time is that of ``REPEATS`` evaluations beyond that of a job without a rule.
The rule of most rejections per second comes first, then that of most rejections per second
among the documents that are left, and so on; a document leaves at the first rule that
rejects it, so the rules after it aren't evaluated.  The order changes the work, never the
verdict.

Defined cases: a null or empty text has no words and fails the base rules; repeated rows are
judged each; an empty table gives no row and leaves the rules in their written order; extra
columns are not read by ``judge`` and are kept as they are by ``keep_good``.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SAMPLE, REPEATS = 1000, 4
#: Fixed by the contract: words, and what counts as a symbol.
GAP, WORD, SYMBOL = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]", "[#*$%&|<>]"
WINDOW, FEWEST, MOST_REPEATED = 5, 10, 20

#: Further rules: name and what rejects, over the columns that ``measured`` makes.
RULES: dict[str, str] = {
    "symbols": "4 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines AND n_dup_lines >= 3",
    "word_length": "word_chars > 25 * n_words OR 2 * word_chars < 3 * n_words",
    "shouting": r"5 * regexp_count(text, '\\p{Lu}') > 3 * word_chars",
    "no_letters": r"2 * regexp_count(text, '\\p{L}') < word_chars",
}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is referred to."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of ``WINDOW`` words that is found twice or more."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twins(s: Column) -> Column:
            # items are read by place: functions that allow any place hold their arguments twice, nested ones ever more often
            before = lambda k: F.when(k > 0, s[k - 1]["h"])
            after = lambda k: F.when(k < F.size(s) - 1, s[k + 1]["h"])
            alike = lambda x, k: F.coalesce(x["h"] == before(k), F.lit(False)) | F.coalesce(x["h"] == after(k), F.lit(False))
            kept = F.filter(s, alike)
            return F.sort_array(F.transform(kept, lambda x: x["i"]))

        def length(places: Column) -> Column:
            steps = F.transform(places, lambda p, j: F.when(j < F.size(places) - 1, F.least(F.lit(WINDOW), places[j + 1] - p)).otherwise(WINDOW))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        # most documents have no window twice: they never sort
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(let(pairs, twins), length))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*(words[i + k] for k in range(WINDOW))))
    return F.when(F.size(words) < WINDOW, 0).otherwise(let(hashes, covered)).cast("long")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and the counts; ``_row`` holds the whole row as it came."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    split = base.withColumns({
        "words": F.filter(F.split("text", GAP), lambda w: w != ""),
        "lines": F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD)),
        "_at": F.spark_partition_id(),
    })
    # a filter on a count would be pushed below the words and split the text again for every
    # word; it stays here, as every count refers to a column that isn't deterministic
    once = lambda value: F.when(F.col("_at") >= 0, value)
    return split.select(
        "doc_id", "text", "_row",
        once(F.size("words").cast("long")).alias("n_words"),
        once(F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w))).alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        once(F.size("lines").cast("long")).alias("n_lines"),
        once((F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).alias("n_dup_lines"),
        once(repeated_words(F.col("words"))).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def plan_cascade(docs: DataFrame, rules: dict[str, str] = RULES, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """The names of the rules in the order of rejections per second on a sample."""
    share = min(1.0, sample / max(docs.count(), 1))
    some = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    some = some.where(F.pmod(F.xxhash64("doc_id"), F.lit(2**31)) < int(share * 2**31)).limit(2 * sample)
    facts = stored(measured(some).drop("_row").where(~base_failed()), "quality-sample")
    names = list(rules)
    bit = lambda k, rejects: F.when(F.expr(rejects), F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
    together = F.lit(0).cast("long")
    for k, name in enumerate(names):
        together = together + bit(k, rules[name])
    # at most as many rows as the sample has
    found = [(r["mask"], r["n"]) for r in facts.select(together.alias("mask")).groupBy("mask").agg(F.count("*").alias("n")).collect()]
    repeated = facts.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))
    idle = seconds(repeated, "length(text) < 0")
    return greedy(names, found, {name: max(seconds(repeated, rules[name]) - idle, 1e-4) for name in names}) if found else names


def seconds(rows: DataFrame, rejects: str) -> float:
    """Of evaluating a rule over the rows, when its code is compiled."""
    job = rows.agg(F.count_if(F.expr(rejects)))
    job.first()
    began = time.perf_counter()
    job.first()
    return time.perf_counter() - began


def greedy(names: list[str], found: list[tuple[int, int]], cost: dict[str, float]) -> list[str]:
    """Rules in the order of rejections per cost among what earlier rules leave.  found: how
    many documents each set of rules (bit k for the k-th name) rejects together."""
    order: list[str] = []
    while len(order) < len(names):
        rest = [k for k, name in enumerate(names) if name not in order]
        best = max(rest, key=lambda k: (sum(n for mask, n in found if mask >> k & 1) / cost[names[k]], -k))
        order.append(names[best])
        found = [(mask, n) for mask, n in found if not mask >> best & 1]
    return order


def verdict(order: list[str], rules: dict[str, str] = RULES) -> Column:
    """The first rule that rejects, null where none does."""
    chain = F.when(base_failed(), "base")
    for name in order:
        chain = chain.when(F.expr(rules[name]), name)
    return chain


def judge(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The counts, base_failed, kept and the rule that rejected, for every document."""
    order = plan_cascade(docs) if order is None else order
    return measured(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), verdict(order).alias("failed_rule"),
    ).withColumn("kept", F.col("failed_rule").isNull())


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that no rule rejects."""
    return measured(docs).where(verdict(plan_cascade(docs)).isNull()).select("_row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c >= 2),
cov AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep)) GROUP BY doc_id),
m AS (SELECT w.doc_id, w.text, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
    FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    4 * n_symbols > n_words OR (10 * n_dup_lines > 3 * n_lines AND n_dup_lines >= 3)
    OR word_chars > 25 * n_words OR 2 * word_chars < 3 * n_words
    OR 5 * len(regexp_extract_all(text, '\p{Lu}')) > 3 * word_chars OR 2 * len(regexp_extract_all(text, '\p{L}')) < word_chars AS rejected FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM b
"""
