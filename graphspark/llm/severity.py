"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Features are lower-case words and their first 4, 5 and 6 letters.  Those whose share among
toxic documents differs most surely from their share among clean ones (by the z value of
the log odds) are kept; their counts, as log(1 + n), are the inputs x.  The model has one
weight vector for all grades and ordered thresholds:

    P(grade <= k) = 1 / (1 + exp(w.x - t_k)),   t_0 < t_1 < ...

Grades of training documents: 0 clean; toxic ones are parted by the sum of their inputs at
the median into 1 (mild) and 2 (severe).  The expected grade is the severity; a document
is toxic if P(grade >= 1) reaches one half.

Training reads at most ``SAMPLE`` labelled toxic documents and twice as many clean ones of
those that ``docs`` holds, the ones with the least hash of doc_id, and keeps at most ``MOST`` features, so what reaches the driver and the
workers is bounded whatever the size of the input.  Every document is scored, whole.

Defined cases: a null or empty text has no feature and the severity of the bare thresholds;
repeated rows are scored each; a null doc_id counts as -1 and is never trained on; with no toxic or no clean label no document is toxic and
severity is 0; labels of unknown documents and null labels are not used; extra columns are
not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, documents, short_batches, stored

SAMPLE, MOST, SURE, STRONG, SLICE = 8000, 4096, 3.2, 4.0, 4 << 20
PREFIXES = (4, 5, 6)
GRADES = 3
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Severity:
    """A fitted model: feature names, their weights, and the thresholds."""

    names: list[str]
    weights: np.ndarray
    thresholds: np.ndarray

    def __post_init__(self) -> None:
        self.of_word = {n[1:]: i for i, n in enumerate(self.names) if n[0] == "w"}
        self.of_prefix = [(k, {n[1:]: i for i, n in enumerate(self.names) if n[0] == "p" and len(n) == k + 1}) for k in PREFIXES]

    def counts(self, text: str) -> dict[int, int]:
        """Feature counts of a text."""
        words = _WORD.findall(text.lower())
        out: Counter[int] = Counter()
        distinct = set(words)
        hits = distinct.intersection(self.of_word)
        if hits:
            for w in words:
                if w in hits:
                    out[self.of_word[w]] += 1
        for k, table in self.of_prefix:
            if table:
                starts = {w: table[w[:k]] for w in distinct if w[:k] in table and len(w) > k}
                if starts:
                    for w in words:
                        if w in starts:
                            out[starts[w]] += 1
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        z = np.zeros(len(texts))
        for row, text in enumerate(texts):
            for i, n in self.counts(text).items():
                z[row] += self.weights[i] * np.log1p(n)
        return z

    def grades(self, z: np.ndarray) -> np.ndarray:
        """P(grade = k) in column k."""
        upper = 1 / (1 + np.exp(np.clip(z[:, None] - self.thresholds, -60, 60)))
        return np.diff(np.concatenate([np.zeros((len(z), 1)), upper, np.ones((len(z), 1))], axis=1), axis=1)


#: Nothing is toxic.
NOTHING = Severity([], np.zeros(0), np.array([60.0, 120.0]))


def copy_key(text: str) -> int:
    """The least hash of the text's pairs of words: near copies mostly share it."""
    words = text.lower().split()
    return min((zlib.crc32(f"{a} {b}".encode()) for a, b in zip(words, words[1:], strict=False)), default=zlib.crc32(text.encode()))


def features(text: str) -> list[str]:
    words = set(_WORD.findall(text.lower()))
    out = ["w" + w for w in words]
    for k in PREFIXES:
        out += {"p" + w[:k] for w in words if len(w) > k}
    return out


@dataclass
class Sparse:
    """A matrix of n rows and d columns by its entries."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    n: int
    d: int

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.n)

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * g[self.row], self.d)


def thresholds_of(par: np.ndarray, d: int) -> np.ndarray:
    """The first threshold, and the others by the logarithms of the gaps between them."""
    return par[d] + np.concatenate([[0], np.cumsum(np.exp(par[d + 1 :]))])


def loss_and_gradient(par: np.ndarray, x: Sparse, y: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The weighted negative log likelihood with a ridge on the weights, and its gradient."""
    d = x.d
    th, z = thresholds_of(par, d), x.times(par[:d])
    ext = np.concatenate([[-np.inf], th, [np.inf]])
    hi, lo = ext[y + 1] - z, ext[y] - z
    s_hi, s_lo = 1 / (1 + np.exp(-np.clip(hi, -50, 50))), 1 / (1 + np.exp(-np.clip(lo, -50, 50)))
    s_hi[np.isposinf(hi)], s_lo[np.isneginf(lo)] = 1.0, 0.0
    p = np.maximum(s_hi - s_lo, 1e-12)
    d_hi, d_lo = s_hi * (1 - s_hi) / p * weight, s_lo * (1 - s_lo) / p * weight
    g_th = np.bincount(y, d_lo, len(th) + 1)[1:] - np.bincount(y, d_hi, len(th) + 1)[:-1]
    # a gap moves its own threshold and all above it
    above = np.cumsum(g_th[::-1])[::-1]
    gradient = np.concatenate([x.transposed_times(d_hi - d_lo) + ridge * par[:d], above[:1], above[1:] * np.exp(par[d + 1 :])])
    return float(-(weight * np.log(p)).sum() + ridge / 2 * (par[:d] ** 2).sum()), gradient


def fit_ordinal(x: Sparse, y: np.ndarray, grades: int = GRADES, ridge: float = 0.1, steps: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of most posterior likelihood, by gradient steps with
    adapted rates; rare grades weigh more."""
    n, d = x.n, x.d
    share = np.clip(np.cumsum(np.bincount(y, minlength=grades))[:-1] / n, 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    par = np.concatenate([np.zeros(d), [start[0]], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(par), np.zeros_like(par)
    weight = (n / grades / np.maximum(np.bincount(y, minlength=grades), 1))[y] ** 0.8
    for t in range(1, steps + 1):
        g = loss_and_gradient(par, x, y, weight, ridge)[1] / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        par = par - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return par[:d], thresholds_of(par, d)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = SAMPLE, most: int = MOST) -> Severity:
    """Fits on at most ``sample`` toxic and ``2 * sample`` clean labelled documents."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    marks = marks.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    marks = marks.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    chosen = marks.where("y = 1").orderBy("h", "doc_id").limit(sample).unionByName(marks.where("y = 0").orderBy("h", "doc_id").limit(2 * sample)).select("doc_id", "y")
    # at most 3 * sample rows of two numbers
    picked = {r.doc_id: r.y for r in chosen.collect()}

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [k for k, doc in enumerate(batch.column(0).to_pylist()) if doc in picked]
            if rows:
                some = batch.take(pa.array(rows))
                keys = [copy_key(text) for text in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(keys, pa.int64())], ["doc_id", "text", "key"])

    # near copies of a document would pass as independent witnesses: one of each group stays
    sampled = stored(documents(docs).mapInArrow(texts, "doc_id long, text string, key long"), "severity-sample")
    first: dict[tuple[int, int], int] = {}
    for row in sampled.select("doc_id", "key").collect():
        at = (picked[row.doc_id], row.key)
        first[at] = min(first.get(at, row.doc_id), row.doc_id)
    picked = {doc: y for (y, _), doc in first.items()}
    n1 = sum(picked.values())
    if not n1 or n1 == len(picked):
        return NOTHING
    n0 = len(picked) - n1
    labelled = sampled.select("doc_id", "text")

    def tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if doc in picked:
                    both[picked[doc]].update(features(text))
        names = list(both[0].keys() | both[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([both[0][x] for x in names], pa.int64()), pa.array([both[1][x] for x in names], pa.int64())], ["name", "c0", "c1"])

    tally = labelled.mapInArrow(tallies, "name string, c0 long, c1 long").groupBy("name").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    odds = F.log((F.col("c1") + 0.5) / (n1 + 1)) - F.log((F.col("c0") + 0.5) / (n0 + 1))
    z = odds / F.sqrt(1 / (F.col("c1") + 0.5) + 1 / (F.col("c0") + 0.5))
    # a feature that marks toxic documents is rare among clean ones
    kept = tally.where((F.col("c1") >= 3) & (odds >= STRONG)).withColumn("z", z).where(F.col("z") >= SURE).orderBy(F.desc("z"), "name").limit(most)
    names = [r["name"] for r in kept.collect()]
    if not names:
        return NOTHING
    blank = Severity(names, np.ones(len(names)), np.array([0.0, 1.0]))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = [(picked[doc], blank.counts(text)) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if doc in picked]
            yield pa.RecordBatch.from_arrays([
                pa.array([y for y, _ in chosen], pa.int32()),
                pa.array([list(c) for _, c in chosen], pa.list_(pa.int32())), pa.array([list(c.values()) for _, c in chosen], pa.list_(pa.int32())),
            ], ["y", "at", "times"])

    # at most 3 * sample short vectors
    rows = labelled.mapInArrow(vectors, "y int, at array<int>, times array<int>").collect()
    y = np.array([row.y for row in rows], np.int64)
    where = np.repeat(np.arange(len(rows)), [len(row.at) for row in rows])
    x = Sparse(where, np.array([k for row in rows for k in row.at], np.int64), np.log1p(np.array([n for row in rows for n in row.times], float)), len(rows), len(names))
    dose = x.times(np.ones(len(names)))
    bad = y == 1
    y[bad & (dose > np.median(dose[bad]))] = 2
    weights, thresholds = fit_ordinal(x, y)
    return Severity(names, weights, thresholds)


SCORE_DDL = "doc_id long, grade int, severity double, p_toxic double, toxic boolean"


def score(docs: DataFrame, model: Severity) -> DataFrame:
    """doc_id, most probable grade, expected severity, P(grade >= 1) and the verdict."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, "text", SLICE):
                p = model.grades(model.scores(batch.column(1).to_pylist()))
                bad = 1 - p[:, 0]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(np.round(p @ np.arange(p.shape[1]), 6)), pa.array(np.round(bad, 6)), pa.array(bad >= 0.5),
                ], ["doc_id", "grade", "severity", "p_toxic", "toxic"])

    return documents(docs).mapInArrow(scored, SCORE_DDL)


def drop_toxic(docs: DataFrame, model: Severity, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that the model doesn't call toxic."""
    short_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, text_col, SLICE):
                p = model.grades(model.scores([x or "" for x in batch.column(at).to_pylist()]))
                yield batch.filter(pa.array(1 - p[:, 0] < 0.5))

    return docs.mapInArrow(kept, docs.schema)
