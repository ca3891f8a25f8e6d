"""Repeated passages of words, by difference-cover anchors.

Anchors are short windows of words that start at places whose number, modulo a period, lies
in a perfect difference set: whatever two places a long match has, some anchor lies at the
same distance from both its ends' starts.  So only a fraction |cover| / period of all
windows is hashed in the first census, and every match still shares an aligned anchor.
Where an anchor is found twice, the match is extended: the long windows around it are
hashed and counted in a second census.  A window found twice removes its words, all copies
included; windows are judged on the input.

Defined cases: a null or empty text has no words and an empty kept text; texts shorter than
a window keep all words; repeated rows repeat each other's windows, so they are removed; an
empty table gives an empty result; extra columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .blocks import BLOCK_BYTES, FAN, MESSAGE_DDL, answered, bucket_of, census, deal, keyed, messages, over_blocks, text_blocks, with_answers
from .common import binary_column, column_bytes
from .words import mix, prefix_sums, powers, word_hashes, word_spans

WINDOW = 35
#: Perfect difference sets: every difference modulo the period is that of one pair.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
ANCHOR, SECOND_BASE = 5, 0xD1342543DE82EF95
#: Anchors may be cut to 5 bytes, as a chance hit only adds work; windows are not.
SHORT, FULL = 5, 8


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The largest period that leaves anchors of 12 words, or of what the window has."""
    fit = [p for p in COVERS if window - p + 1 >= min(12, max(1, window // 2))]
    period = max(fit, default=1)
    return period, COVERS.get(period, (0,))


class WordBlock:
    """The words of a block's texts and their windows."""

    def __init__(self, texts: pa.Array, window: int):
        self.data, self.offsets = column_bytes(texts)
        self.starts, self.ends, self.first = word_spans(self.data, self.offsets)
        self.hashes = word_hashes(self.data, self.starts, self.ends)
        self.window = window
        self.counts = np.diff(self.first)
        n = len(self.hashes)
        #: Words from a place to the end of its text.
        self.left = np.repeat(self.first[1:], self.counts) - np.arange(n)
        self.sums = prefix_sums(self.hashes)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of anchors that a window of their text can hold."""
        period, cover = cover_for(self.window)
        width = self.window - period + 1
        n = len(self.hashes)
        chosen = np.zeros(period, bool)
        chosen[list(cover)] = True
        place = np.arange(n) - np.repeat(self.first[:-1], self.counts)
        at = np.flatnonzero(chosen[place % period] & (self.left >= width) & (self.left + place >= self.window))
        return at, mix((self.sums[at + width] - self.sums[at]) * powers(n + 1)[1][at])

    def candidates(self, at: np.ndarray) -> np.ndarray:
        """Starts of whole windows that hold one of the anchors at ``at``."""
        period, _ = cover_for(self.window)
        n = len(self.hashes)
        begin = np.maximum(at - (period - 1), np.repeat(self.first[:-1], self.counts)[at])
        marks = np.zeros(n + 1, np.int64)
        np.add.at(marks, begin, 1)
        np.add.at(marks, at + 1, -1)
        return np.flatnonzero((np.cumsum(marks[:-1]) > 0) & (self.left >= self.window))

    def windows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the windows at ``starts``."""
        n = len(self.hashes)
        one = mix((self.sums[starts + self.window] - self.sums[starts]) * powers(n + 1)[1][starts])
        sums = prefix_sums(self.hashes, SECOND_BASE)
        return one, mix((sums[starts + self.window] - sums[starts]) * powers(n + 1, SECOND_BASE)[1][starts])

    def kept(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of the kept words, joined by spaces, each text's offsets among them, and
        how many words of each text are removed.  repeated: starts of repeated windows."""
        n = len(self.hashes)
        marks = np.zeros(n + 1, np.int64)
        np.add.at(marks, repeated, 1)
        np.add.at(marks, repeated + self.window, -1)
        gone = np.cumsum(marks[:-1]) > 0
        lost = np.zeros(n + 1, np.int64)
        np.cumsum(gone, out=lost[1:])
        keep = np.flatnonzero(~gone)
        owner = np.repeat(np.arange(len(self.counts)), self.counts)[keep]
        edge = np.zeros(len(self.data) + 1, np.int8)
        edge[self.starts[keep]] += 1
        edge[self.ends[keep]] -= 1
        mask = np.cumsum(edge[:-1], dtype=np.int8) > 0
        follows = np.zeros(len(keep), bool)
        follows[:-1] = owner[1:] == owner[:-1]
        spaces = self.ends[keep[follows]]
        data = self.data.copy()
        data[spaces] = 32
        mask[spaces] = True
        held = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=held[1:])
        return data[mask], held[self.offsets], lost[self.first[1:]] - lost[self.first[:-1]]


def dedup_passages(docs: DataFrame, text_col: str = "text", window: int = WINDOW, counts: bool = True, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """The columns of ``docs`` with the text replaced by its kept words, joined by single
    spaces; with ``counts`` also n_words and n_removed (both long), in place of any columns
    of these names."""
    if counts:
        docs = docs.drop("n_words", "n_removed")
    blocks = text_blocks(docs, text_col, block_bytes)
    by = deal(blocks, fan=fan)
    buckets = by.buckets

    def flagged(block: WordBlock, answers: pa.Scalar) -> np.ndarray:
        at, h = block.anchors()
        _, bucket, times, place = keyed(h, bucket_of(h, buckets), SHORT)
        return at[((times > 1) | answered(answers, bucket))[place]]

    def send_anchors(number: int, rows: pa.Table, _: list) -> Iterator[pa.RecordBatch]:
        _, h = WordBlock(rows.column(text_col), window).anchors()
        distinct, bucket, _, _ = keyed(h, bucket_of(h, buckets), SHORT)
        yield messages(number, distinct, bucket, SHORT)

    first = census(over_blocks(blocks.select("block", "payload"), send_anchors, MESSAGE_DDL), SHORT, by)

    def windows(rows: pa.Table, answers: pa.Scalar) -> tuple:
        block = WordBlock(rows.column(text_col), window)
        starts = block.candidates(flagged(block, answers))
        one, two = block.windows(starts)
        return block, starts, keyed(one, bucket_of(two, buckets), FULL)

    def send_windows(number: int, rows: pa.Table, replies: list) -> Iterator[pa.RecordBatch]:
        _, _, (distinct, bucket, _, _) = windows(rows, replies[0])
        yield messages(number, distinct, bucket, FULL)

    second = census(over_blocks(with_answers(blocks, first), send_windows, MESSAGE_DDL), FULL, by)

    fields = docs.schema.fields
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in fields] + [T.StructField(n, T.LongType()) for n in ("n_words", "n_removed") if counts])

    def remove(number: int, rows: pa.Table, replies: list) -> Iterator[pa.RecordBatch]:
        block, starts, (_, bucket, times, place) = windows(rows, replies[0])
        twice = (times > 1) | answered(replies[1], bucket)
        data, offsets, removed = block.kept(starts[twice[place]])
        text = binary_column(data, offsets).cast(pa.string())
        out = [text if name == text_col else rows.column(name).combine_chunks() for name in rows.column_names]
        out = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in out]
        out += [pa.array(block.counts), pa.array(removed)] if counts else []
        yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return over_blocks(with_answers(blocks, first, second), remove, schema)
