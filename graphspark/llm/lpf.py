"""Removal of repeated byte strings by longest-previous-factor arrays.

The longest previous factor of a place is the longest string that starts there and also
starts earlier.  In suffix order the two places that share most with a place among the
earlier ones are the nearest on either side whose positions are smaller: the previous and
the next smaller position.  So LPF = max(LCP with the one, LCP with the other).  A place
whose LPF reaches ``WINDOW`` bytes starts a repeated string, and its bytes are removed; the
first copy stays.

The array is built where it can matter, and in pieces:

1. A census of minimizers (the k-byte string of least hash in every window; equal windows
   have equal ones) tells which windows can have a copy at all.
2. Each block builds the LPF array of its own candidates.  Windows that have an earlier copy
   in the block are settled and go no further, so a hot passage leaves a block once.
3. What is left is cut into stretches of one minimizer and sent to its bucket, where all
   copies of a window meet.  The bucket builds the LPF array of its stretches, positions
   ordered by doc_id and start, and answers each block with the windows that have one.
   Beyond ``FAN`` blocks a window's copies meet in a bucket of their group of blocks first;
   the earliest one of a group goes on to a finer bucket that all groups share, so a hot
   passage reaches that one once per group.

Defined cases: a null or empty text, or one shorter than a window, keeps all its bytes;
repeated rows lose all but the first copy; rows that share a doc_id are ordered by their
block and row; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import FAN, MESSAGE_DDL, answered, bucket_of, census, deal, keyed, messages, over_blocks, text_blocks, with_answers
from .common import binary_column, column_bytes, release, stored
from .words import BYTE, mix, window_hashes

WINDOW, KMER, BLOCK_BYTES, SHORT = 100, 24, 2 << 20, 5
LARGEST = np.uint64(2**64 - 1)


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """min or max of every ``width`` neighbouring values."""
    out, span = values, 1
    while 2 * span <= width:
        out = pick(out[:-span], out[span:])
        span *= 2
    return pick(out[: len(values) - width + 1], out[width - span :]) if span < width else out


def in_order(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of keys of so many bits in the order of the keys, and these sorted.  Where a
    place fits beside its key in 64 bits, whole numbers are sorted, which is much faster."""
    room = max(1, (len(keys) - 1).bit_length())
    if bits + room > 64:
        order = np.argsort(keys)
        return order, keys[order]
    both = (keys << np.uint64(room)) | np.arange(len(keys), dtype=np.uint64)
    both.sort()
    return (both & np.uint64((1 << room) - 1)).astype(np.int64), both >> np.uint64(room)


def dense(keys: np.ndarray, bits: int) -> np.ndarray:
    """The rank of each key among the distinct ones."""
    order, sorted_ = in_order(keys, bits)
    step = np.zeros(len(keys), np.uint32)
    np.not_equal(sorted_[1:], sorted_[:-1], out=step[1:], casting="unsafe")
    out = np.empty(len(keys), np.uint32)
    out[order] = np.cumsum(step, dtype=np.uint32)
    return out


def ranks(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The rank of the first ``length`` bytes at each start among all of them, equal for
    equal strings, in suffix order.  Ranks of longer prefixes follow from those of shorter
    ones by sorting pairs.  ``data`` must hold ``length`` bytes after every start."""
    n = len(data)
    span = 1
    while 2 * span <= min(length, 4):
        span *= 2
    head = span
    wide = np.zeros(n + 8, np.uint8)
    wide[:n] = data
    first = np.empty(n, np.uint32)
    for k in range(4):  # four bytes from each place, the first one the most significant
        part = first[k::4]
        part[:] = wide[k : k + 4 * len(part)].view(">u4")
    steps = []  # spans of ranks and how far the second of a pair lies
    while span < length:
        steps.append((span, min(span, length - span)))
        span += steps[-1][1]
    # which places' ranks the next longer ranks refer to, from the last step backwards
    wanted = np.zeros(n, bool)
    wanted[starts] = True
    needs = [starts]
    for _, step in steps[::-1]:
        wanted = wanted.copy()
        wanted[step:] |= wanted[:-step].copy()
        needs.append(np.flatnonzero(wanted))
    needs = needs[::-1]
    now = dense((first[needs[0]] >> np.uint32(8 * (4 - head))).astype(np.uint64), 8 * head)
    for (_, step), held, at in zip(steps, needs[:-1], needs[1:], strict=True):
        rank = np.zeros(n, np.uint32)
        rank[held] = now
        bits = max(1, int(now.max(initial=0)).bit_length())
        now = dense((rank[at].astype(np.uint64) << np.uint64(bits)) | rank[at + step], 2 * bits)
    return now


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, or -1.  All places
    jump at once: over a neighbour that isn't smaller to that one's own."""
    out = np.arange(-1, len(values) - 1)
    todo = np.arange(1, len(values))
    while len(todo):
        todo = todo[(out[todo] >= 0) & (values[out[todo]] >= values[todo])]
        out[todo] = out[out[todo]]
    return out


def longest_previous_factor(data: np.ndarray, starts: np.ndarray, position: np.ndarray, most: int, exact: bool = False) -> np.ndarray:
    """The longest previous factor of each start, cut off at ``most`` bytes.  position: the
    starts' order, all different and below 2**32.  Unless ``exact``, a factor shorter than ``most`` is 0."""
    rank = ranks(data, starts, most)
    high, low = (max(1, int(x.max(initial=0)).bit_length()) for x in (rank, position))
    order, _ = in_order((rank.astype(np.uint64) << np.uint64(low)) | position.astype(np.uint64), high + low)
    sorted_rank = rank[order]
    if not exact:  # a string that no other start has can't reach ``most``
        twin = np.zeros(len(order) + 1, bool)
        np.equal(sorted_rank[1:], sorted_rank[:-1], out=twin[1:-1])
        some = np.flatnonzero(twin[1:] | twin[:-1])
        order, sorted_rank = order[some], sorted_rank[some]
    by_suffix = position[order]
    previous = nearest_smaller(by_suffix)
    following = len(order) - 1 - nearest_smaller(by_suffix[::-1])[::-1]
    best = np.zeros(len(order), np.int64)
    for other in (previous, following):
        there = (other >= 0) & (other < len(order))
        at = np.where(there, other, 0)
        same = there & (sorted_rank[at] == sorted_rank)
        best[same] = most
        if exact:
            for k in np.flatnonzero(there & ~same).tolist():
                a, b = starts[order[k]], starts[order[at[k]]]
                unlike = data[a : a + most] != data[b : b + most]
                best[k] = max(best[k], int(unlike.argmax()))
    out = np.zeros(len(starts), np.int64)
    out[order] = best
    return out


class ByteBlock:
    """The texts of a block as bytes, with the minimizer of every window."""

    def __init__(self, texts: pa.Array, window: int, kmer: int):
        self.data, self.offsets = column_bytes(texts)
        self.window, n = window, len(self.data)
        whole = np.zeros(n, bool)
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True):
            if b - a >= window:
                whole[a : b - window + 1] = True
        self.whole = whole[: max(0, n - window + 1)]
        self.width = window - kmer + 1
        if n >= window:
            self.kmers = mix(window_hashes(BYTE[self.data], kmer))
            self.least = sliding(self.kmers, self.width, np.minimum)
        else:
            self.kmers = self.least = np.zeros(0, np.uint64)

    def minimizers(self) -> np.ndarray:
        """The hash at every place that is the minimizer of a whole window."""
        if not self.whole.any():
            return np.zeros(0, np.uint64)
        seen = np.where(self.whole, self.least, np.uint64(0))
        edge = np.zeros(self.width - 1, np.uint64)
        most = sliding(np.concatenate([edge, seen, edge]), self.width, np.maximum)
        return spread_out(self.kmers[most == self.kmers])


def spread_out(minimizers: np.ndarray) -> np.ndarray:
    """Minimizers are small by choice; mixed again they fill the range that buckets divide."""
    return mix(minimizers + np.uint64(0xA0761D6478BD642F))


def runs_of(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of stretches of consecutive places."""
    if not len(places):
        return places, places
    cut = np.flatnonzero(np.diff(places) != 1) + 1
    first = np.concatenate([[0], cut])
    return places[first], np.diff(np.append(first, len(places)))


def gather(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all stretches laid end to end, and where each begins."""
    ends = np.cumsum(length)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - length), length)
    return data[at], ends - length


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1 ... of each stretch."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - count), count)


_HEAD = np.dtype([("doc", "<i8"), ("row", "<i4"), ("at", "<i4"), ("start", "<i4"), ("n", "<i4"), ("key", "<u4")])
STRETCH_DDL = "block long, bucket int, size int, blob binary"


def dedup_bytes(docs: DataFrame, window: int = WINDOW, kmer: int = KMER, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the remaining bytes of ``docs`` (doc_id, text)."""
    blocks = text_blocks(docs, "text", block_bytes)
    by_size = deal(blocks, 2, fan)
    buckets, groups = by_size.buckets, by_size.groups

    def send_minimizers(number: int, rows: pa.Table, _: list) -> Iterator[pa.RecordBatch]:
        h = ByteBlock(rows.column("text"), window, kmer).minimizers()
        distinct, bucket, _, _ = keyed(h, bucket_of(h, buckets), SHORT)
        yield messages(number, distinct, bucket, SHORT)

    first = census(over_blocks(blocks.select("block", "payload"), send_minimizers, MESSAGE_DDL), SHORT, by_size)

    def settle(number: int, rows: pa.Table, replies: list) -> Iterator[pa.RecordBatch]:
        block = ByteBlock(rows.column("text"), window, kmer)
        found = block.minimizers()
        distinct, bucket, times, _ = keyed(found, bucket_of(found, buckets), SHORT)
        shared = (times > 1) | answered(replies[0], bucket)
        # distinct values are in order within a bucket, buckets in order: one key finds them
        wanted = (bucket[shared].astype(np.uint64) << np.uint64(8 * SHORT)) | distinct[shared]
        twice = times[shared] > 1
        at = np.flatnonzero(block.whole)
        values = block.least[at]
        turn = np.ones(len(values), bool)
        turn[1:] = values[1:] != values[:-1]
        heads = np.flatnonzero(turn)
        mixed = spread_out(values[heads])
        keys = (bucket_of(mixed, buckets).astype(np.uint64) << np.uint64(8 * SHORT)) | (mixed & np.uint64(256**SHORT - 1))
        spot = np.searchsorted(wanted, keys)
        hit = np.zeros(len(heads), bool)
        ok = spot < len(wanted)
        hit[ok] = wanted[spot[ok]] == keys[ok]
        doubled = np.zeros(len(heads), bool)
        doubled[hit] = twice[spot[hit]]
        chosen = np.repeat(hit, np.diff(np.append(heads, len(values))))
        starts, values = at[chosen], values[chosen]
        ids = rows.column("doc_id").to_numpy()
        by_id = np.argsort(ids, kind="stable")
        before = np.empty(len(ids), np.int64)
        sizes = np.diff(block.offsets)[by_id]
        before[by_id] = np.cumsum(sizes) - sizes
        # empty texts begin where the next one does
        owner = np.searchsorted(block.offsets, starts, "right") - 1
        # only a minimizer that the block has twice can stand in two equal windows of it
        inner = np.flatnonzero(np.repeat(doubled, np.diff(np.append(heads, len(at))))[chosen])
        begin, count = runs_of(starts[inner])
        local, placed = gather(block.data, begin, count + window - 1)
        where = spread(placed, count)
        order = before[owner[inner]] + (starts[inner] - block.offsets[owner[inner]])
        again = np.zeros(len(starts), bool)
        again[inner] = longest_previous_factor(local, where, order, window) >= window
        settled = np.stack(runs_of(starts[again]), axis=1).astype("<i4").tobytes()
        names, blobs = [-1], [pa.compress(settled, "zstd", asbytes=True) if settled else b""]
        sizes = [len(settled)]
        starts, values, owner = starts[~again], values[~again], owner[~again]
        if len(starts):
            new = np.ones(len(starts), bool)
            new[1:] = (values[1:] != values[:-1]) | (starts[1:] != starts[:-1] + 1) | (owner[1:] != owner[:-1])
            head = np.flatnonzero(new)
            table = np.zeros(len(head), _HEAD)
            table["doc"], table["row"], table["at"] = ids[owner[head]], owner[head], starts[head]
            table["start"], table["n"] = starts[head] - block.offsets[owner[head]], np.diff(np.append(head, len(starts)))
            mixed = spread_out(values[head])
            table["key"], to = mixed.astype(np.uint32), bucket_of(mixed, buckets)
            by = np.argsort(to, kind="stable")
            table, to = table[by], to[by]
            cuts = np.append(np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])), len(to))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = table[a:b]
                raw = np.array([b - a], "<i4").tobytes() + part.tobytes() + gather(block.data, part["at"].astype(np.int64), part["n"].astype(np.int64) + window - 1)[0].tobytes()
                names.append(int(to[a]))
                sizes.append(len(raw))
                blobs.append(pa.compress(raw, "zstd", asbytes=True))
        yield pa.RecordBatch.from_arrays([pa.array([number] * len(names)), pa.array(names, pa.int32()), pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary())], ["block", "bucket", "size", "blob"])

    passed = stored(over_blocks(with_answers(blocks, first), settle, STRETCH_DDL), "stretches")

    def packed(block: int, bucket: int, raw: bytes) -> tuple[int, int, int, bytes]:
        return block, bucket, len(raw), pa.compress(raw, "zstd", asbytes=True) if raw else b""

    def meet(rows: pa.Table, last: bool = True) -> pa.Table:
        """For each block the windows that have an earlier copy among these stretches, and,
        unless this is the last meeting, stretches of those that have none."""
        numbers = rows.column("block").to_numpy()
        tables, texts = [], []
        for blob, size in zip(rows.column("blob"), rows.column("size").to_pylist(), strict=True):
            raw = pa.decompress(blob.as_buffer(), size, "zstd").to_pybytes()
            n = int(np.frombuffer(raw, "<i4", 1)[0])
            tables.append(np.frombuffer(raw, _HEAD, n, 4))
            texts.append(np.frombuffer(raw, np.uint8, offset=4 + n * _HEAD.itemsize))
        table, data = np.concatenate(tables), np.concatenate(texts)
        whose = np.repeat(np.arange(len(tables)), [len(t) for t in tables])
        count = table["n"].astype(np.int64)
        if int(count.sum()) >= 1 << 32:
            raise ValueError("a bucket holds more places than 32 bits can tell apart")
        length = count + window - 1
        placed = np.cumsum(length) - length
        where = spread(placed, count)
        # places in order of document and start; rows that share an id by block and row
        seq = np.lexsort((table["start"], table["row"], numbers[whose], table["doc"]))
        base = np.empty(len(seq), np.int64)
        base[seq] = np.cumsum(count[seq]) - count[seq]
        again = longest_previous_factor(data, where, spread(base, count), window) >= window
        stretch = np.repeat(np.arange(len(table)), count)
        # places lie in the order of their blocks
        hit = np.flatnonzero(again)
        spots, cuts = spread(table["at"].astype(np.int64), count)[hit], np.searchsorted(whose[stretch[hit]], np.arange(len(tables) + 1))
        out = [packed(int(numbers[k]), -1, np.stack(runs_of(spots[a:b]), axis=1).astype("<i4").tobytes()) for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
        if not last:
            # what is left, in stretches again
            left = np.flatnonzero(~again)
            new = np.ones(len(left), bool)
            new[1:] = (left[1:] != left[:-1] + 1) | (stretch[left[1:]] != stretch[left[:-1]])
            head = left[new]
            size = np.diff(np.append(np.flatnonzero(new), len(left)))
            rest = table[stretch[head]]
            off = where[head] - placed[stretch[head]]
            rest["at"], rest["start"], rest["n"] = rest["at"] + off, rest["start"] + off, size
            to = rows.column("bucket")[0].as_py() * groups + (rest["key"] % groups).astype(np.int64)
            by = np.lexsort((to, whose[stretch[head]]))
            rest, to, begin, block = rest[by], to[by], where[head][by], numbers[whose[stretch[head]]][by]
            cuts = np.append(np.flatnonzero(np.concatenate([[True], (to[1:] != to[:-1]) | (block[1:] != block[:-1])])), len(to)) if len(to) else np.zeros(1, np.int64)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                raw = np.array([b - a], "<i4").tobytes() + rest[a:b].tobytes() + gather(data, begin[a:b], rest["n"][a:b].astype(np.int64) + window - 1)[0].tobytes()
                out.append(packed(int(block[a]), int(to[a]), raw))
        release()
        return pa.Table.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["block", "bucket", "size", "blob"])

    answers, open_ = passed.where("bucket < 0"), passed.where("bucket >= 0")
    if groups > 1:
        first_met = stored(open_.withColumn("g", by_size.group()).groupBy("bucket", "g").applyInArrow(lambda rows: meet(rows, False), STRETCH_DDL), "stretches")
        answers, open_ = answers.unionByName(first_met.where("bucket < 0")), first_met.where("bucket >= 0")
    found = open_.groupBy("bucket").applyInArrow(lambda rows: meet(rows), STRETCH_DDL).unionByName(answers).where("size > 0")
    found = stored(found.groupBy("block").agg(F.collect_list(F.struct("size", "blob")).alias("answers")), "answers")

    def remove(number: int, rows: pa.Table, replies: list) -> Iterator[pa.RecordBatch]:
        data, offsets = column_bytes(rows.column("text"))
        marks = np.zeros(len(data) + 1, np.int64)
        for row in replies[0].as_py() or []:
            runs = np.frombuffer(pa.decompress(row["blob"], row["size"], "zstd"), "<i4").reshape(-1, 2).astype(np.int64)
            np.add.at(marks, runs[:, 0], 1)
            np.add.at(marks, runs[:, 0] + runs[:, 1] + window - 1, -1)
        gone = np.cumsum(marks[:-1]) > 0
        held = np.zeros(len(data) + 1, np.int64)
        np.cumsum(~gone, out=held[1:])
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        cuts = offsets[:-1][offsets[:-1] < len(data)]
        opens[cuts] = gone[cuts]
        spans = np.zeros(len(data) + 1, np.int64)
        np.cumsum(opens, out=spans[1:])
        kept = held[offsets]
        yield pa.RecordBatch.from_arrays([
            rows.column("doc_id").combine_chunks() if isinstance(rows.column("doc_id"), pa.Array) else rows.column("doc_id").chunk(0),
            pa.array(np.diff(offsets)), pa.array(np.diff(offsets) - np.diff(kept)), pa.array(np.diff(spans[offsets])), binary_column(data[~gone], kept),
        ], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return over_blocks(with_answers(blocks, found), remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
