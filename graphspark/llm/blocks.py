"""Blocks of documents and a census of hashes over all of them.

A block is one row that holds some megabytes of documents, compressed, and is written once,
so that every later pass sees the same documents in the same order.  In a census every block
sends its distinct hashes to buckets; a bucket answers each block with one bit per hash:
whether another block sent it too.  Messages hold sorted arrays, answers hold bits; no row
is made per hash, no pair of places is ever formed, and a hash that a third of all documents
hold reaches its bucket once per block.

Beyond ``FAN`` blocks these fall into groups of about so many.  A group has buckets of its
own, in which a common hash is met at most ``FAN`` times; what a group's bucket holds goes on
once, to finer buckets that all groups share, and their answers come back the same way.  So
the load of a bucket, and the number of messages of a block, stay as they are when the data
grow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_size, column_bytes, partitions, release, short_batches, stored
from .words import mix

BLOCK_BYTES, BUCKET_BYTES, FAN = 2 << 20, 8 << 20, 1024


@dataclass(frozen=True)
class Deal:
    """Into how many buckets hashes fall, and into how many groups blocks do."""

    buckets: int
    groups: int

    def group(self) -> Column:
        return F.pmod(F.xxhash64("block"), F.lit(self.groups)).cast("int").alias("g")


def pack(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for batch in batches:
            out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(payload: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(payload.as_buffer()).read_all().combine_chunks()


def text_blocks(docs: DataFrame, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, n_bytes, payload: the rows of ``docs``, all columns, in blocks of about
    ``block_bytes`` of text, in the order in which they are read; written once."""

    short_batches(docs.sparkSession)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        held: list[pa.RecordBatch] = []
        size = 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([size]), pa.array([pack(held)], pa.binary())], ["block", "n_bytes", "payload"])

        for whole in batches:
            at = whole.schema.get_field_index(text_col)
            for batch in by_size(whole, text_col, block_bytes // 8):
                held.append(batch)
                size += int(column_bytes(batch.column(at))[1][-1])
                if size >= block_bytes:
                    yield row()
                    number, held, size = number + 1, [], 0
        if held:
            yield row()

    return stored(docs.mapInArrow(blocks, "block long, n_bytes long, payload binary"), "blocks")


def deal(blocks: DataFrame, finer: int = 1, fan: int | None = None) -> Deal:
    """One group up to ``fan`` blocks, with some buckets per partition at least; beyond that a
    group's buckets follow from its own size.  There is a bucket for ``BUCKET_BYTES`` of text,
    or ``finer`` of them."""
    fan = FAN if fan is None else fan
    n, total = blocks.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    groups = max(1, -(-n // fan))
    least = 4 * partitions(blocks.sparkSession) if groups == 1 else 4
    return Deal(finer * max(least, -(-total // (groups * BUCKET_BYTES))), groups)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def keyed(values: np.ndarray, bucket: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (bucket, value) in order: values cut to ``width`` bytes, each one's bucket,
    how often it is found, and for every input its place among them."""
    cut = values if width == 8 else values & np.uint64(256**width - 1)
    order = np.argsort(cut, kind="stable")
    order = order[np.argsort(bucket[order], kind="stable")]
    v, b = cut[order], bucket[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (b[1:] != b[:-1])
    number = np.cumsum(new) - 1
    place = np.empty(len(v), np.int64)
    place[order] = number
    first = np.flatnonzero(new)
    return v[first], b[first], np.diff(np.append(first, len(v))), place


def messages(block: int, distinct: np.ndarray, bucket: np.ndarray, width: int) -> pa.RecordBatch:
    """One row for each bucket that a block has values for."""
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    raw = np.ascontiguousarray(distinct.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    ends = np.append(cuts, len(distinct)) * width
    values = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(cuts), block)), pa.array(bucket[cuts].astype(np.int32)), values], ["block", "bucket", "hashes"])


MESSAGE_DDL = "block long, bucket int, hashes binary"


def values_of(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all messages and how many each has."""
    raw = [np.frombuffer(x.as_buffer(), np.uint8) for x in rows.column("hashes")]
    sizes = np.array([len(x) // width for x in raw], np.int64)
    wide = np.zeros((int(sizes.sum()), 8), np.uint8)
    if len(wide):
        wide[:, :width] = np.concatenate(raw).reshape(-1, width)
    return wide.view("<u8").reshape(-1), sizes


def twins(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, each value's place among them, and which are found twice."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    place = np.empty(len(v), np.int64)
    place[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return v[first], place, np.diff(np.append(first, len(v))) > 1


def bits_of(found: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.cumsum(sizes)
    return pa.array([np.packbits(found[e - n : e]).tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary())


ANSWER_DDL = "block long, bucket int, bits binary"


def met(sent: DataFrame, width: int) -> DataFrame:
    """Messages answered in one bucket each: which values another message has too."""

    def answer(rows: pa.Table) -> pa.Table:
        values, sizes = values_of(rows, width)
        _, place, twice = twins(values)
        release()
        return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "bits": bits_of(twice[place], sizes)})

    return sent.groupBy("bucket").applyInArrow(answer, ANSWER_DDL)


def met_in_groups(sent: DataFrame, width: int, by: Deal) -> DataFrame:
    """The same by groups of blocks first."""
    n = by.groups
    sent = stored(sent, "messages").withColumn("g", by.group())

    def finer(distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order by the finer buckets, and where each of these ends."""
        sub = (mix(distinct) % np.uint64(n)).astype(np.int64)
        return np.argsort(sub, kind="stable"), np.searchsorted(np.sort(sub), np.arange(n), "right")

    def union(rows: pa.Table) -> pa.Table:
        distinct, _, _ = twins(values_of(rows, width)[0])
        order, ends = finer(distinct)
        raw = np.ascontiguousarray(distinct[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()
        begins = np.concatenate([[0], ends[:-1]])
        subs = np.flatnonzero(ends > begins)
        g, bucket = rows.column("g")[0].as_py(), rows.column("bucket")[0].as_py()
        release()
        return pa.table({
            "block": pa.array(np.full(len(subs), g)), "bucket": pa.array((bucket * n + subs).astype(np.int32)),
            "hashes": pa.array([raw[width * a : width * b] for a, b in zip(begins[subs].tolist(), ends[subs].tolist(), strict=True)], pa.binary()),
        })

    upper = met(sent.groupBy("bucket", "g").applyInArrow(union, MESSAGE_DDL), width)
    # a bucket of a group gets one short answer from each finer bucket
    back = upper.groupBy(F.floor(F.col("bucket") / n).cast("int").alias("bucket"), F.col("block").cast("int").alias("g")).agg(F.sort_array(F.collect_list(F.struct("bucket", "bits"))).alias("answers"))

    def settle(rows: pa.Table, answers: pa.Table) -> pa.Table:
        values, sizes = values_of(rows, width)
        distinct, place, twice = twins(values)
        order, ends = finer(distinct)
        for row in answers.column("answers")[0].as_py() if answers.num_rows else []:
            sub = row["bucket"] % n
            a, b = int(ends[sub - 1]) if sub else 0, int(ends[sub])
            twice[order[a:b]] |= np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=b - a).astype(bool)
        release()
        return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "bits": bits_of(twice[place], sizes)})

    return sent.groupBy("bucket", "g").cogroup(back.groupBy("bucket", "g")).applyInArrow(settle, ANSWER_DDL)


def census(sent: DataFrame, width: int, by: Deal) -> DataFrame:
    """Answers to messages: block and, by bucket, the bits of its values that other blocks
    sent too; one row per block, written to the shared folder."""
    answers = met(sent, width) if by.groups == 1 else met_in_groups(sent, width, by)
    return stored(answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "bits"))).alias("answers")), "answers")


def answered(answers: pa.Scalar, bucket: np.ndarray) -> np.ndarray:
    """For each distinct value of a block, in order, whether other blocks have it."""
    out = np.zeros(len(bucket), bool)
    if not answers.is_valid:
        return out
    for row in answers.as_py():
        a, b = np.searchsorted(bucket, [row["bucket"], row["bucket"] + 1])
        out[a:b] = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=b - a).astype(bool)
    return out


def with_answers(blocks: DataFrame, *replies: DataFrame) -> DataFrame:
    """Blocks with the answers of each census, as answers0, answers1 ..."""
    out = blocks.select("block", "payload")
    for k, reply in enumerate(replies):
        out = out.join(reply.select("block", F.col("answers").alias(f"answers{k}")), "block", "left")
    return out


def over_blocks(blocks: DataFrame, use: Callable[[int, pa.Table, list[pa.Scalar]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``use`` of every block's number, rows and answers, one block at a time."""
    extra = len(blocks.columns) - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from use(batch.column(0)[k].as_py(), unpack(batch.column(1)[k]), [batch.column(2 + e)[k] for e in range(extra)])
                release()

    return blocks.mapInArrow(run, schema)
