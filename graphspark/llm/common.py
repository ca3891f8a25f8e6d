"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def setting(spark: SparkSession, key: str) -> str | None:
    value = spark.conf.get(key, None)
    return value if value is not None else spark.sparkContext.getConf().get(key, None)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, deleted when the driver ends.

    Where the setting is absent, a session on one machine (tests) gets a temporary folder,
    and any other an error.
    """
    base = setting(spark, "spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="graphspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later plans start from the
    files, so a lost executor never makes an upstream stage run again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def short_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Texts are long: fewer rows travel to Python at a time than Spark's default of 10,000."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), with a null text as the empty text and a null id as -1."""
    short_batches(docs.sparkSession)
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-1).cast("long")).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column and its int64 offsets, without copies."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offs - offs[0]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    return raw, offs - offs[0]


def binary_column(data: np.ndarray | bytes, offsets: np.ndarray) -> pa.Array:
    """A binary column over ``data`` cut at ``offsets``."""
    raw = data if isinstance(data, bytes) else np.ascontiguousarray(data).view(np.uint8)
    if len(raw) < 2**31:
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])
    wide = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)])
    return wide.cast(pa.binary())


def ids_column(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A list<int32> column over ``values`` cut at ``offsets``."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))


_batches = 0


def by_size(batch: pa.RecordBatch, column: str, most: int):
    """Slices of ``batch`` whose ``column`` holds about ``most`` bytes each, one row at least."""
    _, offs = column_bytes(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    global _batches
    _batches += 1
    if _batches % 16 == 0:  # memory given back must be asked for again: not every time
        release()


#: Bytes of input, as files hold them, that one range of doc_id takes at most on average.
RANGE = 64 << 20


def ranges(docs: DataFrame) -> int:
    """How many ranges of doc_id: the shuffle partitions, or more where the files read are
    larger than ``RANGE`` each.  Sizes are those of the plan, so nothing is read for it."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < 1 << 60  # what isn't known counts as nearly endless
    return max(1, partitions(docs.sparkSession), -(-size // RANGE) if known else 1)


def ordered_by_id(docs: DataFrame) -> DataFrame:
    """Documents dealt out into ranges of doc_id and sorted in each; partition order is id order.

    Equal ids are ordered by text, so that a partition is the same each time it is made.
    """
    return docs.repartitionByRange(ranges(docs), "doc_id").sortWithinPartitions("doc_id", "text")


def release() -> None:
    """Give freed memory back to the system: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
