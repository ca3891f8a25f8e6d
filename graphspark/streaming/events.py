"""Streaming twins: windowed counts with late data, and change streams through the gate.

Event time must be TIMESTAMP: a TIMESTAMP_NTZ column is cast first, in the session zone.
Latency is that of micro-batches, some hundred milliseconds at best; a budget of 100 ms from
end to end isn't met.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.shapes import Shape, route, validate
from ..sources.graphtext import patch


def window_counts(stream: DataFrame, time: str, keys: list[str], window: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts per window and keys; rows later than ``late`` are dropped by the watermark."""
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    counts = timed.groupBy(F.window("_t", window, slide), *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def session_counts(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.session_window("_t", gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def gate(current: Callable[[], DataFrame], shapes: list[Shape], accept: Callable[[DataFrame, int], None], isolate: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: changes are applied to a copy, the copy is validated, and
    subjects with a violation are isolated while the rest is accepted."""

    def batch(changes: DataFrame, epoch: int) -> None:
        new = patch(current(), changes)
        bad, _ = route(validate(new, shapes))
        bad = bad.withColumnRenamed("focus", "s")
        isolate(changes.join(bad, "s", "left_semi"), epoch)
        accept(changes.join(bad, "s", "left_anti"), epoch)

    return batch
