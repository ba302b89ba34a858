"""Streams: incremental upserts, event counts with watermarks, replay of an event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.keyed import latest, upsert
from ..sources.sinks import Snapshots


def upsert_stream(stream: DataFrame, target: str, keys: list[str], state: str, keep: list[str], order: list[str], checkpoint: str):
    """Apply each micro-batch to a versioned snapshot; of several rows of a key in a batch the latest counts."""

    def apply(batch: DataFrame, _: int) -> None:
        snaps = Snapshots(batch.sparkSession, target)
        rows = latest(batch, keys, order)
        stored = snaps.read()
        snaps.write(rows if stored is None else upsert(stored, rows, keys, state, keep).drop("change"))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per tumbling window and kind; on a stream, rows later than the watermark are dropped."""
    if events.isStreaming:
        events = events.withWatermark(at, late)
    return events.groupBy(F.window(at, width).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "kind", "n")


def first_seen_stream(events: DataFrame, keys: list[str], at: str, late: str = "1 day") -> DataFrame:
    """The first event of each key that arrives within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def replay(events: DataFrame, seq: str, after: int) -> DataFrame:
    """All events of an append-only log after a sequence number, in order."""
    return events.where(F.col(seq) > after).orderBy(seq)


def latest_events(events: DataFrame, seq: str, keep: int = 500) -> DataFrame:
    """The last ``keep`` events, as a ring buffer of that size would hold them."""
    return events.orderBy(F.col(seq).desc()).limit(keep)
