"""Running streams and jobs: resumable runs, schedules, cancelling and progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.readwriter import DataStreamWriter


def run_available(writer: DataStreamWriter, timeout: int | None = None) -> StreamingQuery:
    """Process what has arrived since the last run and stop.

    The writer's checkpoint tells where the last run ended, also one that broke off.
    """
    query = writer.trigger(availableNow=True).start()
    if not query.awaitTermination(timeout) and timeout is not None:
        query.stop()
    return query


def run_every(writer: DataStreamWriter, interval: str) -> StreamingQuery:
    """Run at an interval; a run that is due while the one before still works is skipped, not queued."""
    return writer.trigger(processingTime=interval).start()


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs started inside can be stopped by :func:`cancel`."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Stop all running jobs of a tag; what they had written durably stays."""
    spark.sparkContext.cancelJobsWithTag(tag)


def in_stages(stages: list[tuple[str, Callable[[], object]]], stopped: Callable[[], bool] = lambda: False, report: Callable[[str, int, int], None] = lambda name, k, n: None) -> list[str]:
    """Run stages in order, reporting each before it begins, until all are done or ``stopped()`` says so between two; the names of those that ran."""
    done: list[str] = []
    for k, (name, work) in enumerate(stages):
        if stopped():
            break
        report(name, k + 1, len(stages))
        work()
        done.append(name)
    return done


class Progress(StreamingQueryListener):
    """Keeps the last ``keep`` progress reports (query, batch, rows) and the ends of queries."""

    def __init__(self, keep: int = 500):
        self.keep, self.reports, self.ended = keep, [], []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.reports = [*self.reports, (str(p.id), p.batchId, p.numInputRows)][-self.keep :]

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.append((str(event.id), event.exception))
