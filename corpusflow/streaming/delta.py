"""Incremental ingestion: a file stream whose batches run the same functions as batch jobs."""

from __future__ import annotations

import fcntl
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.sources.sinks import VersionedTable


@contextmanager
def only_one(path: str) -> Iterator[None]:
    """An exclusive lock; held by another, it is an error at once."""
    with open(path, "w") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError as e:
            raise RuntimeError("another sync is running") from e
        yield


def ingest(spark: SparkSession, source: str, schema: str, target: VersionedTable, checkpoint: str, keys: list[str], prepare: Callable[[DataFrame], DataFrame] = lambda df: df, order: list[str] | None = None) -> None:
    """All new files of `source`, merged by key into `target`, then an end. A rerun without new files does nothing.

    A batch is merged into a new version before the stream's offset moves on, so a failure repeats the batch; merging
    twice is merging once. Of a key's rows in one batch the last by the columns `order` wins; without an order they must
    be equal.
    """

    def merge(batch: DataFrame, _: int) -> None:
        target.merge(prepare(batch), keys, [F.col(c) for c in order] if order else None)

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def counted_by_window(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total): tumbling windows; on a stream, rows later than `late` are dropped."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
