"""Event-time windows: sessions, sliding windows, and a rule for rows that come late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", ts: str = "ts", value: str = "value", late: str = "10 minutes") -> DataFrame:
    """(key, session_start, session_end, n, total): runs of a key's rows with at most `gap` from each to the next; a
    session ends `gap` after its last row. Rows without a time are in none. On a stream a session is given out when the
    watermark, `late` behind the latest row, has passed its end."""
    source = events.withWatermark(ts, late) if events.isStreaming else events
    held = source.where(F.col(ts).isNotNull()).groupBy(key, F.session_window(ts, gap).alias("w"))
    return held.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "total")


def sliding(events: DataFrame, key: str, width: str = "1 hour", slide: str = "15 minutes", ts: str = "ts", value: str = "value", late: str = "10 minutes") -> DataFrame:
    """(key, window_start, n, total): windows of `width` that begin every `slide`; a row is in each that covers it."""
    source = events.withWatermark(ts, late) if events.isStreaming else events
    held = source.groupBy(key, F.window(ts, width, slide).alias("w"))
    return held.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total")).select(key, F.col("w.start").alias("window_start"), "n", "total")


class LateRows:
    """Splits a stream by a rule: a row is late if it is more than `delay` older than the latest row of the batches before.

    Tables under root, a folder a batch: `on_time`, `late`, and `high` with the latest time so far. A repeated batch
    writes its folders anew from the same `high`, so a restart in mid-batch leaves each row once. Rows without a time
    are late.
    """

    def __init__(self, spark: SparkSession, root: str, delay: str, ts: str = "ts"):
        self.spark, self.root, self.delay, self.ts = spark, root.rstrip("/"), delay, ts

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Takes all that is there, then ends; a later run goes on from the checkpoint."""
        self.schema = stream.schema
        stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def _batch(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        before = spark.read.schema("high timestamp").parquet(f"{self.root}/high/batch={batch - 1}").first().high if batch else None
        late = F.col(self.ts).isNull()
        if before is not None:
            late = late | (F.col(self.ts) < F.lit(before) - F.expr(f"interval {self.delay}"))
        held = rows.persist()
        try:
            held.where(~late).write.mode("overwrite").parquet(f"{self.root}/on_time/batch={batch}")
            held.where(late).write.mode("overwrite").parquet(f"{self.root}/late/batch={batch}")
            high = held.agg(F.greatest(F.max(self.ts), F.lit(before).cast("timestamp")).alias("high"))
            high.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/high/batch={batch}")
        finally:
            held.unpersist()

    def on_time(self) -> DataFrame:
        return self._table("on_time")

    def late(self) -> DataFrame:
        return self._table("late")

    def _table(self, name: str) -> DataFrame:
        """The rows with the number of their batch."""
        return self.spark.read.option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")
