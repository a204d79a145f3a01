"""Centroids of a stream of vectors: keyed state that expires."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "key string, n long, centroid array<double>, last_ts timestamp, expired boolean"


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ts, total, n) of each key of a batch, so that a key of most rows costs its task few."""
    for batch in batches:
        rows = batch.to_pandas()
        for key, part in rows.groupby("key", dropna=False):
            total = np.sum(np.stack(part["vector"].to_numpy()).astype(np.float64), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([None if pd.isna(key) else key], pa.string()), pa.array([part["ts"].max()], pa.timestamp("us", "UTC")), pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([len(part)], pa.int64())], ["key", "ts", "total", "n"])


def running_centroids(stream: DataFrame, key: str = "label", vector: str = "embedding", ts: str = "ts", lifetime: int = 600, delay: str = "0 seconds") -> DataFrame:
    """(key, n, centroid, last_ts, expired): after each batch the mean of all vectors of every key that the batch
    touched, from a sum and a count that are kept for it. A key that no row has touched for `lifetime` seconds of event
    time, by the watermark, is forgotten and given out once more, expired and without a centroid; later rows begin it
    anew. Null vectors and rows without a time do not count. To be written in update mode.
    """
    rows = stream.where(F.col(vector).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(vector).cast("array<double>").alias("vector"))
    parts = rows.mapInArrow(_partial, "key string, ts timestamp, total array<double>, n long").withWatermark("ts", delay)

    def update(of: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[2]
            state.remove()
            yield pd.DataFrame({"key": [of[0]], "n": [0], "centroid": [None], "last_ts": [pd.Timestamp(last, unit="us")], "expired": [True]})
            return
        total, n, last = state.get if state.exists else (None, 0, 0)
        total = None if total is None else np.array(total)
        for rows in batches:
            for t, m, at in zip(rows["total"], rows["n"], rows["ts"], strict=True):
                total = np.array(t, np.float64) + (0 if total is None else total)
                n, last = n + int(m), max(last, int(at.value // 1000))
        state.update((total.tolist(), n, last))
        state.setTimeoutTimestamp(max(last // 1000 + lifetime * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [of[0]], "n": [n], "centroid": [(total / n).tolist()], "last_ts": [pd.Timestamp(last, unit="us")], "expired": [False]})

    return parts.groupBy("key").applyInPandasWithState(update, _OUT, "total array<double>, n long, last long", "update", GroupStateTimeout.EventTimeTimeout)


def latest_centroids(updates: DataFrame) -> DataFrame:
    """(key, n, centroid) that stand after the last batch. updates: what the stream gave out, with its batch."""
    last = updates.groupBy("key").agg(F.max_by(F.struct("n", "centroid", "expired"), "batch").alias("u"))
    return last.where("not u.expired").select("key", "u.n", "u.centroid")
