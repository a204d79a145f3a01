"""Streams: restarts, offsets of each kind, late rows, state that expires."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from corpusflow.sources import connector
from corpusflow.streaming import centroids, windows

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def items(spark, path, kind="number", order="item_id", streaming=True, **options):
    connector.register(spark)
    read = (spark.readStream if streaming else spark.read).format(connector.NAME).schema("item_id long, source string, ts timestamp")
    for k, v in {"path": path, "order": order, "kind": kind, "files_a_task": "1", **options}.items():
        read = read.option(k, v)
    return read.load()


def add(spark, rows, path):
    spark.createDataFrame(rows, "item_id long, source string, ts timestamp").repartition(2).write.mode("append").partitionBy("source").parquet(path)


def drain(stream, checkpoint, sink):
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


@pytest.mark.parametrize(("kind", "order"), [("number", "item_id"), ("time", "ts")])
def test_a_restart_in_mid_batch_gives_each_item_once(spark, tmp_path, kind, order):
    path, out, check = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check"
    add(spark, [(i, "jira" if i % 2 else "mail", at(i)) for i in range(10)], path)
    sink = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")
    drain(items(spark, path, kind, order), check, sink)
    add(spark, [(i, "jira" if i % 2 else "chat", at(i)) for i in range(10, 30)], path)

    def broken(rows, batch):
        sink(rows.limit(5), batch)
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        drain(items(spark, path, kind, order), check, broken)
    add(spark, [(40, "jira", at(40))], path)  # comes while the batch is open
    drain(items(spark, path, kind, order), check, sink)
    drain(items(spark, path, kind, order), check, sink)
    got = sorted((r.item_id, r.source, r.ts) for r in spark.read.parquet(out).drop("batch").collect())
    naive = lambda t: t.replace(tzinfo=None)
    assert [(i, s) for i, s, _ in got] == sorted([(i, "jira" if i % 2 else "mail") for i in range(10)] + [(i, "jira" if i % 2 else "chat") for i in range(10, 30)] + [(40, "jira")])
    assert all(naive(t) == naive(at(i)) for i, _, t in got)


def test_batch_reads_after_offsets(spark, tmp_path):
    path = str(tmp_path / "in")
    add(spark, [(i, "ab"[i % 2], at(i)) for i in range(20)], path)
    got = lambda offsets, at_path=path, **k: sorted(r.item_id for r in items(spark, at_path, streaming=False, offsets=json.dumps(offsets), **k).collect())
    assert got({}) == list(range(20))
    assert got({"a": 9}) == [i for i in range(20) if i % 2 or i > 9]
    assert got({"a": at(10).isoformat(), "b": at(99).isoformat()}, kind="time", order="ts") == [12, 14, 16, 18]
    assert got({"a": 100, "b": 100}) == [] and got({}, str(tmp_path / "none")) == []


def test_pages_by_token(spark, tmp_path):
    """Pages are read once each, by the names of their files."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch, names in enumerate((["p01", "p02"], ["p03"])):
        for n in names:
            folder = f"{tmp_path}/{n}"
            spark.createDataFrame([(int(n[1:]), at(0))], "item_id long, ts timestamp").coalesce(1).write.parquet(folder)
            (tmp_path / "in" / "source=drive").mkdir(parents=True, exist_ok=True)
            next((tmp_path / n).glob("*.parquet")).rename(tmp_path / "in" / "source=drive" / f"{n}.parquet")
        drain(items(spark, path, "token"), f"{tmp_path}/check", lambda rows, b: rows.write.mode("overwrite").parquet(f"{out}/batch={b}"))
        assert sorted((r.item_id, r.batch) for r in spark.read.parquet(out).collect()) == [(1, 0), (2, 0), (3, 1)][: 2 + batch]


def test_late_rows_and_a_repeated_batch(spark, tmp_path):
    schema, path = "id long, ts timestamp", f"{tmp_path}/in"
    split = windows.LateRows(spark, f"{tmp_path}/out", "10 minutes")
    for rows in ([(1, at(0)), (2, at(3600)), (3, None)], [(4, at(3000)), (5, at(2999)), (6, at(9000))], [(7, at(8400)), (8, at(8399))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        split.run(spark.readStream.schema(schema).parquet(path), f"{tmp_path}/check")
    ids = lambda df: sorted((r.id, r.batch) for r in df.collect())
    assert ids(split.on_time()) == [(1, 0), (2, 0), (4, 1), (6, 1), (7, 2)] and ids(split.late()) == [(3, 0), (5, 1), (8, 2)]
    split._batch(spark.createDataFrame([(7, at(8400)), (8, at(8399))], schema), 2)  # as after a restart
    assert ids(split.on_time()) == [(1, 0), (2, 0), (4, 1), (6, 1), (7, 2)] and ids(split.late()) == [(3, 0), (5, 1), (8, 2)]


def test_sessions_on_a_stream(spark, tmp_path):
    """A session is given out when the watermark has passed its end; rows exactly the gap apart are in one."""
    schema, path = "user_id long, ts timestamp, value double", f"{tmp_path}/in"
    rows = [(1, 0), (1, 600), (1, 2400), (2, 100), (1, 2400 + 1800 + 1), (2, 100_000)]
    for r in rows:
        spark.createDataFrame([(r[0], at(r[1]), 1.0)], schema).coalesce(1).write.mode("append").parquet(path)
    stream = windows.sessions(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), "user_id", late="10 minutes")
    stream.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    shown = lambda df: sorted((r.user_id, r.session_start, r.n) for r in df.collect())
    whole = shown(windows.sessions(spark.createDataFrame([(u, at(s), 1.0) for u, s in rows], schema), "user_id"))
    assert shown(spark.read.parquet(f"{tmp_path}/out")) == [r for r in whole if r[1] < at(100_000).replace(tzinfo=None)]
    assert [n for _, _, n in whole] == [3, 1, 1, 1]


def test_centroids_expire(spark, tmp_path):
    schema, path, out = "label int, embedding array<float>, ts timestamp", f"{tmp_path}/in", f"{tmp_path}/out"
    batches = [
        [(1, [1.0, 0.0], at(0)), (1, [0.0, 1.0], at(1)), (2, [4.0, 4.0], at(2)), (3, None, at(2)), (None, [1.0, 1.0], at(2))],
        [(1, [1.0, 1.0], at(500)), (4, [1.0, 2.0], None)],
        [(1, [3.0, 3.0], at(700))],  # the watermark passes 602: key 2 is gone at the next batch
        [(1, [0.0, 0.0], at(701)), (5, [7.0, 7.0], at(702))],
        [(2, [9.0, 9.0], at(703))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = centroids.running_centroids(spark.readStream.schema(schema).parquet(path), lifetime=600)
        stream.writeStream.outputMode("update").foreachBatch(lambda found, b: found.write.mode("overwrite").parquet(f"{out}/batch={b}")).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    updates = spark.read.parquet(out)
    assert [r.key for r in updates.where("expired and key is not null").collect()] == ["2"]
    got = {r.key: (r.n, list(r.centroid)) for r in centroids.latest_centroids(updates).collect()}
    assert got == {"1": (5, [1.0, 1.0]), "5": (1, [7.0, 7.0]), "2": (1, [9.0, 9.0])}


def test_a_hot_key_is_summed_before_it_is_shuffled(spark, tmp_path):
    rows = spark.range(20_000).select(F.lit(1).alias("label"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"), F.timestamp_seconds(F.lit(1704067200)).alias("ts"))
    rows.write.parquet(f"{tmp_path}/in")
    counted = spark.read.parquet(f"{tmp_path}/in").select(F.col("label").cast("string").alias("key"), "ts", F.col("embedding").alias("vector")).mapInArrow(centroids._partial, "key string, ts timestamp, total array<double>, n long")
    parts = counted.collect()
    assert len(parts) < 20 and sum(r.n for r in parts) == 20_000
