"""Queries over state: deltas, merges, eviction, offsets, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.functions import html
from corpusflow.operators import state
from corpusflow.queries.registry import NOW, query
from corpusflow.session import scratch_path, table

_SITE = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


def _before(docs):
    """An older snapshot: some documents are missing, some had other sizes, some are gone since."""
    kept = docs.where("doc_id % 7 <> 0").select(F.col("doc_id").cast("string").alias("path"), F.lit(0).alias("mtime_ns"), F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("size_bytes"))
    gone = docs.where("doc_id % 11 = 0").select(F.concat(F.lit("gone"), "doc_id").alias("path"), F.lit(0).alias("mtime_ns"), F.col("n_chars").alias("size_bytes"))
    return kept.unionByName(gone)


_DELTA = """old as (select doc_id::varchar as path, case when doc_id % 5 = 0 then n_chars + 1 else n_chars end as size from documents where doc_id % 7 <> 0 union all select 'gone' || doc_id, n_chars from documents where doc_id % 11 = 0),
new as (select doc_id::varchar as path, n_chars as size from documents),
delta as (select coalesce(o.path, n.path) as path, case when o.path is null then 'NEW' when n.path is null then 'DELETED' when o.size = n.size then 'UNCHANGED' else 'MODIFIED' end as change from old o full join new n on o.path = n.path)"""


def _delta(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    now = docs.select(F.col("doc_id").cast("string").alias("path"), F.lit(0).alias("mtime_ns"), F.col("n_chars").alias("size_bytes"))
    return state.file_delta(_before(docs), now)


@query(f"with {_DELTA} select path, change from delta")
def jn01_file_delta(spark, sf_dir):
    return _delta(spark, sf_dir)


@query(f"with {_DELTA} select path, change, path not in ('3', '7', '14') as applied from delta")
def jn13_reverted(spark, sf_dir):
    return state.reverted(_delta(spark, sf_dir), spark.createDataFrame([("3",), ("7",), ("14",)], "path string"))


@query(f"""with {_DELTA} select 'all' as label, count_if(change = 'NEW' and path not in ('3', '7')) as "new", count_if(change = 'MODIFIED' and path not in ('3', '7')) as modified, count_if(change = 'DELETED' and path not in ('3', '7')) as deleted, count_if(change = 'UNCHANGED' and path not in ('3', '7')) as unchanged, count_if(path in ('3', '7')) as embed_failed, 'PARTIAL' as status from delta""")
def agg07_sync_totals(spark, sf_dir):
    from corpusflow.operators.reports import sync_totals

    applied = state.reverted(_delta(spark, sf_dir), spark.createDataFrame([("3",), ("7",)], "path string"))
    return sync_totals(applied.withColumn("label", F.lit("all")))


@query("""select chunk_hash, doc_id, source from (select sha256(text) as chunk_hash, doc_id, source from documents) qualify row_number() over (partition by chunk_hash order by doc_id desc) = 1""")
def snk01_upsert_by_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("chunk_hash"), "doc_id", "source")
    old = state.latest(docs.where("doc_id % 2 = 0"), ["chunk_hash"], [F.col("doc_id")])
    both = state.upsert(old, docs.where("doc_id % 2 = 1"), ["chunk_hash"], [F.col("doc_id")])
    return state.latest(both.unionByName(old), ["chunk_hash"], [F.col("doc_id")])


@query("select doc_id, count(*) as chunks from (select doc_id, unnest(string_split(text, chr(10))) from documents where source <> 'src3') group by 1")
def snk02_item_chunks_without_site(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("chunk_no", "text")).withColumn("item_id", F.concat("doc_id", F.lit("__chunk"), "chunk_no"))
    kept = state.upsert(chunks.where("chunk_no > 0"), chunks, ["item_id"]).where("source <> 'src3'")
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))


@query("select source, count(*) as removed from documents where source = 'src3' group by 1")
def snk03_deleted_by_site(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("source = 'src3'").groupBy("source").agg(F.count(F.lit(1)).alias("removed"))


@query("select page_id, url as source_url, case when page_id % 3 = 0 then 'b2' else 'b1' end as ingestion_batch_id from pages")
def snk04_evict_stale(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("source_url"))
    old = pages.withColumn("ingestion_batch_id", F.lit("b1"))
    new = pages.where("page_id % 3 = 0").withColumn("ingestion_batch_id", F.lit("b2"))
    return state.evict_stale(old.unionByName(new), new)


@query("select doc_id from documents where doc_id % 9 <> 0")
def snk05_delete_by_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return state.without(docs, docs.where("doc_id % 9 = 0"), "doc_id")


@query("select source, min_by(lang, doc_id) as lang from documents group by 1")
def snk07_first_write_wins(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return state.first_wins([docs], ["source"], "lang", "doc_id")


@query("select lang, arg_min(source, t) as source from (select lang, source, [case when doc_id % 2 = 1 then 0 else 1 end, doc_id] as t from documents) group by 1")
def set02_merged_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return state.first_wins([docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0")], ["lang"], "source", "doc_id")


@query("""with seeds as (select item_id, text as question from benchmark where item_id % 2 = 0), made as (select item_id, text || ' ' as question from benchmark where item_id % 3 = 0)
select item_id, question, 'seed' as source from seeds union all select item_id, question, 'synth' from made where lower(trim(question)) not in (select lower(trim(question)) from seeds)""")
def jn09_merged_seeds(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    seeds = items.where("item_id % 2 = 0").select("item_id", F.col("text").alias("question"))
    made = items.where("item_id % 3 = 0").select("item_id", F.concat("text", F.lit(" ")).alias("question"))
    return state.merged_seeds(seeds, made)


@query("""with l as (select distinct unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as url from pages) select url from l where url not in (select url from (select unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as url from pages where page_id % 2 = 0))""")
def jn10_new_links(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("url"))
    return state.new_links(links, links.where("page_id % 2 = 0").select("url").distinct())


@query("select doc_id, source as label, case when source in ('src1', 'src2') then 'new' else 'old' end as origin from documents where source not in ('src1', 'src2') or doc_id % 2 = 0")
def set04_preserved_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("label"))
    scanned = docs.where("label in ('src1', 'src2') and doc_id % 2 = 0").withColumn("origin", F.lit("new"))
    return state.preserved(docs.withColumn("origin", F.lit("old")), scanned, spark.createDataFrame([("src1",), ("src2",)], "label string"))


_OFFSETS = [("click", "2024-01-10 00:00:00"), ("view", "2024-01-20 00:00:00")]


@query("select event_id, event_type from events e left join (values " + ", ".join(f"('{s}', timestamp '{v}')" for s, v in _OFFSETS) + ") o(source, value) on e.event_type = o.source where o.value is null or e.ts > o.value")
def stm01_after_offset(spark, sf_dir):
    offsets = spark.createDataFrame(_OFFSETS, "source string, value string").withColumn("value", F.to_timestamp("value"))
    return state.after_offset(table(spark, sf_dir, "events"), offsets, source="event_type").select("event_id", "event_type")


@query("select event_type as source, max(ts) as value from events group by 1 union all select 'jira', timestamp '2024-01-01'")
def snk11_merged_offsets(spark, sf_dir):
    old = spark.createDataFrame([("jira", "2024-01-01 00:00:00"), ("click", "2023-01-01 00:00:00")], "source string, value string").withColumn("value", F.to_timestamp("value"))
    new = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source")).agg(F.max("ts").alias("value"))
    return state.merged_offsets(old, new)


@query("select event_type as source, case event_type when 'click' then '99999999999999999999' when 'view' then '2999-01-01 00:00:00' when 'error' then max(event_id)::varchar else max(event_id)::varchar end as value from events group by 1 union all select 'mail', 'token-1'")
def snk11_offsets_never_move_back(spark, sf_dir):
    """Numbers of different length and times as strings, and a token, against new numbers, times and tokens."""
    old = spark.createDataFrame([("click", "99999999999999999999"), ("view", "2999-01-01 00:00:00"), ("error", "9"), ("purchase", "INIT_PENDING"), ("mail", "token-1")], "source string, value string")
    value = F.when(F.col("event_type") == "view", F.col("ts").cast("string")).otherwise(F.col("event_id").cast("string"))
    return state.merged_offsets(old, table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), value.alias("value")))


@query(f"select {_SITE} as site_id, max(page_id) as version, max_by(url, page_id) as start_url from pages group by 1")
def snk06_site_rows(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("site_id", html.site(F.col("url")))
    return state.latest(pages, ["site_id"], [F.col("page_id")]).select("site_id", F.col("page_id").alias("version"), F.col("url").alias("start_url"))


@query("select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def stm07_hourly_windows(spark, sf_dir):
    from corpusflow.streaming.delta import counted_by_window

    return counted_by_window(table(spark, sf_dir, "events"))


@query("""with e as (select user_id, ts, value, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 30 minute then 0 else 1 end as first from events),
s as (select *, sum(first) over (partition by user_id order by ts rows unbounded preceding) as no from e)
select user_id, min(ts) as session_start, max(ts) + interval 30 minute as session_end, count(*) as n, round(sum(value), 4) as total from s group by user_id, no""")
def stm07_sessions(spark, sf_dir):
    from corpusflow.streaming.windows import sessions

    return sessions(table(spark, sf_dir, "events"), "user_id")


@query("""select event_type, window_start, count(*) as n, round(sum(value), 4) as total from
(select event_type, value, time_bucket(interval 15 minute, ts) - to_minutes(15 * unnest(range(4))) as window_start from events) group by all""")
def stm07_sliding_windows(spark, sf_dir):
    from corpusflow.streaming.windows import sliding

    return sliding(table(spark, sf_dir, "events"), "event_type")


@query("select event_id, event_id % 10 = 0 and ts < (select max(ts) from events where event_id % 10 <> 0) - interval 3 day as late from events")
def stm07_late_rows(spark, sf_dir):
    """Every tenth event comes with a second batch; what is then older than three days goes to a table of its own."""
    from corpusflow.streaming.windows import LateRows

    root, events = scratch_path(spark, "late"), table(spark, sf_dir, "events").select("event_id", "ts")
    split = LateRows(spark, f"{root}/out", "3 days")
    for part in ("event_id % 10 <> 0", "event_id % 10 = 0"):
        events.where(part).write.mode("append").parquet(f"{root}/in")
        split.run(spark.readStream.schema(events.schema).parquet(f"{root}/in"), f"{root}/checkpoint")
    return split.on_time().select("event_id", F.lit(False).alias("late")).unionByName(split.late().select("event_id", F.lit(True).alias("late")))


@query("select event_id, event_type as source, ts from events")
def src25_connector_items(spark, sf_dir):
    """Items of a folder for each source, read as a stream in two runs of which the second goes on after the first."""
    from corpusflow.sources import connector

    connector.register(spark)
    root, events = scratch_path(spark, "connector"), table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("source"))
    middle = events.agg(F.expr("percentile(event_id, 0.5)").cast("long")).first()[0]
    for part in (F.col("event_id") <= middle, F.col("event_id") > middle):
        events.where(part).write.mode("append").partitionBy("source").parquet(f"{root}/in")
        items = spark.readStream.format(connector.NAME).schema("event_id long, source string, ts timestamp").option("path", f"{root}/in").option("order", "event_id").option("kind", "number").load()
        sink = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{root}/out/batch={batch}")
        items.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").select("event_id", "source", "ts")


@query("select label::varchar as label, count(distinct vec_id) as n, pos, round(avg(v), 6) as mean from (select label, vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as pos from embeddings) group by all")
def stm04_running_centroids(spark, sf_dir):
    """The vectors as a stream, a second apart, in three runs: what stands after the last equals the means of all."""
    from corpusflow.streaming import centroids

    root = scratch_path(spark, "centroids")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", F.timestamp_seconds(F.lit(1704067200) + F.col("vec_id")).alias("ts"))
    last = rows.agg(F.max("vec_id")).first()[0] or 0
    for part in range(3):
        rows.where(F.floor(F.col("vec_id") * 3 / (last + 1)) == part).write.mode("append").parquet(f"{root}/in")
        stream = centroids.running_centroids(spark.readStream.schema(rows.schema).parquet(f"{root}/in"), lifetime=100 * (last + 1))
        sink = lambda found, batch: found.write.mode("overwrite").parquet(f"{root}/out/batch={batch}")
        stream.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = centroids.latest_centroids(spark.read.parquet(f"{root}/out"))
    return found.select(F.col("key").alias("label"), "n", F.posexplode("centroid").alias("pos", "v")).select("label", "n", F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("mean"))


@query()
def ret06_ingest(spark, sf_dir):
    """The ingest plan over all pages: its chunks."""
    from corpusflow.plans.ingest import ingest

    done = ingest(table(spark, sf_dir, "pages"), "batch-1", F.lit(NOW).cast("timestamp"))
    return done.chunks.select("page_id", "site_id", "chunk_index", "section_title", "chunk_hash", "ingestion_batch_id", "last_updated", F.size("embedding").alias("dimensions"))


@query()
def agg06_ingest_progress(spark, sf_dir):
    from corpusflow.plans.ingest import ingest

    return ingest(table(spark, sf_dir, "pages"), "batch-1", F.lit(NOW).cast("timestamp")).progress
