"""Queries over sources and sinks, plans and their parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusflow.functions import html
from corpusflow.functions import text as strings
from corpusflow.operators import guards, intel, items, reports, retrieval, state
from corpusflow.plans import evaluate, retrieve
from corpusflow.queries.registry import query
from corpusflow.queries.texts import _count, _starts
from corpusflow.session import scratch_path, table
from corpusflow.sources import files, sinks, web

_SITE = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_FOLDER = f"case when {_PATH} = '' then '/' else regexp_replace({_PATH}, '[^/]*$', '') end"
_ORIGIN = "regexp_extract(url, '^[a-z]+://[^/?#]*')"


# --- web ---


@query("select page_id, url, '2024-01-0' || (page_id % 9 + 1) as lastmod from pages")
def src02_sitemap_urls(spark, sf_dir):
    """A sitemap a page, with entities and CDATA."""
    escaped = F.replace("url", F.lit("&"), F.lit("&amp;"))
    loc = F.when(F.col("page_id") % 2 == 0, escaped).otherwise(F.concat(F.lit("<![CDATA["), "url", F.lit("]]>")))
    xml = F.concat(F.lit('<?xml version="1.0"?><s:urlset xmlns:s="http://s/0.9"><!-- x --><s:url><s:loc> '), loc, F.lit(" </s:loc><s:lastmod>2024-01-0"), (F.col("page_id") % 9 + 1).cast("string"), F.lit("</s:lastmod></s:url></s:urlset>"))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(web.sitemap_urls(xml)).alias("u")).select("page_id", "u.url", "u.lastmod")


@query(f"select site_id, 'https://' || site_id || case when first % 2 = 0 then '/a' else '/b' end as url from (select {_SITE} as site_id, min(page_id) as first from pages group by 1)")
def src01_discovered(spark, sf_dir):
    """Every second site has only an index at the first place, and a sitemap at the second."""
    sites = table(spark, sf_dir, "pages").groupBy(html.site(F.col("url")).alias("site_id")).agg(F.min("page_id").alias("first"))
    one = lambda loc: F.lit(f"<urlset><url><loc>{loc}</loc></url></urlset>")
    places = F.array(F.struct(F.lit("/sitemap.xml").alias("path"), F.when(F.col("first") % 2 == 0, one("a")).otherwise("<sitemapindex></sitemapindex>").alias("xml")), F.struct(F.lit("/sitemap_index.xml").alias("path"), one("/b").alias("xml")))
    fetched = sites.select("site_id", F.lit(200).alias("status"), F.explode(places).alias("p")).select("site_id", "status", "p.*")
    return web.discovered(fetched).select("site_id", "url")


@query(f"select page_id, not starts_with({_PATH}, '/de') as allowed from pages")
def src05_robots(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    rules = pages.select(html.site(F.col("url")).alias("site_id")).distinct().withColumn("robots_txt", F.lit("User-agent: *\nDisallow: /de\n"))
    return web.robots_allowed(pages.select("page_id", "url"), rules).select("page_id", "allowed")


_REFERENCES = {
    "leaf": f"{_FOLDER} || 'leaf'",
    "./here?x=1#f": f"{_FOLDER} || 'here?x=1'",
    "../up": f"case when {_FOLDER} = '/' then '/' else regexp_replace({_FOLDER}, '[^/]+/$', '') end || 'up'",
    "../../../../top/.": "'/top/'",
    "?q=a/../b": f"{_PATH} || '?q=a/../b'",
    "/root/./a/../b": "'/root/b'",
}


@query("select page_id, reference, target from (" + " union all ".join(f"select page_id, '{r}' as reference, {_ORIGIN} || {sql} as target from pages" for r, sql in _REFERENCES.items()) + " union all select page_id, 'http://z.org/a/../b', 'http://z.org/b' from pages union all select page_id, '#top', regexp_replace(url, '#.*$', '') from pages)")
def src10_resolved_links(spark, sf_dir):
    references = F.explode(F.array(*[F.lit(r) for r in [*_REFERENCES, "http://z.org/a/../b", "#top"]])).alias("reference")
    rows = table(spark, sf_dir, "pages").select("page_id", "url", references)
    return rows.select("page_id", "reference", html.absolute(F.col("url"), F.col("reference")).alias("target"))


# --- files and sinks ---


@query("select doc_id, case when doc_id % 4 < 2 then sha256(text)[1:12] end as content_hash, case doc_id % 4 when 2 then 'no reader for pdf' when 3 then 'Unsupported file type: .bin' end as error from documents")
def src16_extracted(spark, sf_dir):
    """Documents as attachments of four kinds."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("txt", "MD", "pdf", "bin")]), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/in/"), "doc_id", F.lit("."), kind).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return files.extracted(rows).select("doc_id", "content_hash", "error")


@query("select c_custkey::varchar as id, c_name as title, c_mktsegment as segment from customer")
def src17_items(spark, sf_dir):
    path = scratch_path(spark, "items")
    table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("title"), F.create_map(F.lit("segment"), "c_mktsegment").alias("metadata")).write.json(path)
    return files.items(spark, path, lines=True).select("id", "title", F.element_at("metadata", "segment").alias("segment"))


@query("select doc_id, quality, toxic from labels order by doc_id desc, quality desc, toxic desc limit 10")
def src20_jsonl_tail(spark, sf_dir):
    """Feedback appended as JSON lines, and the last ten of them."""
    path = scratch_path(spark, "feedback")
    sinks.append_feedback(table(spark, sf_dir, "labels").repartition(1).sortWithinPartitions("doc_id", "quality", "toxic"), path)
    return files.json_lines_tail(files.numbered_lines(spark, path), "doc_id long, quality int, toxic int", 10).select("doc_id", "quality", "toxic")


@query("select doc_id, quality, toxic from labels order by doc_id desc, quality desc, toxic desc limit 10")
def src21_jsonl_tail(spark, sf_dir):
    """The same ten, read from the ends of the files alone."""
    path = scratch_path(spark, "feedback")
    sinks.append_feedback(table(spark, sf_dir, "labels").repartition(1).sortWithinPartitions("doc_id", "quality", "toxic"), path)
    return files.json_tail(spark, path, "doc_id long, quality int, toxic int", 10).select("doc_id", "quality", "toxic")


@query("select count(*) as lines, sum(line_no) as numbers, max(line_no) as last from (select row_number() over () - 1 as line_no from events)")
def src20_numbered_lines(spark, sf_dir):
    """Lines of a folder of many files are numbered without gaps."""
    path = scratch_path(spark, "lines")
    table(spark, sf_dir, "events").repartition(7).select(F.col("event_id").cast("string")).write.text(path)
    return files.numbered_lines(spark, path).agg(F.count(F.lit(1)).alias("lines"), F.sum("line_no").alias("numbers"), F.max("line_no").alias("last"))


@query("select event_id from events order by ts desc, event_id::varchar limit 10")
def src22_recent(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("mtime"), F.col("event_id").cast("string").alias("path"))
    return files.recent(rows, 10).select("event_id")


@query("select 'new files' as label, count(*) as n from documents")
def src29_first_sync(spark, sf_dir):
    now = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit(0).alias("mtime_ns"), F.col("n_chars").alias("size_bytes"))
    return state.file_delta(now.limit(0), now).where("change = 'NEW'").agg(F.lit("new files").alias("label"), F.count(F.lit(1)).alias("n"))


@query("select source, value from (select distinct event_type as source, case when event_type = 'click' then '7' else 'INIT_PENDING' end as value from events union select 'click', '7')")
def src26_seeded_offsets(spark, sf_dir):
    known = spark.createDataFrame([("click", "7")], "source string, value string")
    sources = table(spark, sf_dir, "events").select(F.col("event_type").alias("source")).distinct().withColumn("first", F.lit("INIT_PENDING"))
    return state.seeded_offsets(known, sources)


@query("select '# Audit' || chr(10) || chr(10) || '- mode: `all`' || chr(10) || chr(10) || string_agg('## ' || r_name || chr(10) || chr(10) || '```json' || chr(10) || r_regionkey || chr(10) || '```' || chr(10), chr(10) order by r_name) as report from region")
def snk12_audit_markdown(spark, sf_dir):
    sections = table(spark, sf_dir, "region").select(F.col("r_name").alias("section"), F.col("r_regionkey").cast("string").alias("summary"))
    return sinks.audit_markdown(sections, "Audit", {"mode": "all"})


@query("""select doc_id, '<!doctype html>' || chr(10) || '<html lang="en"><head><meta charset="utf-8"><title>T</title></head>' || chr(10) || '<body><pre>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</pre></body></html>' || chr(10) as page from documents""")
def snk12_as_html(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sinks.as_html(F.col("text"), "T").alias("page"))


@query("select page_id, sha256(html) as sha256 from pages where page_id % 5 not in (0, 1)")
def snk14_backup(spark, sf_dir):
    i = F.col("page_id")
    path = F.concat(F.when(i % 5 == 0, "a/_raw/").otherwise("a/"), i, F.when(i % 5 == 1, "/.env").otherwise(".json"))
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.encode("html", "UTF-8").alias("content"))
    return sinks.backup_listing(rows).select(F.regexp_extract("path", r"a/(\d+)", 1).cast("long").alias("page_id"), "sha256")


@query("select page_id, sha256(html) as sha256, strlen(html)::bigint as size_bytes from pages where page_id % 5 not in (0, 1) and html is not null union all select null, null, 0")
def snk14_backup_parts(spark, sf_dir):
    """The manifest of an archive that every task writes a part of."""
    i = F.col("page_id")
    path = F.concat(F.when(i % 5 == 0, "a/_raw/").otherwise("a/"), i, F.when(i % 5 == 1, "/.env").otherwise(".json"))
    rows = table(spark, sf_dir, "pages").select(path.alias("path"), F.encode("html", "UTF-8").alias("content"))
    manifest = sinks.write_backup(rows, scratch_path(spark, "backup"))
    return manifest.select(F.regexp_extract("path", r"a/(\d+)", 1).cast("long").alias("page_id"), "sha256", "size_bytes")


@query("select conv_id, row_number() over (partition by conv_id order by turn) - 1 as seq, role as type from conversations")
def snk15_event_rows(spark, sf_dir):
    steps = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("type"), F.col("text").alias("payload"))
    return sinks.event_rows(steps, "conv_id", F.col("turn")).select("conv_id", F.col("seq").cast("long").alias("seq"), "type")


@query("select doc_id, case when doc_id % 3 = 0 then 'new' else source end as source from documents where doc_id % 2 = 0 or doc_id % 3 = 0")
def stm03_versions(spark, sf_dir):
    """A table of three versions: empty, whole, and merged by key."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    out = sinks.VersionedTable(spark, scratch_path(spark, "versions"))
    out.create("doc_id long, source string")
    out.merge(docs.where("doc_id % 2 = 0"), ["doc_id"], [F.col("source")])
    changes = docs.where("doc_id % 3 = 0").select("doc_id", F.explode(F.array(F.lit("old"), F.lit("new"))).alias("source")).withColumn("at", F.when(F.col("source") == "new", 2).otherwise(1))
    out.merge(state.latest(changes, ["doc_id"], [F.col("at")]).drop("at"), ["doc_id"])
    return out.read()


@query("""select source, max(doc_id) as doc_id, arg_max(lang, doc_id) as lang from documents group by 1""")
def snk01_last_write_wins(spark, sf_dir):
    """Many new rows of one key: the last in order stays."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "lang")
    return state.upsert(docs.limit(0), docs, ["source"], [F.col("doc_id")])


# --- questions and answers ---


@query("select event_id, case when k <= 100 and n between 1 and 25 then k end as top_k, case when k <= 100 and n between 1 and 25 then least(k, n) end as used from (select event_id, event_id % 120 + 1 as k, event_id % 31 as n from events)")
def flt06_bounds(spark, sf_dir):
    """A request of each event, some of them out of bounds."""
    i = F.col("event_id")
    asked = table(spark, sf_dir, "events").select("event_id", retrieve.bounded_columns(i % 120 + 1, i % 31).alias("b"))
    return asked.select("event_id", F.col("b.top_k").alias("top_k"), F.col("b.top_n").alias("used"))


_SAMPLE = r"' ' || regexp_replace(lower(answer[1:2000]), '^\s+|\s+$', '', 'g') || ' '"


@query(f"""with c as (select conv_id, min_by(text, turn) filter (where role = 'user') as question, min_by(text, turn) filter (where role = 'assistant') as answer from conversations group by 1),
s as (select *, {_SAMPLE} as sample from c where trim(coalesce(question, '')) <> ''),
l as (select *, coalesce(trim(answer), '') <> '' as answered, case when answer is null or answer = '' then 'id' when {_starts('ltrim(sample)', strings.ID_OPENERS)} then 'id' when {_starts('ltrim(sample)', strings.EN_OPENERS)} then 'en' when {_count('sample', strings.EN_MARKERS)} > {_count('sample', strings.ID_MARKERS)} then 'en' else 'id' end as language from s)
select conv_id, answered, language = 'en' as language_ok, conv_id % 2 = 0 as source_ok from l""")
def flt11_probe_checks(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    first = lambda role: F.min_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    talks = turns.groupBy("conv_id").agg(first("user").alias("question"), first("assistant").alias("answer"))
    probes = talks.select(F.col("conv_id").alias("probe_id"), "question", F.lit("en").alias("expected_language"), F.lit(True).alias("must_not_refuse"), F.lit("even").alias("expected_source"))
    answers = talks.select(F.col("conv_id").alias("probe_id"), "answer", F.when(F.col("conv_id") % 2 == 0, "http://even/x").otherwise("http://odd/x").alias("source_url"))
    return evaluate.probe_results(probes, answers).select(F.col("probe_id").alias("conv_id"), "answered", "language_ok", "source_ok")


@query("select item_id as query_id, case when item_id % 3 = 0 then 'answer' else 'no_context' end as event from benchmark")
def flt14_no_context(spark, sf_dir):
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return retrieve.no_context(questions, questions.where("query_id % 3 = 0")).select("query_id", "event")


@query("select doc_id as answer_id, doc_id % 4 = 0 as snippet_found from documents where doc_id % 2 = 0 and text <> ''")
def jn08_valid_citations(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    cited = F.when(F.col("doc_id") % 4 == 0, F.substring("text", 1, 30)).otherwise(F.concat(F.lit("\x03"), "text"))
    citations = docs.select(F.col("doc_id").alias("answer_id"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("elsewhere").alias("url"), F.when(F.col("text") != "", cited).alias("snippet"))
    hits = docs.select(F.col("doc_id").alias("answer_id"), F.col("source").alias("source_url"), "text")
    return guards.valid_citations(citations, hits).select("answer_id", "snippet_found")


@query(r"""with w as (select doc_id, trim(text) = '' as blank, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) as n from documents),
c as (select *, case when doc_id % 10 <> 0 and n > 0 then greatest(0, ceil((n - 512) / 448.0))::int + 1 end as chunks from w)
select count(*) as items, count(chunks) as embedded, count_if(blank) as blank, sum(chunks)::bigint as chunks, case when count_if(chunks is null and not blank) = 0 then 'OK' when count_if(chunks is null and not blank) < count(*) then 'PARTIAL' else 'FAILED' end as status from c""")
def agg08_embed_counters(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("base_id"), F.col("text").alias("body"), F.create_map().cast("map<string,string>").alias("fields"))
    return items.embed_counters(rows, items.item_chunks(rows.where("base_id % 10 <> 0")))


@query("select source as query_id, '<context>' || chr(10) || string_agg('<document title=\"' || case when rank = 1 then lang else 'chunk-' || (rank - 1) end || '\">' || chr(10) || text || chr(10) || '</document>', chr(10) order by rank) || chr(10) || '</context>' as context from (select *, row_number() over (partition by source order by doc_id) as rank from documents qualify rank <= 3) group by 1")
def str26_context_text(spark, sf_dir):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    hits = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), rank.alias("rank"), "text", "lang").where("rank <= 3")
    return retrieval.context_text(hits.select("query_id", "rank", "text", F.when(F.col("rank") == 1, F.col("lang")).otherwise("").alias("page_title"), F.lit("").alias("source_url")))


@query("select 'Base' || chr(10) || chr(10) || 'Glossary:' || chr(10) || string_agg(n_name, chr(10) order by n_name) as prompt from nation")
def str25_system_prompt(spark, sf_dir):
    return items.system_prompt("Base", table(spark, sf_dir, "nation").select(F.col("n_name").alias("line")))


@query("select conv_id as query_id, case when conv_id % 2 = 0 then 'about ' || n || ': ' || q else q end as query from (select conv_id, min_by(text, turn) as q, length(string_agg(role || ': ' || coalesce(text, ''), chr(10) order by turn)) as n from (select * from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 6) group by 1)")
def ret03_rewritten(spark, sf_dir):
    """Questions with a history are rewritten; those without one stay."""
    turns = table(spark, sf_dir, "conversations")
    history = intel.recent_turns(turns)
    last = state.latest(turns.select("conv_id", "turn"), ["conv_id"], [F.col("turn")]).select("conv_id", (F.col("turn")).alias("end"))
    kept = turns.join(last, "conv_id").withColumn("n", F.row_number().over(_by_conversation())).where("n <= 6")
    questions = kept.groupBy(F.col("conv_id").alias("query_id")).agg(F.min_by("text", "turn").alias("query"))
    return retrieval.rewritten(questions, history.where("conv_id % 2 = 0").select(F.col("conv_id").alias("query_id"), "history"), lambda q, h: F.concat(F.lit("about "), F.length(h), F.lit(": "), q))


def _by_conversation():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id").orderBy(F.desc("turn"))


@query("select item_id as query_id, case when item_id % 2 = 0 then 'it is ' || text end as hypothesis from benchmark")
def ret02_hypothesised(spark, sf_dir):
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    made = retrieval.hypothesised(questions, lambda q: F.when(F.col("query_id") % 2 == 0, F.concat(F.lit("it is "), q)).otherwise(" "))
    return made.select("query_id", "hypothesis")


_WORDS = r"list_distinct(list_filter(string_split_regex(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''))"


@query(f"""with d as (select doc_id, {_WORDS.format("'the of and ' || source || ' ' || lang")} as q, {_WORDS.format('text')} as a from documents),
s as (select case when len(q) = 0 then 1.0 else len(list_intersect(q, a)) / len(q) end as v from d)
select 'answer_relevancy' as metric, round(avg(v), 4) as mean, count(*) as n, round(avg((v >= 0.7)::int), 4) as pass_rate from s""")
def evl01_answer_relevancy(spark, sf_dir):
    samples = table(spark, sf_dir, "documents").select(F.concat(F.lit("the of and "), "source", F.lit(" "), "lang").alias("question"), F.col("text").alias("answer"))
    metric = "answer_relevancy"
    return evaluate.judged(samples, {metric: evaluate.quality_metrics()[metric]})


_SENTENCES = r"""list_filter(list_transform(string_split_regex(regexp_replace({}, '([.!?])\s+([A-ZÄÖÜ])', '\1' || chr(30) || '\2', 'g'), '\x1e|\n\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"""


@query(f"""with c as (select doc_id % 200 as item_id, text, row_number() over (partition by doc_id % 200 order by text, doc_id) as rank from documents where text is not null qualify rank <= 3),
i as (select item_id, text as answer from benchmark where item_id in (select item_id from c)),
s as (select item_id, sentence, {_WORDS.format('sentence')} as w from (select item_id, unnest({_SENTENCES.format('answer')}) as sentence from i)),
h as (select s.item_id, sentence, rank, case when len(w) = 0 then 1.0 else len(list_intersect(w, {_WORDS.format('c.text')})) / len(w) end >= 0.5 as held from s join c using (item_id)),
share as (select item_id, avg(held::int) as v from (select item_id, sentence, bool_or(held) as held from (select *, row_number() over (partition by item_id, rank order by sentence) as no from h) group by item_id, sentence, no) group by 1),
r as (select c.item_id, c.rank, coalesce(bool_or(h.held), false) as relevant from c join i using (item_id) left join h on h.item_id = c.item_id and h.rank = c.rank group by 1, 2),
p as (select item_id, coalesce(avg(precision) filter (where relevant), 0) as v from (select *, sum(relevant::int) over (partition by item_id order by rank) / rank as precision from r) group by 1),
a as (select item_id, case when len(q) = 0 then 1.0 else len(list_intersect(q, w)) / len(q) end as v from (select item_id, {_WORDS.format('answer')} as w, {_WORDS.format("'of the ' || c.text[1:200]")} as q from i join c using (item_id) where rank = 1)),
v as (select 'faithfulness' as metric, v from share union all select 'contextual_recall', v from share union all select 'contextual_precision', v from p union all select 'answer_relevancy', v from a)
select metric, round(avg(v), 4) as mean, count(*) as n, round(avg((v >= 0.7)::int), 4) as pass_rate from v group by 1""")
def evl01_quality(spark, sf_dir):
    """All four metrics of answers that are benchmark items, held against three documents of their place in turn."""
    made = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("answer"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("text", "doc_id"))
    held = table(spark, sf_dir, "documents").where("text is not null").select((F.col("doc_id") % 200).alias("item_id"), "doc_id", "text").withColumn("place", place).where("place <= 3")
    docs = held.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x.text).alias("contexts"))
    asked = F.concat(F.lit("of the "), F.substring(F.get("contexts", F.lit(0)), 1, 200))
    return evaluate.judged(made.join(docs, "item_id").withColumns({"question": asked, "ground_truth": F.col("answer")}), evaluate.quality_metrics())


@query("select a.attack, count(*) as n, count(*) as blocked, 1.0::double as block_rate from benchmark, (select unnest(['prompt_injection', 'rot13', 'base64', 'invisible']) as attack) a group by 1")
def evl03_red_team(spark, sf_dir):
    """Every benchmark item under each attack: none passes."""
    requests = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request_id"), F.col("text").alias("message"))
    return evaluate.red_team_summary(evaluate.red_team(requests).where("attack <> 'plain'"))


@query()
def agg10_guard_replay(spark, sf_dir):
    return evaluate.replay_questions(table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("message", F.col("text")))


@query("""with d as (select i.event_id as incident_id, max(struct_pack(ts := d.ts, id := d.event_id)).id as deploy_id from events i join events d on i.user_id = d.user_id and d.ts between i.ts - interval 2 hour and i.ts where i.event_type = 'error' and d.event_type = 'purchase' group by 1)
select event_id as incident_id, deploy_id from events left join d on event_id = incident_id where event_type = 'error'""")
def brf02_incident_context(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    incidents = events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("incident_id"), F.col("ts").alias("incident_ts"))
    deploys = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("deploy_id"), F.col("ts").alias("deploy_ts"))
    hits = incidents.select("incident_id", F.col("incident_id").alias("base_id"), F.lit(1.0).alias("score"), F.lit(0).alias("search"))
    return items.incident_context(incidents, deploys, hits, "user_id").select("incident_id", "deploy_id")


@query("select count(*) as n, round(avg((doc_id % 2 = 0)::int), 4) as pass_rate from documents")
def agg11_probe_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    checks = docs.select(F.col("doc_id").alias("probe_id"), F.lit(True).alias("answered"), F.lit(True).alias("language_ok"), (F.col("doc_id") % 2 == 0).alias("source_ok"))
    return reports.probe_summary(checks)


@query("""select '# Guards' || chr(10) || chr(10) || '| event_type | n |' || chr(10) || '|---|---|' || chr(10) || (select string_agg('| ' || event_type || ' | ' || n || ' |', chr(10) order by event_type) from (select event_type, count(*) as n from events group by 1))
|| chr(10) || chr(10) || '## First 10 breaches' || chr(10) || chr(10) || (select string_agg('- {"event_id":' || event_id || ',"user_id":' || user_id || '}', chr(10) order by event_id) from (select * from events where event_type = 'error' order by event_id limit 10)) || chr(10) as report""")
def snk13_security_report(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    tally = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return sinks.security_markdown("Guards", tally, events.where("event_type = 'error'").select("event_id", "user_id"), ["event_id"])


@query("select event_type as folder, sum(strlen(props) + 1)::bigint as size_bytes from events group by 1")
def src13_folder_walk(spark, sf_dir):
    """Text files of a folder for each kind, and their sizes together; marks of finished writes are not among them."""
    root = scratch_path(spark, "folder").removeprefix("file://")
    table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), "props").write.partitionBy("kind").text(f"file://{root}")
    found = files.folder(spark, root, ["TXT"], max_files=1_000_000)
    return found.groupBy(F.regexp_extract("path", "/kind=([^/]+)/", 1).alias("folder")).agg(F.sum("size_bytes").alias("size_bytes"))
