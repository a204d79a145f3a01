"""Queries over reports, guards and work items."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.functions import html, pii, scalars
from corpusflow.functions import text as strings
from corpusflow.functions.models import INJECTION_WORDS, TOXIC_WORDS
from corpusflow.operators import guards, intel, items, reports
from corpusflow.queries.registry import NOW, query
from corpusflow.session import table

_SITE = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
_VOTE = "case when quality = 1 then 'up' when toxic = 1 then 'down' else 'other' end"
_NOW = f"timestamp '{NOW}'"


def _now():
    return F.lit(NOW).cast("timestamp")


def _votes(spark, sf_dir):
    vote = F.when(F.col("quality") == 1, "up").when(F.col("toxic") == 1, "down").otherwise("other")
    return table(spark, sf_dir, "labels").withColumn("vote", vote)


@query(f"select {_SITE} as site_id, count(*) as chunk_count, count(distinct url) as page_count, max(page_id) as last_updated from pages group by 1")
def agg01_site_stats(spark, sf_dir):
    return reports.site_stats(table(spark, sf_dir, "pages"), html.site(F.col("url")), "url", "page_id")


@query(f"select {_SITE} as site_id from pages group by 1 order by max(page_id) desc, 1 limit 1")
def flt18_default_site(spark, sf_dir):
    return agg01_site_stats(spark, sf_dir).orderBy(F.desc("last_updated"), "site_id").limit(1).select("site_id")


@query(f"""select count(*) as total, count_if(v = 'up') as up, count_if(v = 'down') as down, round(count_if(v = 'up') / count(*), 4) as up_rate from (select {_VOTE} as v from labels)""")
def agg02_feedback_summary(spark, sf_dir):
    return reports.feedback_summary(_votes(spark, sf_dir))


@query(f"""select source, count(*) as total, count_if(v = 'up') as up, count_if(v = 'down') as down, round(count_if(v = 'up') / count(*), 4) as up_rate from (select doc_id, {_VOTE} as v from labels) join documents using (doc_id) group by 1""")
def agg02_feedback_by_site(spark, sf_dir):
    return reports.feedback_summary(_votes(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id"), ["source"])


@query(f"select doc_id from labels where {_VOTE} = 'down' order by doc_id limit 10")
def top07_first_low_rated(spark, sf_dir):
    return reports.first_low_rated(_votes(spark, sf_dir), "doc_id").select("doc_id")


@query("select event_type, round(avg(value), 6) as mean, count(*) as n, round(avg((value >= 10)::int), 4) as pass_rate from events where value is not null group by 1")
def agg09_metric_summary(spark, sf_dir):
    return reports.metric_summary(table(spark, sf_dir, "events"), ["event_type"], "value", 10, digits=6)


@query("""select guard, count_if(level = 'safe') as safe, count_if(level = 'unsafe') as unsafe, count_if(level = 'uncertain') as uncertain, round(count_if(level = 'safe') / count(*), 4) as pass_rate from
(select 'toxicity' as guard, case when toxic = 1 then 'unsafe' else 'safe' end as level from labels union all select 'quality', case quality when 1 then 'safe' else 'uncertain' end from labels) group by 1""")
def agg12_verdict_tally(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return reports.verdict_tally(labels.select(F.lit("toxicity").alias("guard"), F.when(F.col("toxic") == 1, "unsafe").otherwise("safe").alias("level")).unionByName(labels.select(F.lit("quality").alias("guard"), F.when(F.col("quality") == 1, "safe").otherwise("uncertain").alias("level"))))


@query("""with d as (select event_type, date_trunc('day', ts) as ts, round(avg(value), 6) as value from events group by all),
p as (select *, lag(value) over (partition by event_type order by ts) as prior from d)
select event_type, ts, value, prior, round(value - prior, 6) as delta, coalesce(round(value - prior, 6) < -0.05, false) as regressed from p""")
def agg14_regressions(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("ts")).agg(F.round(F.avg("value"), 6).alias("value"))
    return reports.regressions(daily, ["event_type"])


@query("select event_type, arg_max(value, ts) as value, max(ts) as ts from events where ts < timestamp '2024-01-15' group by 1")
def jn11_prior_report(spark, sf_dir):
    return reports.prior_report(table(spark, sf_dir, "events"), F.lit("2024-01-15").cast("timestamp"), ["event_type"])


@query("select 'documents' as collection, count(*) as n from documents union all select 'embeddings', count(*) from embeddings")
def agg17_row_counts(spark, sf_dir):
    return reports.row_counts({n: table(spark, sf_dir, n) for n in ("documents", "embeddings")})


@query(f"select {_SITE} as directory, sum(strlen(html))::bigint as bytes from pages group by 1 having bytes > 1000 order by bytes desc, 1 limit 20")
def agg18_directory_sizes(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(F.concat(html.site(F.col("url")), F.lit("/x")).alias("path"), F.octet_length("html").cast("long").alias("size_bytes"))
    return reports.directory_sizes(files, 1, at_least=1000)


_ROOTS = ["web", "web/http:", "web/https:", "none"]


@query(f"""with f as (select 'web/' || regexp_replace(url, '[/]+', '/', 'g') as path, strlen(html)::bigint as n from pages), r as (select unnest({_ROOTS}) as root),
p as (select root, n, string_split(substr(path, length(root) + 2), '/') as parts from f join r on starts_with(path, root || '/')),
e as (select root, array_to_string(parts[1:k], '/') as entry, sum(n) as bytes from (select *, unnest(range(1, least(len(parts), 3) + 1)) as k from p) group by all having bytes > 2000),
t as (select *, row_number() over (partition by root order by bytes desc, entry) as place from e qualify place <= 20),
a as (select root, entry, bytes from t where not exists (select 1 from t o where o.root = t.root and starts_with(t.entry, o.entry || '/')))
select root, root || '/' || entry as entry, bytes::bigint as bytes, row_number() over (partition by root order by bytes desc, entry)::int as rank from a""")
def dsk01_sizes_per_root(spark, sf_dir):
    """Pages as files under their address: the largest entries of several roots that lie in each other."""
    path = F.concat(F.lit("web/"), F.regexp_replace("url", "[/]+", "/"))
    pages = table(spark, sf_dir, "pages").select(path.alias("path"), F.octet_length("html").cast("long").alias("size_bytes"))
    return reports.sizes_per_root(pages, _ROOTS, levels=3, at_least=2000)


@query("select conv_id, sum(case when role = 'user' then length(text) else 0 end)::bigint as input_chars, sum(case when role = 'assistant' then length(text) else 0 end)::bigint as answer_chars from conversations group by 1")
def agg22_usage(spark, sf_dir):
    size = lambda role: F.sum(F.when(F.col("role") == role, F.length("text")).otherwise(0))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(size("user").alias("input_chars"), size("assistant").alias("answer_chars"))


_ITEMS = "(select event_id as item_id, event_type as source, user_id, ts, case when event_type = 'error' then 'P0' when event_type = 'signup' then 'P1' else 'P2' end as priority, case when value < 2 then 'resolved' else 'open' end as status, value from events)"


def _items(spark, sf_dir):
    priority = F.when(F.col("event_type") == "error", "P0").when(F.col("event_type") == "signup", "P1").otherwise("P2")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("item_id"), F.col("event_type").alias("source"), "user_id", "ts", priority.alias("priority"), F.when(F.col("value") < 2, "resolved").otherwise("open").alias("status"), "value")


@query(f"""select user_id, min(priority) as priority, arg_max(status, {{'ts': ts, 'i': item_id}}) as status, count(distinct source) as sources, count(*) as items, case when count(distinct source) >= 3 then 'High' when count(distinct source) = 2 then 'Medium' else 'Low' end as confidence from {_ITEMS} group by 1""")
def agg20_clusters(spark, sf_dir):
    return intel.clusters(_items(spark, sf_dir), "user_id")


@query(f"""with recursive i as (select *, regexp_extract(props, '[0-9]+') as k, strftime(ts, '%Y-%m-%d') as day from events),
w as (select event_id, 'w' || user_id || '/' || k as key from i where event_type = 'purchase'),
keys as (select event_id, 't' || user_id || '/' || day as key from i where event_type <> 'purchase' and event_type <> 'signup' union all select event_id, 'x' || k || '/' || day from i where event_type = 'error'
  union all select event_id, key from w where key in (select key from w group by key having count(*) <= 3)),
reach as (select event_id as a, event_id as b from events union select r.a, y.event_id from reach r join keys x on r.b = x.event_id join keys y using (key)),
c as (select a as item_id, min(b) as cluster_id from reach group by 1)
select cluster_id, min(priority) as priority, arg_max(status, {{'ts': ts, 'i': item_id}}) as status, count(distinct source) as sources, count(*) as items, case when count(distinct source) >= 3 then 'High' when count(distinct source) = 2 then 'Medium' else 'Low' end as confidence from {_ITEMS} join c using (item_id) group by 1""")
def brf03_linked_clusters(spark, sf_dir):
    """Events of a user as a project: a day is a thread, errors name tickets, and purchases have keywords."""
    k, kind = F.regexp_extract("props", "[0-9]+", 0), F.col("event_type")
    day = F.date_format("ts", "yyyy-MM-dd")
    more = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("item_id"), F.col("user_id").cast("string").alias("project"),
        F.when(~kind.isin("purchase", "signup"), day).alias("thread"),
        F.when(kind == "error", F.array(F.concat(k, F.lit("/"), day))).otherwise(F.array()).alias("tickets"),
        F.when(kind == "purchase", F.array(F.concat(F.lit("K"), k))).alias("keywords"))
    found = intel.linked(more, rare=3).select("item_id", "cluster_id")
    return intel.clusters(_items(spark, sf_dir).join(found, "item_id"), "cluster_id")


@query("select o_orderkey, case when o_orderpriority like '%URGENT%' then 'P0' when o_orderpriority like '%HIGH%' then 'P1' when o_orderpriority like '%MEDIUM%' then 'P2' else 'P3' end as priority from orders")
def sca08_ticket_priority(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.ticket_priority(F.col("o_orderpriority")).alias("priority"))


@query("select event_id, case event_type when 'error' then 'P0' when 'signup' then 'P1' else 'P2' end as priority from events")
def sca08_alert_priority(spark, sf_dir):
    severity = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "signup", "warning").otherwise("info")
    return table(spark, sf_dir, "events").select("event_id", scalars.alert_priority(severity).alias("priority"))


@query("select event_id, case when event_type = 'error' and value > 50 then 'P0' when event_type = 'error' then 'P1' when event_type = 'signup' then 'P1' when event_type = 'purchase' and ts < timestamp '2024-01-28' then 'P2' else 'P2' end as priority from events")
def sca09_priority_rules(spark, sf_dir):
    kind, none = F.col("event_type"), F.lit(False)
    rules = {"critical_alert": (kind == "error") & (F.col("value") > 50), "warning_alert": kind == "error", "blocker_ticket": none, "high_ticket": none, "pipeline_failed": kind == "signup", "review_waiting": (kind == "purchase") & (F.col("ts") < F.lit("2024-01-28").cast("timestamp")), "mentioned": none, "urgent_words": none}
    return table(spark, sf_dir, "events").select("event_id", scalars.priority_rule(rules).alias("priority"))


@query(f"select source, priority, last_seen, coalesce((priority = 'P0' and epoch({_NOW}) - floor(epoch(last_seen)) > 86400) or (priority = 'P1' and epoch({_NOW}) - floor(epoch(last_seen)) > 259200), false) as stale from (select source, priority, max(ts) as last_seen from {_ITEMS} where status = 'open' group by source, priority)")
def win09_staleness(spark, sf_dir):
    seen = _items(spark, sf_dir).where("status = 'open'").groupBy("source", "priority").agg(F.max("ts").alias("last_seen"))
    return seen.withColumn("stale", scalars.stale(F.col("priority"), F.col("last_seen"), _now()))


@query(f"select event_id, round(value * case when epoch({_NOW}) - floor(epoch(ts)) <= 604800 then 1.5 else 1 end, 6) as score from events")
def win10_recency_weight(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(scalars.recency_weighted(F.col("value"), F.col("ts"), _now()), 6).alias("score"))


@query(f"select event_id, (epoch({_NOW}) - floor(epoch(ts))) / 86400.0 > case when event_type in ('error', 'click') then 7 else 30 end as possibly_stale from events")
def win11_possibly_stale(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalars.possibly_stale(F.col("ts"), F.col("event_type").isin("error", "click"), _now()).alias("possibly_stale"))


@query("select conv_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) order by turn) as history from (select * from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 6) group by 1")
def win08_recent_turns(spark, sf_dir):
    return intel.recent_turns(table(spark, sf_dir, "conversations"))


@query("select source, group_no, count(*) as n, min(doc_id) as first_id from (select source, doc_id, (row_number() over (partition by source order by doc_id) - 1) // 3 as group_no from documents) group by all")
def win07_context_groups(spark, sf_dir):
    rows = intel.groups_of(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"])
    return rows.groupBy("source", "group_no").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query("select i.event_id as incident_id, d.event_id as deploy_id from events i join events d on i.user_id = d.user_id and d.ts between i.ts - interval 2 hour and i.ts where i.event_type = 'error' and d.event_type = 'purchase'")
def jn12_deploys_before(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    incidents = events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("incident_id"), F.col("ts").alias("incident_ts"))
    deploys = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("deploy_id"), F.col("ts").alias("deploy_ts"))
    return intel.deploys_before(incidents, deploys, "user_id").select("incident_id", "deploy_id")


@query("select conv_id, turn from conversations where not regexp_replace(lower(trim(text)), '[.!]+$', '') in (" + ", ".join(f"'{w}'" for w in intel.ACKNOWLEDGEMENTS) + ")")
def flt12_without_noise(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where(~intel.is_noise(F.col("text"))).select("conv_id", "turn")


@query(f"select item_id, source, priority from {_ITEMS} where source in ('click', 'error') and priority in ('P0', 'P2') and status not in ('resolved', 'closed')")
def flt02_where_lists(spark, sf_dir):
    return _items(spark, sf_dir).where(F.col("source").isin("click", "error") & F.col("priority").isin("P0", "P2") & ~F.col("status").isin("resolved", "closed")).select("item_id", "source", "priority")


@query(f"""select event_id, case event_id % 4 when 0 then {_NOW} - to_hours(event_id % 99) when 1 then {_NOW} - to_days((event_id % 50)::int) when 2 then {_NOW} - to_days((30 * (event_id % 7))::int) else date_trunc('second', ts) end as cutoff from events""")
def flt03_since_cutoff(spark, sf_dir):
    """Of each event a value: hours, days or months before now, or its own time."""
    i = F.col("event_id")
    before = lambda n, unit: F.concat(i % n, F.lit(unit))
    since = F.when(i % 4 == 0, before(99, "h")).when(i % 4 == 1, before(50, "d")).when(i % 4 == 2, before(7, "m")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, sf_dir, "events").select("event_id", scalars.since_cutoff(since, _now()).alias("cutoff"))


@query("select event_id, event_id % 9 + 1 as n, case when event_id % 2 = 0 then event_id % 5 + 1 else 1 end * case event_id % 3 when 0 then 1 when 1 then 60 else 3600 end as seconds from events")
def src06_rate_limit(spark, sf_dir):
    i = F.col("event_id")
    unit = F.when(i % 3 == 0, "s").when(i % 3 == 1, "m").otherwise("h")
    spec = F.concat((i % 9 + 1).cast("string"), F.lit("/"), F.when(i % 2 == 0, (i % 5 + 1).cast("string")).otherwise(""), unit)
    rows = table(spark, sf_dir, "events").select("event_id", scalars.rate_limit(spec).alias("r"))
    return rows.select("event_id", F.col("r.n").cast("long").alias("n"), F.col("r.seconds").cast("long").alias("seconds"))


@query("select doc_id, round(case doc_id % 3 when 0 then greatest(0, 1 - c) when 1 then least(1, c) else 0.5 end::double, 6) as risk from (select doc_id, (doc_id % 130) / 100.0 as c from labels)")
def sca05_injection_risk(spark, sf_dir):
    i = F.col("doc_id")
    label = F.when(i % 3 == 0, "BENIGN").when(i % 3 == 1, F.when(i % 2 == 0, "JAILBREAK").otherwise("Injection")).otherwise("OTHER")
    return table(spark, sf_dir, "labels").select("doc_id", F.round(scalars.injection_risk(label, (i % 130) / 100.0), 6).alias("risk"))


@query("select doc_id, toxic >= 0.7 as is_toxic from labels")
def sca06_any_toxic(spark, sf_dir):
    scores = F.create_map(F.lit("toxicity"), F.col("toxic").cast("double"), F.lit("threat"), F.lit(0.0))
    return table(spark, sf_dir, "labels").select("doc_id", scalars.any_toxic(scores).alias("is_toxic"))


@query("select doc_id, case doc_id % 3 when 0 then lang when 1 then source end as model from documents")
def sca12_judge_setting(spark, sf_dir):
    i, old = F.col("doc_id"), F.concat(F.lit('"ragas":{"model":"'), "source", F.lit('"}'))
    config = F.when(i % 3 == 0, F.concat(F.lit('{"judge":{"model":"'), "lang", F.lit('"},'), old, F.lit("}"))).when(i % 3 == 1, F.concat(F.lit("{"), old, F.lit("}"))).otherwise("{}")
    return table(spark, sf_dir, "documents").select("doc_id", scalars.judge_setting(config, "model").alias("model"))


_FOLDERS = ["go/pkg/mod/cache", "src/app/node_modules", "Library/Developer/Xcode/DerivedData", "Library/Group Containers/net.whatsapp.WhatsApp", "Documents/a"]


@query(f"select page_id, list_value('safe-cache', 'project-rebuild', 'system-app', 'app-manual', 'user-data')[page_id % {len(_FOLDERS)} + 1] as class from pages")
def sca10_reversibility(spark, sf_dir):
    folder = F.element_at(F.array(*[F.lit(x) for x in _FOLDERS]), (F.col("page_id") % len(_FOLDERS) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", scalars.reversibility(F.concat(folder, F.lit("/"), "page_id")).alias("class"))


def _redacting_sql(column: str, form: str, kinds: list[str]) -> str:
    out = column
    for kind, pattern in pii.PATTERNS.items():
        if kind in kinds:
            out = f"regexp_replace({out}, '{pattern}', '{form.format(pii.shown(kind))}', 'g')"
    return out


@query(f"select doc_id, sha256({_redacting_sql('text', '<{}>', pii.SITE_TYPES)}) as redacted_sha256 from documents")
def grd05_redacted(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(pii.redacted(F.col("text")), 256).alias("redacted_sha256"))


@query(f"select doc_id, sha256({_redacting_sql('text', '[REDACTED:{}]', pii.ITEM_TYPES)}) as redacted_sha256 from documents")
def grd07_redacted_items(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(pii.redact_items(F.col("text")), 256).alias("redacted_sha256"))


@query(r"select doc_id, len(regexp_extract_all(text, '\b\d{16}\b')) as national_ids, len(regexp_extract_all(text, '\b\d{2}\.\d{3}\.\d{3}\.\d-\d{3}\.\d{3}\b')) as tax_ids from documents")
def grd06_id_counts(spark, sf_dir):
    count = lambda kind: F.regexp_count("text", F.lit(pii.PATTERNS[kind])).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", count("ID_NIK").alias("national_ids"), count("ID_NPWP").alias("tax_ids"))


@query(r"""with n as (select doc_id, len(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'))) as n from documents)
select doc_id, case when n > 5 then 'block' when n > 0 then 'redact' else 'pass' end as verdict from n""")
def grd10_leak_verdict(spark, sf_dir):
    n = F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(pii.PATTERNS["EMAIL_ADDRESS"]), F.lit(0))))
    return table(spark, sf_dir, "documents").select("doc_id", pii.leak_verdict(n).alias("verdict"))


@query("select doc_id, text from documents where doc_id < 0 union all select doc_id, sha256(text) from documents")
def grd12_switched_off(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(pii.redact_items(F.col("text"), enabled=False), 256).alias("text"))


@query()
def grd07_spans(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(pii.spans(F.col("text"))).alias("s")).select("doc_id", "s.*")


@query()
def grd01_guarded_pages(spark, sf_dir):
    from corpusflow.plans.ingest import pages_to_markdown

    return guards.guard_pages(pages_to_markdown(table(spark, sf_dir, "pages"))).select("page_id", "passed", "severity", F.array_join("reasons", ";").alias("reasons"), F.sha2("text", 256).alias("text_sha256"))


@query()
def grd02_guarded_questions(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("message", F.col("text"))
    return guards.guard_queries(asked).select("conv_id", "turn", "passed", "severity", F.array_join("reasons", ";").alias("reasons"))


@query()
def str18_undisguised(spark, sf_dir):
    from corpusflow.functions.disguise import undisguise

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", undisguise(F.col("text")).alias("u"))
    return rows.select("conv_id", "turn", F.md5("u.canonical").alias("canonical_md5"), F.array_join("u.transforms", ",").alias("transforms"))


@query()
def brf01_briefing(spark, sf_dir):
    rows = _items(spark, sf_dir).withColumns({"title": F.concat(F.lit("item "), "item_id"), "body": F.concat("source", F.lit(" by "), "user_id"), "score": F.col("value"), "search": F.lit(0)})
    return intel.briefing(rows, _now()).select("item_id", "title", "priority", "section")


@query(f"""select conv_id, turn, case when regexp_matches(text, '(?m)^(From|Subject|Date):') then 'email' when regexp_matches(text, '\\[\\d{{2}}/\\d{{2}}/\\d{{2,4}}, \\d{{2}}:\\d{{2}}(:\\d{{2}})?\\]') then 'whatsapp' when regexp_matches(text, '(^|\\s)@\\w+|Forwarded from') then 'telegram' else 'unknown' end as source,
case when regexp_matches(lower(text), '\\b(p0|critical|outage|down)\\b') then 'P0' when regexp_matches(lower(text), '\\b(urgent|asap|p1|blocked|eod|today)\\b') then 'P1' else 'P2' end as priority from conversations""")
def sca11_messages(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", intel.message_source(F.col("text")).alias("source"), intel.message_priority(F.col("text")).alias("priority"))


@query(f"""with m as (select event_id, date_trunc('second', ts) as ts from events) select event_id, case event_id % 5 when 0 then 'email' when 1 then 'whatsapp' when 3 then 'telegram' else 'email' end as source,
case event_id % 5 when 1 then 'P0' when 2 then 'P1' when 3 then 'P1' else 'P2' end as priority,
case event_id % 5 when 0 then ['Please fix OPS-' || event_id || ' by Friday'] when 1 then ['- [ ] call ABC-1 and ABC-1 before March 3'] when 2 then ['TODO: EOD'] else [] end as action_items,
case event_id % 5 when 0 then ['by Friday'] when 1 then ['before March 3'] when 2 then ['EOD'] when 3 then ['ASAP'] else [] end as deadlines,
case event_id % 5 when 0 then ['OPS-' || event_id] when 1 then ['ABC-1'] else [] end as tickets,
case event_id % 5 when 0 then ts - interval 7 hour when 1 then ts when 2 then ts else timestamp '{NOW}' end as message_ts from m""")
def sca11_parsed_messages(spark, sf_dir):
    """A message of each event, by mail, chat or neither, and all that is read from it."""
    form = lambda f: F.date_format("ts", f)
    n, line = F.col("event_id") % 5, F.lit("\n")
    text = F.when(n == 0, F.concat(F.lit("From: u"), "user_id", line, F.lit("Date: Mon, "), form("d MMM yyyy HH:mm:ss"), F.lit(" +0700\nPlease fix OPS-"), "event_id", F.lit(" by Friday")))
    text = text.when(n == 1, F.concat(F.lit("["), form("dd/MM/yy, HH:mm:ss"), F.lit("] u: site down\n- [ ] call ABC-1 and ABC-1 before March 3")))
    text = text.when(n == 2, F.concat(F.lit("Date: "), form("yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("\nTODO: EOD"))).when(n == 3, F.lit("hi @user, ASAP")).otherwise(F.lit("Date: soon"))
    rows = intel.parsed_messages(table(spark, sf_dir, "events").select("event_id", text.alias("m")), "m", F.lit(NOW).cast("timestamp"))
    return rows.drop("m")


@query("select event_id, try_cast(case when event_id % 2 = 0 then ts::varchar else 'not a time' end as timestamp) as parsed from events")
def sca02_iso_times(spark, sf_dir):
    shown = F.when(F.col("event_id") % 2 == 0, F.col("ts").cast("string")).otherwise("not a time")
    return table(spark, sf_dir, "events").select("event_id", F.try_to_timestamp(shown).alias("parsed"))


@query("select doc_id from (select min(doc_id) as doc_id from documents where length(text) > 100 group by text[1:40])")
def flt09_testset_candidates(spark, sf_dir):
    title = F.substring("text", 1, 40)
    return table(spark, sf_dir, "documents").where(F.length("text") > 100).groupBy(title.alias("t")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query(f"select doc_id, case when doc_id % 2 = 0 then '{strings.REFUSALS['en'].replace(chr(39), chr(39) * 2)}' else '{strings.REFUSALS['id']}' end as refusal from documents")
def grd04_refusals(spark, sf_dir):
    answer = F.when(F.col("doc_id") % 2 == 0, " this is the one ").otherwise(" ini adalah untuk ")
    return table(spark, sf_dir, "documents").select("doc_id", strings.refusal_for(answer).alias("refusal"))


_RISK = "round(least(1.0, " + " + ".join(f"case when list_contains(t, '{w}') then {p} else 0 end" for w, p in INJECTION_WORDS.items()) + ")::double, 6)"


@query(f"""with w as (select doc_id, text[start:start + 1999] as w from (select doc_id, text, unnest(case when length(text) <= 2000 then [1] else range(1, length(text) + 1, 1500) end) as start from documents)),
t as (select doc_id, string_split_regex(lower(w), '[^a-zA-Z0-9_]+') as t from w) select doc_id, max({_RISK}) as risk from t group by 1""")
def agg15_window_risk(spark, sf_dir):
    return items.window_risk(table(spark, sf_dir, "documents"), "doc_id")


@query("select c_custkey::varchar as base_id, c_name[1:500] as title, case when c_acctbal < 0 then 'P0' else 'P2' end as priority, 'open' as status, c_mktsegment as segment from customer")
def flt08_stored_items(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    nothing = F.lit(None).cast("string")
    rows = customers.select(F.col("c_custkey").cast("string").alias("id"), *[nothing.alias(n) for n in ("source", "type", "url", "owner", "status", "timestamp")], F.col("c_name").alias("title"), F.when(F.col("c_acctbal") < 0, "P1").alias("priority"), F.lit("text").alias("body"), F.when(F.col("c_acctbal") < 0, F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("priority"), F.lit("P0"))).otherwise(F.create_map(F.lit("segment"), F.col("c_mktsegment"))).alias("metadata"))
    field = lambda k: F.element_at("fields", k).alias(k)
    return items.stored(rows).select("base_id", field("title"), field("priority"), field("status"), field("segment"))


@query(r"""with w as (select doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) as n from documents)
select doc_id || '__chunk' || unnest(range(0, greatest(0, ceil((n - 512) / 448.0))::int + 1)) as item_id from w where n > 0""")
def snk02_item_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.regexp_like("text", F.lit(r"\S")))
    rows = docs.select(F.col("doc_id").alias("base_id"), F.col("text").alias("body"), F.create_map().cast("map<string,string>").alias("fields"))
    return items.item_chunks(rows).select("item_id")


@query("select doc_id, case when source = 'src1' then 1 else 0 end as allowed from documents")
def jn14_site_allowlists(spark, sf_dir):
    sites = spark.createDataFrame([("src1", [" email_address ", ""]), ("src2", [])], "source string, pii_allowlist array<string>")
    rows = items.with_allowlist(table(spark, sf_dir, "documents").select("doc_id", "source"), sites, "source")
    return rows.select("doc_id", F.array_contains("allowed", "EMAIL_ADDRESS").cast("int").alias("allowed"))


@query("select s_suppkey, case when s_suppkey % 2 = 0 then 'custom-openai' else 'named' end as provider, case when s_suppkey % 2 = 0 then 'http://h:' || s_suppkey || '/v1' end as url, 'm' || s_nationkey as model from supplier")
def str27_judge_specs(spark, sf_dir):
    model = F.concat(F.lit("m"), "s_nationkey")
    spec = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("custom-openai:http://h:"), "s_suppkey", F.lit("/v1:"), model)).otherwise(model)
    return table(spark, sf_dir, "supplier").select("s_suppkey", items.judge_spec(spec).alias("j")).select("s_suppkey", "j.*")


@query("select acronym, gloss from (select substr(s_name, 1, 20) as acronym, case when s_suppkey % 2 = 0 then 'even' end as gloss, s_suppkey from supplier) order by acronym limit 50")
def jn02_glossary_join(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").select(F.substring("s_name", 1, 20).alias("acronym"), "s_suppkey")
    glosses = names.where("s_suppkey % 2 = 0").select("acronym", F.lit("even").alias("gloss")).unionByName(spark.createDataFrame([("_note", "x")], "acronym string, gloss string"))
    return items.glossary(names, glosses).select("acronym", "gloss")


@query("select query_id, turn, row_number() over (partition by query_id order by round(length(text) / 1000.0, 6) desc, turn) as rank from (select conv_id as query_id, turn, coalesce(text, '') as text from conversations) qualify rank <= 3")
def top02_best_scores(spark, sf_dir):
    """Turns of each conversation, ranked again by their length."""
    from corpusflow.operators.retrieval import reranked

    hits = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), "turn", F.col("turn").alias("rank"), F.coalesce("text", F.lit("")).alias("text"))
    return reranked(hits, F.round(F.length("text") / 1000.0, 6), 3).select("query_id", "turn", F.col("rank").cast("long").alias("rank"))


@query()
def src23_sampled(spark, sf_dir):
    from corpusflow.sources.files import sampled

    return sampled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 20)


@query()
def src07_token_bucket(spark, sf_dir):
    from corpusflow.sources.web import token_bucket

    return token_bucket(table(spark, sf_dir, "events"), 10, 60).select("event_id", F.round("sent_at", 3).alias("sent_at"))


@query()
def evl01_metrics(spark, sf_dir):
    from corpusflow.plans.evaluate import judged

    return judged(table(spark, sf_dir, "labels"), {"quality": lambda s: s.quality.cast("double"), "harmless": lambda s: (1 - s.toxic).cast("double")})


@query("select event_id, round(value / 3, 4) as four, round(value / 7, 2) as two from events")
def sca03_rounded(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(F.col("value") / 3, 4).alias("four"), F.round(F.col("value") / 7, 2).alias("two"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') as shown from events")
def sca04_iso_seconds(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalars.iso_seconds(F.col("ts")).alias("shown"))


@query("select doc_id, len(list_filter(string_split(lower(coalesce(text, '')), ' '), lambda w: w in ('the', 'und', 'que', 'di')))::int as markers from documents")
def sca07_markers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.markers(F.col("text"), ["the", "und", "que", "di"]).alias("markers"))


@query(r"""with w as (select doc_id, list_distinct(regexp_extract_all(lower('the que und ' || source), '[\p{L}\p{N}_]+')) as q, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) as c from documents)
select doc_id, round(len(list_intersect(q, c)) / len(q), 6) as score from w""")
def udf02_pair_scores(spark, sf_dir):
    from corpusflow.functions.models import pair_scorer

    asked = F.concat(F.lit("the que und "), "source")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(pair_scorer()(asked, F.col("text")), 6).alias("score"))


_WORST = "greatest(" + ", ".join(f"case when list_contains(w, '{w}') then {p} else 0 end" for w, p in TOXIC_WORDS.items()) + ")::double"


@query(f"select doc_id, {_WORST} as toxicity, {_WORST} as insult, 0.0::double as threat from (select doc_id, string_split_regex(lower(coalesce(text, '')), '[^a-zA-Z0-9_]+') as w from documents)")
def udf03_toxicity(spark, sf_dir):
    from corpusflow.functions.models import toxicity

    scores = table(spark, sf_dir, "documents").select("doc_id", toxicity(F.col("text")).alias("t"))
    return scores.select("doc_id", *[F.col("t")[k].alias(k) for k in ("toxicity", "insult", "threat")])
