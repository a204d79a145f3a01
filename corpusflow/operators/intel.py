"""Work items: deduplication over searches, deploys before incidents, clusters, briefings, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.operators import graph

# Whole messages that only acknowledge.
ACKNOWLEDGEMENTS = ["siap", "siaap", "oke", "oke mas", "ok", "okay", "noted", "haha", "aamiiin", "thanks", "thank you", "makasih", "terima kasih"]
SEVERITIES = {"error": "critical", "signup": "warning"}


def is_noise(message: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(message)), r"[.!]+$", "").isin(ACKNOWLEDGEMENTS)


def best_of_searches(hits: DataFrame, key: str = "base_id", score: str = "score") -> DataFrame:
    """Hits of several searches, each key once with its best score."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), "search"))
    return hits.withColumn("__n", at).where("__n = 1").drop("__n")


def deploys_before(incidents: DataFrame, deploys: DataFrame, key: str, hours: int = 2) -> DataFrame:
    """Pairs of one key with a deploy at most `hours` before the incident's start.

    Time is cut into blocks of that length: a deploy can only lie in the incident's block or the one before, so the
    join is on (key, block) and no pair is made far apart in time.
    """
    span = hours * 3600
    block = lambda c: F.floor(F.unix_timestamp(c) / span)
    left = incidents.select("*", F.explode(F.array(block(F.col("incident_ts")), block(F.col("incident_ts")) - 1)).alias("__block"))
    right = deploys.withColumn("__block", block(F.col("deploy_ts")))
    near = (F.col("deploy_ts") <= F.col("incident_ts")) & (F.col("deploy_ts") >= F.col("incident_ts") - F.make_dt_interval(hours=F.lit(hours)))
    return left.join(right, [key, "__block"]).where(near).drop("__block")


def clusters(items: DataFrame, key: str) -> DataFrame:
    """Priority of the most urgent member, status of the latest, sources, and the confidence they give."""
    from corpusflow.functions.scalars import confidence

    n = F.countDistinct("source")
    return items.groupBy(key).agg(F.min("priority").alias("priority"), F.max_by("status", F.struct("ts", "item_id")).alias("status"), n.alias("sources"), F.count(F.lit(1)).alias("items")).withColumn("confidence", confidence(F.col("sources"), F.lit(False)))


def linked(items: DataFrame, rare: int = 20) -> DataFrame:
    """items (item_id, project, thread, tickets, keywords, ...) with cluster_id, the smallest item_id of the cluster.

    Items are linked that name the same ticket, stand in the same thread of a project, or share, within a project, a
    keyword that at most `rare` items of the project have; clusters are what links connect. Keywords are compared
    without case. Threads and keywords without a project belong to the project ''. A null or empty thread, ticket or
    keyword links nothing. Each key links its items as a star around the smallest id, whatever their number.
    """
    project = F.coalesce("project", F.lit(""))
    named = lambda kind, *parts: F.concat_ws("\x1f", F.lit(kind), *parts)
    threads = items.where(F.coalesce("thread", F.lit("")) != "").select("item_id", named("thread", project, F.col("thread")).alias("key"))
    tickets = items.select("item_id", F.explode("tickets").alias("t")).where(F.coalesce("t", F.lit("")) != "").select("item_id", named("ticket", F.col("t")).alias("key"))
    words = items.select("item_id", project.alias("project"), F.explode(F.array_distinct(F.transform("keywords", F.lower))).alias("w")).where(F.coalesce("w", F.lit("")) != "")
    words = words.select("item_id", named("word", F.col("project"), F.col("w")).alias("key")).distinct()
    few = words.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, rare)).select("key")
    keys = threads.unionByName(tickets).unionByName(words.join(few, "key", "left_semi"))
    found = graph.components(items.select(F.col("item_id").alias("node")), graph.stars(keys, "item_id", "key"))
    return items.join(found.withColumnsRenamed({"node": "item_id", "component": "cluster_id"}), "item_id")


def briefing(items: DataFrame, now: Column, mention: str = "@me") -> DataFrame:
    """Open items that say something, once each, with section and stale title.

    items (item_id, title, body, priority, status, ts, score, search).
    """
    from corpusflow.functions.scalars import stale

    once = best_of_searches(items.where(~F.coalesce(F.col("status").isin("resolved", "closed"), F.lit(False)) & ~is_noise(F.col("body"))), "item_id")
    urgent = F.when(F.contains("body", F.lit(mention)) & (F.col("priority") > "P1"), "P1").otherwise(F.col("priority"))
    rows = once.withColumn("priority", urgent)
    section = F.when(F.col("priority") == "P0", "today_must").when(F.col("priority") == "P1", "today_should").when(F.col("priority") == "P2", "this_week").otherwise("next_week")
    old = stale(F.col("priority"), F.col("ts"), now)
    return rows.withColumn("section", section).withColumn("title", F.when(old, F.concat(F.lit("STALE "), F.col("title"))).otherwise(F.col("title")))


def message_source(message: Column) -> Column:
    return (
        F.when(message.rlike(r"(?m)^(From|Subject|Date):"), "email")
        .when(message.rlike(r"\[\d{2}/\d{2}/\d{2,4}, \d{2}:\d{2}(:\d{2})?\]"), "whatsapp")
        .when(message.rlike(r"(^|\s)@\w+|Forwarded from"), "telegram")
        .otherwise("unknown")
    )


def message_priority(message: Column) -> Column:
    m = F.lower(message)
    return F.when(m.rlike(r"\b(p0|critical|outage|down)\b"), "P0").when(m.rlike(r"\b(urgent|asap|p1|blocked|eod|today)\b"), "P1").otherwise("P2")


def action_items(message: Column) -> Column:
    """array<string>: lines that ask for something."""
    lines = F.transform(F.split(message, "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: F.regexp_like(x, F.lit(r"^(- \[ \]|TODO:|Action:|Please\b)")))


def deadlines(message: Column) -> Column:
    return F.regexp_extract_all(message, F.lit(r"\b(?:by|before) [A-Z]?\w+(?: \d{1,2})?|\bEOD\b|\bEOM\b|\bASAP\b"), F.lit(0))


def message_time(message: Column, now: Column) -> Column:
    """The time in a message's headers: a `Date:` line (RFC 5322 or ISO), or a chat's [DD/MM/YY, HH:MM:SS]; else now.
    Times without a zone are those of the session. A header that is no time counts as none."""
    day = F.regexp_extract(message, r"(?m)^Date:\s*(?:[A-Za-z]{3},\s*)?(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
    zone = F.regexp_extract(message, r"(?m)^Date:.*\d{2}:\d{2}:\d{2} ([+-]\d{4})", 1)
    iso = F.regexp_extract(message, r"(?m)^Date:\s*(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2})?(?:Z|[+-]\d{2}:\d{2})?)", 1)
    chat = F.regexp_extract_all(message, F.lit(r"\[(\d{2}/\d{2}/)(?:\d{2})?(\d{2}, \d{2}:\d{2})(?::\d{2})?\]"), F.lit(0))
    stamp = F.regexp_replace(F.get(chat, F.lit(0)), r"^\[(\d{2})/(\d{2})/(?:\d{2})?(\d{2}), (\d{2}:\d{2})(:\d{2})?\]$", "20$3-$2-$1 $4$5")
    full = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(
        F.try_to_timestamp(F.concat(full(day), F.lit(" "), full(zone)), F.lit("d MMM yyyy HH:mm:ss xx")),
        F.try_to_timestamp(full(day), F.lit("d MMM yyyy HH:mm:ss")),
        F.try_to_timestamp(full(iso)),
        F.try_to_timestamp(stamp),
        now,
    )


def parsed_messages(messages: DataFrame, message: str, now: Column) -> DataFrame:
    """messages with source, priority, action_items, deadlines, tickets and message_ts."""
    m = F.col(message)
    return messages.withColumns({"source": message_source(m), "priority": message_priority(m), "action_items": action_items(m), "deadlines": deadlines(m), "tickets": tickets(m), "message_ts": message_time(m, now)})


def tickets(message: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(message, F.lit(r"\b[A-Z][A-Z0-9]+-\d+\b"), F.lit(0)))


def recent_turns(turns: DataFrame, n: int = 6) -> DataFrame:
    """(conv_id, history): the last n turns as 'role: content' lines, in order."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    last = turns.withColumn("__n", at).where(F.col("__n") <= n)
    line = F.concat("role", F.lit(": "), F.coalesce("text", F.lit("")))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x.l), "\n").alias("history"))


def groups_of(rows: DataFrame, by: list[str], order: list[str], size: int = 3) -> DataFrame:
    """rows with group_no: so many neighbours in a group."""
    return rows.withColumn("group_no", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size).cast("long"))
