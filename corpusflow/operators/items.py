"""Work items: stored form, chunks, counters; policies and settings kept as rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import chunking, pii, text
from corpusflow.functions.models import lexicon_risk
from corpusflow.operators.retrieval import small

# Lengths of stored fields and defaults.
TITLE, URLS, TYPES = 500, 1000, 200
PRIORITY, STATUS = "P2", "open"
BASE = ["source", "type", "title", "url", "owner", "priority", "status", "timestamp"]


def stored(items: DataFrame) -> DataFrame:
    """items (id, BASE, body, metadata map<string,string>) as base_id, body and one map of fields.

    Missing fields are empty, priority P2, status open; a metadata key overrides a base field of its name.
    """
    body = text.with_title_if_bare_url(pii.redact_items(F.coalesce("body", F.lit(""))), F.coalesce("title", F.lit("")))
    default = {"priority": PRIORITY, "status": STATUS}
    fields = []
    for name in BASE:
        value = F.coalesce(F.col(name).cast("string"), F.lit(default.get(name, "")))
        fields += [F.lit(name), F.substring(value, 1, TITLE) if name == "title" else value]
    fields += [F.lit("urls"), F.substring(F.array_join(text.urls_in(F.coalesce("body", F.lit(""))), ","), 1, URLS)]
    fields += [F.lit("pii_types"), F.substring(F.array_join(pii.types_in(F.coalesce("body", F.lit("")), pii.ITEM_TYPES), ","), 1, TYPES)]
    base, extra = F.create_map(*fields), F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(extra, k))
    return items.select(F.col("id").alias("base_id"), body.alias("body"), F.map_concat(kept, extra).alias("fields"))


def item_chunks(items: DataFrame, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row a chunk of a stored item: item_id = base_id__chunkN, text and, with a scorer, its vector."""
    cut = items.select("base_id", "fields", F.posexplode(chunking.word_windows(F.col("body"))).alias("chunk_index", "text"))
    rows = cut.withColumn("item_id", F.concat("base_id", F.lit("__chunk"), "chunk_index"))
    return rows if embed is None else rows.withColumn("embedding", embed(F.col("text")))


def embed_counters(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """items, embedded, blank, chunks, status: an empty batch is OK and blank items are no failure."""
    done = chunks.where(F.trim("text") != "").groupBy("base_id").agg(F.count(F.lit(1)).alias("n"))
    joined = items.select("base_id", (F.trim("body") == "").alias("blank")).join(done, "base_id", "left")
    failed = F.count_if(F.col("n").isNull() & ~F.col("blank"))
    status = F.when(failed == 0, "OK").when(failed < F.count(F.lit(1)), "PARTIAL").otherwise("FAILED")
    return joined.agg(F.count(F.lit(1)).alias("items"), F.count("n").alias("embedded"), F.count_if("blank").alias("blank"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), status.alias("status"))


def allowlist(policy: Column) -> Column:
    """Types of a policy: trimmed, upper case, without blanks and repeats."""
    return F.array_distinct(F.filter(F.transform(policy, lambda x: F.upper(F.trim(x))), lambda x: x != ""))


def with_allowlist(rows: DataFrame, sites: DataFrame, site: str = "site_id") -> DataFrame:
    """rows with their site's allowed types; a site without a row allows none."""
    known = sites.select(site, allowlist(F.col("pii_allowlist")).alias("allowed"))
    return rows.join(small(known), site, "left").withColumn("allowed", F.coalesce("allowed", F.array().cast("array<string>")))


def window_risk(docs: DataFrame, key: str, body: str = "text", score: Callable[[Column], Column] = lexicon_risk) -> DataFrame:
    """(key, risk): the highest score of the overlapping windows of a text."""
    windows = docs.select(key, F.explode(chunking.char_windows(F.col(body))).alias("w"))
    return windows.groupBy(key).agg(F.max(score(F.col("w"))).alias("risk"))


def judge_spec(spec: Column) -> Column:
    """struct<provider, url, model> of 'custom-openai:<url>:<model>' or a plain model name."""
    form = r"^custom-openai:(https?://.+?):([^:/]+)$"
    custom = F.regexp_like(spec, F.lit(form))
    part = lambda i: F.when(custom, F.regexp_extract(spec, form, i))
    return F.struct(F.when(custom, "custom-openai").otherwise("named").alias("provider"), part(1).alias("url"), F.coalesce(part(2), spec).alias("model"))


def glossary(table: DataFrame, glosses: DataFrame, cap: int = 50) -> DataFrame:
    """The site's acronyms with glosses, the first `cap` in order: what a prompt shows."""
    known = glosses.where(~F.startswith("acronym", F.lit("_")))
    return table.join(small(known), "acronym", "left").orderBy("acronym").limit(cap)


def system_prompt(base: str, lines: DataFrame) -> DataFrame:
    """(prompt): base with the glossary's lines spliced in, if there are any."""
    listed = F.array_join(F.array_sort(F.collect_list("line")), "\n")
    return lines.agg(F.when(F.count(F.lit(1)) > 0, F.concat(F.lit(base + "\n\nGlossary:\n"), listed)).otherwise(F.lit(base)).alias("prompt"))


def incident_context(incidents: DataFrame, deploys: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """incidents with their latest deploy within two hours and the ids of similar past items."""
    from corpusflow.operators.intel import best_of_searches, deploys_before

    last = deploys_before(incidents, deploys, key).groupBy("incident_id").agg(F.max_by("deploy_id", F.struct("deploy_ts", "deploy_id")).alias("deploy_id"))
    similar = best_of_searches(hits, "base_id").groupBy("incident_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "base_id"))), lambda x: x.base_id).alias("similar"))
    return incidents.join(last, "incident_id", "left").join(similar, "incident_id", "left")
