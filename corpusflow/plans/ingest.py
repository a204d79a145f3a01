"""The ingest plan: pages to guarded, normalised, cut and embedded chunks, and the site's table and glossary."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import chunking, html, text
from corpusflow.functions.models import embedder
from corpusflow.operators.guards import guard_pages
from corpusflow.operators.retrieval import small
from corpusflow.operators.state import first_wins
from corpusflow.session import written

# A name of two to nine words, and an acronym.
_NAME = r"[A-Z][A-Za-z'À-ſ]{1,30}(?:\s+[\w'À-ſ-]+){1,8}"
_ACRONYM = r"[A-Z][A-Z0-9]{1,7}"


@dataclass
class Ingested:
    pages: DataFrame
    chunks: DataFrame
    acronyms: DataFrame
    progress: DataFrame


def pages_to_markdown(pages: DataFrame) -> DataFrame:
    """(page_id, source_url, site_id, page_title, markdown, content_hash, language) of (page_id, url, html)."""
    rows = pages.select("page_id", F.col("url").alias("source_url"), html.site(F.col("url")).alias("site_id"), html.title(F.col("html")).alias("page_title"), html.markdown(F.col("html")).alias("markdown"))
    return rows.withColumn("content_hash", F.sha2("markdown", 256)).withColumn("language", text.site_language(F.col("markdown")))


def acronyms(docs: DataFrame, site: str = "site_id", body: str = "text", order: str = "page_id") -> DataFrame:
    """(site_id, acronym, full_name): definitions in both directions whose initials agree; the first of a site wins."""
    found = []
    for n, (pattern, name, short) in enumerate(((rf"(?U)\b({_NAME})\s*\(({_ACRONYM})\)", 1, 2), (rf"(?U)\b({_ACRONYM})\s*\(({_NAME})\)", 2, 1))):
        names = F.regexp_extract_all(F.col(body), F.lit(pattern), F.lit(name))
        shorts = F.regexp_extract_all(F.col(body), F.lit(pattern), F.lit(short))
        found.append(docs.select(F.col(site).alias("site_id"), F.col(order).alias("page"), F.posexplode(F.arrays_zip(names.alias("full_name"), shorts.alias("acronym"))).alias("pos", "d")).select("site_id", F.struct("page", F.lit(n).alias("way"), "pos").alias("seq"), F.col("d.acronym").alias("acronym"), F.trim(F.col("d.full_name")).alias("full_name")))
    both = found[0].unionByName(found[1]).where(text.initials_spell(F.col("full_name"), F.col("acronym")))
    return first_wins([both], ["site_id", "acronym"], "full_name", "seq")


def glossary_chunks(table: DataFrame, glosses: DataFrame | None = None) -> DataFrame:
    """One chunk a site under the address /_glossary: its acronyms in order."""
    rows = table.withColumn("gloss", F.lit(None).cast("string")) if glosses is None else table.join(small(glosses), "acronym", "left")
    lines = rows.select("site_id", "acronym", text.glossary_line(F.col("acronym"), F.col("full_name"), F.col("gloss")).alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("acronym", "line"))), lambda x: x.line), "\n")
    return lines.groupBy("site_id").agg(body.alias("text")).select("site_id", F.concat(F.lit("https://"), "site_id", F.lit("/_glossary")).alias("source_url"), F.lit("multi").alias("language"), F.lit("Glossary").alias("section_title"), F.lit(0).alias("chunk_index"), "text", F.sha2(F.concat("site_id", F.lit("::glossary::"), "text"), 256).alias("chunk_hash"))


def ingest(pages: DataFrame, batch: str, now: Column, known: DataFrame | None = None, embed: Callable[[Column], Column] | None = None, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> Ingested:
    """known has (source_url, content_hash): unchanged pages are not cut or embedded again."""
    found = pages_to_markdown(pages).where(F.trim("markdown") != "")
    if known is not None:
        found = found.join(known.select("source_url", "content_hash"), ["source_url", "content_hash"], "left_anti")
    # made once for chunks, acronyms and progress
    guarded = written(guard_pages(found), "guarded-pages")
    clean = guarded.where("passed").withColumn("text", text.normalized(F.col("text")))
    cut = clean.select("page_id", "source_url", "site_id", "page_title", "language", chunking.split_markdown(F.col("text"), size).alias("pieces"))
    chunks = chunking.chunks(cut, "pieces", overlap, size).withColumn("ingestion_batch_id", F.lit(batch)).withColumn("last_updated", now)
    chunks = chunks.withColumn("embedding", (embed or embedder())(F.col("text")))
    progress = guarded.agg(F.count(F.lit(1)).alias("pages"), F.count_if("passed").alias("ingested"), F.count_if(~F.col("passed")).alias("dropped"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("low", "med", "high")])
    return Ingested(guarded, chunks, acronyms(clean), progress)
