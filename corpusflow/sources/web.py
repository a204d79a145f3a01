"""Web sources over pages that were fetched already: sitemaps, robots rules, crawl order, page acceptance."""

from __future__ import annotations

from collections.abc import Iterator
from urllib import robotparser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import html
from corpusflow.operators.state import reachable

MAX_PAGE_BYTES = 2 << 20


def _plain(xml: Column) -> Column:
    """Text of an element: CDATA opened, entities read."""
    out = F.regexp_replace(xml, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"^\s+|\s+$", ""))


def sitemap_urls(xml: Column, base: Column | None = None) -> Column:
    """array<struct<url,lastmod>> of a urlset, whatever its namespace; an index or broken XML gives none. Addresses are
    resolved against `base`, the sitemap's own."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(xml, r"(?s)<!--.*?-->", ""), r"\sxmlns(:\w+)?=(\"[^\"]*\"|'[^']*')", ""), r"<(/?)\w+:", "<$1")
    entries = F.regexp_extract_all(bare, F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1))
    one = lambda e, tag: _plain(F.regexp_extract(e, rf"(?s)<{tag}>(.*?)</{tag}>", 1))
    where = (lambda loc: loc) if base is None else (lambda loc: F.when(loc != "", html.absolute(base, loc)).otherwise(""))
    rows = F.transform(entries, lambda e: F.struct(where(one(e, "loc")).alias("url"), F.nullif(one(e, "lastmod"), F.lit("")).alias("lastmod")))
    whole = F.regexp_like(bare, F.lit(r"(?s)<urlset\b.*</urlset>\s*$")) & (F.regexp_count(bare, F.lit("<url>")) == F.regexp_count(bare, F.lit("</url>")))
    return F.when(whole, F.filter(rows, lambda r: r.url != "")).otherwise(F.array().cast("array<struct<url:string,lastmod:string>>"))


# Where a site's sitemap may be, in the order in which it is looked for.
SITEMAPS = ["/sitemap.xml", "/sitemap_index.xml"]


def discovered(fetched: DataFrame) -> DataFrame:
    """(site_id, url, lastmod) of the first of SITEMAPS that was fetched and is not empty.

    fetched has (site_id, path, status, xml); a status other than 200 counts as not fetched.
    """
    place = F.array_position(F.array(*[F.lit(x) for x in SITEMAPS]), F.col("path"))
    base = F.concat(F.lit("https://"), "site_id", "path")
    found = fetched.where((place > 0) & (F.col("status") == 200)).select("site_id", place.alias("place"), sitemap_urls(F.col("xml"), base).alias("urls")).where(F.size("urls") > 0)
    first = found.groupBy("site_id").agg(F.min_by("urls", "place").alias("urls"))
    return first.select("site_id", F.explode("urls").alias("u")).select("site_id", "u.url", "u.lastmod")


def accepted(pages: DataFrame, max_depth: int = 2) -> DataFrame:
    """pages (depth, allowed, content_type, status, html, markdown) that a crawl keeps."""
    kind = F.coalesce(F.lower(F.col("content_type")), F.lit(""))
    return pages.where((F.col("depth") <= max_depth) & F.col("allowed") & ((kind == "") | kind.rlike("html|markdown|plain")) & (F.octet_length("html") <= MAX_PAGE_BYTES) & (F.col("status") == 200) & (F.trim("markdown") != ""))


def link_table(pages: DataFrame) -> DataFrame:
    """(source, target): links that stay on their page's site, absolute."""
    found = pages.select("url", F.explode(html.links(F.col("html"))).alias("href")).select(F.regexp_replace("url", "#.*$", "").alias("source"), html.absolute(F.col("url"), F.col("href")).alias("target"))
    return found.where(html.site(F.col("source")) == html.site(F.col("target"))).distinct()


def crawled(pages: DataFrame, start: DataFrame, max_depth: int = 2, max_pages: int | None = 100) -> DataFrame:
    """(url, depth): breadth first from the start; the page limit, if any, keeps the nearest, then the first by address."""
    found = reachable(link_table(pages), start, max_depth)
    return found if max_pages is None else found.orderBy("depth", "url").limit(max_pages)


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str = "*") -> DataFrame:
    """urls with allowed; rules has (site_id, robots_txt). A site without rules allows all."""

    @F.pandas_udf("boolean")
    def allowed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        parsers: dict[str, robotparser.RobotFileParser] = {}
        for url, text in batches:
            out = []
            for u, t in zip(url, text, strict=True):
                if not t:
                    out.append(True)
                    continue
                if t not in parsers:
                    parsers[t] = robotparser.RobotFileParser()
                    parsers[t].parse(t.splitlines())
                out.append(parsers[t].can_fetch(agent, u))
            yield pd.Series(out)

    keyed = urls.withColumn("site_id", html.site(F.col("url"))).join(rules, "site_id", "left")
    return keyed.withColumn("allowed", allowed(F.col("url"), F.col("robots_txt"))).drop("robots_txt")


def token_bucket(requests: DataFrame, n: int, seconds: int, key: str = "user_id", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """requests with sent_at: when a bucket of n tokens, refilled evenly over `seconds`, lets each one through.

    With k requests before it in its key, a request waits for max over j of (its j-th predecessor's arrival plus the
    time that the tokens beyond the first n need): a running maximum, so no loop over rows.
    """
    from pyspark.sql import Window

    each = seconds / n
    w = Window.partitionBy(key).orderBy(ts, order)
    at = F.col(ts).cast("timestamp").cast("double")
    ranked = requests.withColumn("__i", F.row_number().over(w) - 1)
    # virtual finish: i * each + max over j <= i of (arrival_j - j * each); tokens in hand let n - 1 of them go early
    start = F.max(at - F.col("__i") * each).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__i") * each
    return ranked.withColumn("sent_at", F.greatest(at, start - (n - 1) * each)).drop("__i")
