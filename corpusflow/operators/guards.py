"""Guards over pages, questions and answers: verdict columns passed, severity, reasons, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import pii, text
from corpusflow.functions.disguise import undisguise
from corpusflow.functions.models import lexicon_risk
from corpusflow.functions.scalars import dot
from corpusflow.operators.retrieval import small

MAX_PAGE_BYTES = 2 << 20
HIGH, MED, SCOPE, FAITHFUL, TOXIC = 0.9, 0.5, 0.20, 0.55, 0.7
LANGUAGES = ["id", "en"]
# Signals that count as ways of disguise.
CATEGORIES = ["homoglyph", "emoji_cipher", "base64_block", "hex_block", "morse_block", "rot13", "leetspeak"]


def _reasons(*parts: Column) -> Column:
    return F.array_compact(F.array(*parts))


def _two(score: Column) -> Column:
    return F.format_string("%.2f", score)


def without_offsite_links(markdown: Column, site: Column) -> tuple[Column, Column]:
    """(text with links to other sites replaced by their words, how many). Sub-domains belong to the site."""
    own = F.concat(F.lit(r"https?://(?:[^/)]*\.)?\Q"), site, F.lit(r"\E(?=[/)])"))
    link = F.concat(F.lit(r"\[([^\]]*)\]\((?!"), own, F.lit(r")https?://[^)]+\)"))
    return F.regexp_replace(markdown, link, "$1"), F.regexp_count(markdown, link)


def guard_pages(pages: DataFrame, risk: Column | None = None, allowed: Column | None = None, languages: list[str] = LANGUAGES) -> DataFrame:
    """pages (markdown, site_id, language) with verdict: size, off-site links, injection, personal data."""
    clean, links = without_offsite_links(F.col("markdown"), F.col("site_id"))
    rows = pages.withColumn("__clean", clean).withColumn("__links", links)
    rows = rows.withColumn("__risk", F.when(F.col("language").isin(languages), lexicon_risk(F.col("__clean")) if risk is None else risk))
    rows = rows.withColumn("__marked", pii.marked(F.col("__clean"), allowed=allowed)).withColumn("__types", pii.types_of(F.col("__marked")))
    big = F.octet_length("markdown") > MAX_PAGE_BYTES
    bad = F.coalesce(F.col("__risk") >= HIGH, F.lit(False))
    links_said = F.when(F.col("__links") > 0, F.concat(F.lit("offsite_links_stripped:"), F.col("__links")))
    risk_said = F.when(F.col("__risk") >= HIGH, F.concat(F.lit("prompt_injection:"), _two(F.col("__risk")))).when(F.col("__risk") >= MED, F.concat(F.lit("prompt_injection_warn:"), _two(F.col("__risk")))).when(F.col("__risk").isNull(), F.concat(F.lit("prompt_injection_skipped:lang="), F.col("language")))
    pii_said = F.when(F.size("__types") > 0, F.concat(F.lit("pii_redacted:"), F.array_join("__types", ",")))
    reasons = F.when(big, F.array(F.lit("size_exceeded"))).when(bad, _reasons(links_said, risk_said)).otherwise(_reasons(links_said, risk_said, pii_said))
    severity = F.when(big | bad, "high").when(F.size(reasons) > 0, "med").otherwise("low")
    return rows.withColumn("passed", ~(big | bad)).withColumn("severity", severity).withColumn("reasons", reasons).withColumn("text", pii.unmarked(F.col("__marked"))).drop("__clean", "__links", "__risk", "__types", "__marked")


def topic_similarity(queries: DataFrame, centroids: DataFrame, site: str = "site_id") -> DataFrame:
    """queries with similarity to their site's centroid; null for a site without one."""
    return queries.join(small(centroids), site, "left").withColumn("similarity", F.round(dot(F.col("query_vector"), F.col("centroid")), 6)).drop("centroid")


def guard_queries(queries: DataFrame, similarity: Column | None = None, allowed: Column | None = None) -> DataFrame:
    """queries (message) with canonical, passed, severity, reasons and redacted text.

    Refused: invisible characters, Morse, blocks that do not decode, two kinds of disguise, injection, off topic.
    """
    rows = queries.withColumn("__u", undisguise(F.col("message"))).withColumn("canonical", F.col("__u.canonical"))
    signal = lambda k: F.coalesce(F.element_at("__u.signals", k), F.lit(0))
    undecoded = signal("base64_undecodable") + signal("hex_undecodable")
    kinds = sum((F.when(signal(k) > 0, 1).otherwise(0) for k in CATEGORIES), F.lit(0))
    rows = rows.withColumn("language", text.site_language(F.col("canonical")))
    rows = rows.withColumn("__risk", F.when(F.col("language").isin(LANGUAGES), lexicon_risk(F.col("canonical")))).withColumn("__marked", pii.marked(F.col("canonical"), allowed=allowed)).withColumn("__types", pii.types_of(F.col("__marked")))
    off = F.lit(False) if similarity is None else F.coalesce(similarity < SCOPE, F.lit(False))
    refused = (
        F.when(signal("zero_width_or_bidi") > 0, F.concat(F.lit("obfuscation:zero_width_or_bidi:"), signal("zero_width_or_bidi")))
        .when(signal("morse_block") > 0, F.concat(F.lit("obfuscation:morse_block:"), signal("morse_block")))
        .when(undecoded >= 1, F.concat(F.lit("obfuscation:undecodable_block:"), undecoded))
        .when(kinds >= 2, F.concat(F.lit("obfuscation:multi_category:"), kinds))
        .when(F.col("__risk") >= HIGH, F.concat(F.lit("prompt_injection:"), _two(F.col("__risk"))))
        .when(off, F.concat(F.lit("scope_drift:"), _two(F.lit(0.0) if similarity is None else similarity)))
    )
    told = F.when(F.size("__u.transforms") > 0, F.concat(F.lit("normalized:"), F.array_join("__u.transforms", ",")))
    warned = F.when(kinds == 1, F.lit("obfuscation_warn"))
    risky = F.when((F.col("__risk") >= MED) & (F.col("__risk") < HIGH), F.concat(F.lit("prompt_injection_warn:"), _two(F.col("__risk"))))
    private = F.when(F.size("__types") > 0, F.concat(F.lit("pii_redacted:"), F.array_join("__types", ",")))
    reasons = F.when(refused.isNotNull() & ~off, _reasons(told, refused)).otherwise(_reasons(told, warned, risky, private, refused))
    severity = F.when(refused.startswith("scope_drift"), "med").when(refused.isNotNull(), "high").when(F.size(reasons) > 0, "med").otherwise("low")
    return rows.withColumn("passed", refused.isNull()).withColumn("severity", severity).withColumn("reasons", reasons).withColumn("redacted_text", pii.unmarked(F.col("__marked"))).drop("__u", "__risk", "__types", "__marked")


def valid_citations(citations: DataFrame, hits: DataFrame) -> DataFrame:
    """Citations (answer_id, url, snippet) of retrieved addresses, with whether the snippet is in the hit's text."""
    known = hits.groupBy("answer_id", F.col("source_url").alias("url")).agg(F.collect_list("text").alias("__texts"))
    return citations.where(F.coalesce("snippet", F.lit("")) != "").join(known, ["answer_id", "url"]).withColumn("snippet_found", F.exists("__texts", lambda t: F.contains(t, F.col("snippet")))).drop("__texts")


def best_chunk(sentences: DataFrame, chunks: DataFrame) -> DataFrame:
    """(answer_id, seq, sentence, best): the highest cosine of a sentence to its answer's chunks, 0 without any."""
    pairs = sentences.join(chunks.select("answer_id", F.col("vector").alias("__v")), "answer_id", "left")
    return pairs.groupBy("answer_id", "seq", "sentence").agg(F.max(F.coalesce(dot(F.col("vector"), F.col("__v")), F.lit(0.0))).alias("best"))


def faithful(sentences: DataFrame, chunks: DataFrame, threshold: float = FAITHFUL) -> DataFrame:
    """Answers with the sentences (answer_id, seq, sentence, vector) close enough to a chunk (answer_id, vector).
    best_chunk() has each sentence's closest.

    More than half stripped, or none kept, is a refusal in the answer's language.
    """
    best = best_chunk(sentences, chunks)
    ok = F.col("best") >= threshold
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "sentence"))), lambda x: x.sentence), " ")
    kept = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("seq", "sentence")))), lambda x: x.sentence), " ")
    counted = best.groupBy("answer_id").agg(F.count_if(~ok).alias("stripped"), F.count(F.lit(1)).alias("n"), whole.alias("__whole"), kept.alias("__kept"))
    refuse = (F.col("stripped") > F.col("n") * 0.5) | (F.col("stripped") == F.col("n"))
    return counted.withColumn("answer", F.when(refuse, text.refusal_for(F.col("__whole"))).otherwise(F.col("__kept"))).withColumn("refused", refuse).drop("__whole", "__kept")


def guard_answers(answers: DataFrame, toxicity: Column, allowed: Column | None = None) -> DataFrame:
    """answers (answer, stripped, dropped_citations) with the last checks: toxicity, then personal data."""
    toxic = F.array_sort(F.map_keys(F.map_filter(toxicity, lambda k, v: v >= TOXIC)))
    rows = answers.withColumn("__toxic", toxic).withColumn("__marked", pii.marked(F.col("answer"), allowed=allowed)).withColumn("__types", pii.types_of(F.col("__marked")))
    bad = F.size("__toxic") > 0
    said = [F.when(F.col("dropped_citations") > 0, F.concat(F.lit("hallucinated_citations_dropped:"), F.col("dropped_citations"))), F.when(F.col("stripped") > 0, F.concat(F.lit("faithfulness_strip:"), F.col("stripped"), F.lit("_sentences")))]
    private = F.when(F.size("__types") > 0, F.concat(F.lit("pii_redacted_in_response:"), F.array_join("__types", ",")))
    reasons = F.when(bad, _reasons(*said, F.concat(F.lit("toxic:"), F.array_join("__toxic", ",")))).otherwise(_reasons(*said, private))
    final = F.when(bad, text.refusal_for(F.col("answer"))).otherwise(pii.unmarked(F.col("__marked")))
    severity = F.when(bad, "high").when(F.size(reasons) > 0, "med").otherwise("low")
    return rows.withColumn("passed", ~bad).withColumn("severity", severity).withColumn("reasons", reasons).withColumn("answer", final).drop("__toxic", "__types", "__marked")
