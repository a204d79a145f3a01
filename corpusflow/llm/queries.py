"""The registered queries over the operators of this subpackage, and their DuckDB SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from corpusflow.llm import audio, decontam, hard_negatives, importance, language_id, license_scan, line_dedup, minhash, packing, piece_bpe, sharding, token_counts, warc_zip
from corpusflow.llm.shared import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs, min_docs=10, min_chars=1, null_as_empty=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    shuffled = sharding.shuffle_into_shards(docs, "doc_id", "text", shards=40)
    out = sharding.write_shards(shuffled, Scratch(spark, "shards").path("written"))
    return out.select("doc_id", "size", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.contained_items(docs, _table(spark, sf_dir, "benchmark"), words=5, threshold=0.8)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=2)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.counted(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.texts_as_audio(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc_zip.write_packages(_table(spark, sf_dir, "pages"), min_revisit_bytes=0)
    records = warc_zip.read_packages(manifest)
    return records.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, words=4, percent=80).drop("component", "row")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return license_scan.scan(docs.select("doc_id", "text", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path")))


#: Markup, and what it hides.
_TAGS = r"(?is)<script\b.*?(?:</script|\z)|<style\b.*?(?:</style|\z)|<[^<>]*>"
_LANG = r"(?i)<(?:html|body|article)\b[^>]*?\b(?:xml:)?lang\s*=\s*[\"']?([A-Za-z]{2,3})\b"


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their source as host, and pages with their address and declared language; the other id is null."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    pages = _table(spark, sf_dir, "pages")
    said = F.nullif(F.regexp_extract("html", _LANG, 1), F.lit(""))
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    pages = pages.select("page_id", "url", F.regexp_replace("html", _TAGS, " ").alias("text"), said.alias("said"), host.alias("host"))
    both = docs.select("doc_id", "text", F.col("source").alias("host")).unionByName(pages, allowMissingColumns=True)
    out = language_id.identify_fitted(both, docs, keep=["doc_id", "page_id"], host="host", url="url", declared="said")
    return out.select("doc_id", "page_id", "lang_id", "lang_posterior", "lang_accepted")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = piece_bpe.encoded(docs, model).select("doc_id", "ids")
    out = piece_bpe.decoded(ids, model)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", noisy.alias("label"))
    return hard_negatives.mined(rows, F.col("vec_id") % 50 == 0, positives=5, negatives=3, lowest=50, highest=95, scale=256)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=5, min_words=20)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_line_dedup": op2_line_dedup,
    "op3_language_id": op3_language_id,
    "op4_packing": op4_packing,
    "op5_warc": op5_warc,
    "op6_sharding": op6_sharding,
    "op7_minhash": op7_minhash,
    "op8_token_counts": op8_token_counts,
    "op9_media_columns": op9_media_columns,
    "op10_decontamination": op10_decontamination,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_importance": op13_importance,
    "pipeline": pipeline,
}
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _shingle_sql(text: str) -> str:
    """The distinct five-word runs of a text, as a list."""
    words = f"list_filter(string_split_regex(translate(coalesce({text}, ''), {_AZ}), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    return f"(select list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) from (select {words} as w))"


ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": f"""with l as (select doc_id, rowid as r, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from (select *, row_number() over () as rowid from documents)),
k as (select *, translate(trim(line, {_WHITE}), {_AZ}) as key from l),
f as (select key from k where length(key) >= 1 group by key having count(distinct r) >= 10)
select doc_id, count(*) as n_lines, count(f.key) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where f.key is null), '')) as kept_sha256 from k left join f using (key) group by doc_id, r""",
    "op12_hard_negatives": """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
a as (select vec_id as anchor_id, label, q from v where vec_id % 50 = 0),
s as (select anchor_id, v.vec_id, a.label = v.label as same, list_dot_product(a.q, v.q)::bigint as score from a join v on v.vec_id <> anchor_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select p.*, vec_id as negative_id, score as negative_score, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3""",
    "op10_decontamination": f"""with d as (select doc_id, unnest({_shingle_sql('text')}) as s from documents where doc_id is not null),
i as (select item_id, {_shingle_sql('text')} as ss from benchmark), j as (select item_id, len(ss) as q, unnest(ss) as s from i)
select doc_id, item_id, q as item_shingles, count(*) as shared_shingles, round(count(*) / q, 6) as containment from d join j using (s) group by doc_id, item_id, q having count(*) >= ceil(q * 0.8 - 1e-9)""",
}
