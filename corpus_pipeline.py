"""A corpus pipeline of five stages over the table `documents`; each works on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import decontam, language_id, line_dedup, minhash, packing
from corpusflow.llm.shared import BROADCAST_ROWS, Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _small(rows: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has few rows; else Spark shuffles both sides."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language stay. A row is decided by its text and source, so equal rows go together."""
    keyed = docs.select(*COLUMNS, minhash.text_key("text").alias("__row"))
    given = keyed.select("text", "source", F.col("__row").alias("row"))
    found = language_id.identify_fitted(given, docs, keep=["row", "source"], host="source")
    gone = _small(Scratch(spark, "language-gone").table(found.where("not lang_accepted").select(F.col("row").alias("__of"), F.col("source").alias("__source")).distinct(), "gone"))
    return keyed.join(gone, (F.col("__row") == F.col("__of")) & F.col("source").eqNullSafe(F.col("__source")), "left_anti").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 10 documents go; n_chars is counted anew. Every document stays, even without text."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS), min_docs=10)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest id, then the smallest text key. Null ids
    come last, and of repeated rows one stays."""
    scratch = Scratch(spark, "near-copies")
    rows = scratch.table(minhash.near_duplicates(docs, words=5, percent=80).select("component", "doc_id", "row", "n_shingles"), "groups")
    grouped = rows.where("n_shingles > 0").groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first")).where("n > 1")
    mark = ((F.col("doc_id").eqNullSafe(F.col("first.doc_id"))) & (F.col("row") == F.col("first.row"))).alias("is_first")
    marked = rows.join(scratch.table(grouped, "first"), "component").select("doc_id", "row", mark).groupBy("doc_id", "row", "is_first").agg(F.count(F.lit(1)).alias("n"))
    # of each id and text: all rows go, or one of several stays
    marked = scratch.table(marked.where("not is_first or n > 1").select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), "is_first"), "marked")
    keyed = docs.select(*COLUMNS, minhash.text_key("text").alias("__row"))
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    one = _small(marked.select("__id", F.col("__row").alias("__of"), "is_first"))
    left = keyed.join(one, (F.col("__row") == F.col("__of")) & same, "left")
    repeated = left.where("is_first").dropDuplicates(["doc_id", "__row"])
    return left.where("is_first is null").unionByName(repeated).select(*COLUMNS)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.without_items(docs.select(*COLUMNS), items).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows: one row a piece."""
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=2)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark_free", benchmark_free), ("packed", packed)]
#: Tokenizing and the language model are not expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a written table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
