"""The retrieve plan: guarded questions, hybrid search, rerank, documents for a prompt."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.models import pair_scorer
from corpusflow.operators import retrieval
from corpusflow.operators.guards import guard_queries


def bounded(top_k: int, top_n: int) -> tuple[int, int]:
    if not 1 <= top_k <= 100 or not 1 <= top_n <= 25:
        raise ValueError("top_k is 1 to 100, top_n 1 to 25")
    return top_k, min(top_n, top_k)


def bounded_columns(top_k: Column, top_n: Column) -> Column:
    """struct(top_k, top_n) as bounded() has them, for requests in a table; null where a bound or a number is missed."""
    fits = top_k.between(1, 100) & top_n.between(1, 25)
    return F.when(fits, F.struct(top_k.alias("top_k"), F.least(top_n, top_k).alias("top_n")))


def retrieve(docs: DataFrame, vectors: DataFrame, questions: DataFrame, embed: Callable[[Column], Column], top_k: int = 10, top_n: int = 3, acronyms: DataFrame | None = None, where: Column | None = None, score: Callable[[Column, Column], Column] | None = None, hypothesis: Column | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score, text) for questions (query_id, message) that pass the guard.

    The canonical form of a question is searched. A hypothesis, if given, is embedded in its place.
    """
    top_k, top_n = bounded(top_k, top_n)
    guarded = guard_queries(questions).where("passed").select("query_id", F.col("redacted_text").alias("query"))
    queries = guarded.withColumn("query_vector", embed(F.col("query") if hypothesis is None else F.coalesce(hypothesis, F.col("query"))))
    hits = retrieval.hybrid(docs, vectors, queries, top_k, where, acronyms, embed)
    texts = hits.join(docs.select("doc_id", "text"), "doc_id").join(queries.select("query_id", "query"), "query_id")
    return retrieval.reranked(texts, (score or pair_scorer())(F.col("query"), F.col("text")), top_n).select("query_id", "rank", "doc_id", "score", "text")


def no_context(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """questions with event: answer, or no_context for those without a hit."""
    found = hits.select("query_id").distinct().withColumn("__hit", F.lit(True))
    return questions.join(found, "query_id", "left").withColumn("event", F.when(F.col("__hit"), "answer").otherwise("no_context")).drop("__hit")
