"""The stored indexes against the operators that read everything."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.functions.scalars import dot
from corpusflow.operators import products, retrieval, text_index
from corpusflow.operators.text_index import TextIndex
from corpusflow.operators.vector_index import VectorIndex
from corpusflow.queries import ranking  # noqa: F401  it registers its queries
from corpusflow.queries.registry import QUERIES

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def corpus(spark, n, seed=1, first=0):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    text = lambda: " ".join(rnd.choice(words[: rnd.choice([3, 10, 60])]) for _ in range(rnd.randint(0, 80)))
    return spark.createDataFrame([(first + i, text()) for i in range(n)], "doc_id long, text string").repartition(3)


@pytest.fixture
def questions(spark):
    return spark.createDataFrame([(1, "W0 w1 w1 w59"), (2, "w40  w41\tw42"), (3, "nothing here"), (4, "w0")], "query_id long, query string")


def test_text_index_equals_bm25(spark, tmp_path, questions, monkeypatch):
    """Over generations that are added, replaced and dropped, with blocks small enough that some are out of reach."""
    monkeypatch.setattr(text_index, "SLOT_DOCS", 4)
    monkeypatch.setattr(text_index, "FIRST_SLOTS", 2)
    a, b, c = corpus(spark, 150, 1), corpus(spark, 90, 2, 1000), corpus(spark, 40, 3, 1000)
    index = TextIndex(spark, str(tmp_path / "index"))
    assert index.search(questions).count() == 0
    index.add(a, "a")
    index.add(b, "b")
    assert index.generations() == ["a", "b"]
    assert rows(index.search(questions, 5)) == rows(retrieval.bm25(a.unionByName(b), questions, 5))
    assert rows(index.search(questions, 5, ["b"])) == rows(retrieval.bm25(b, questions, 5))
    with pytest.raises(ValueError):
        index.add(c, "c")  # ids of b
    index.add(c, "b")
    again = TextIndex(spark, str(tmp_path / "index"))
    assert rows(again.search(questions, 400)) == rows(retrieval.bm25(a.unionByName(c), questions, 400))
    again.drop("a")
    assert again.generations() == ["b"] and rows(again.search(questions)) == rows(retrieval.bm25(c, questions))


def test_text_index_odd_documents(spark, tmp_path, questions):
    index = TextIndex(spark, str(tmp_path))
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "w0 " * 50_000), (4, "w0 w1"), (5, "  ")], "doc_id long, text string")
    index.add(docs, "one")
    assert rows(index.search(questions)) == rows(retrieval.bm25(docs, questions))
    for bad in ([(None, "x")], [(7, "x"), (7, "y")]):
        with pytest.raises(ValueError):
            index.add(spark.createDataFrame(bad, "doc_id long, text string"), "two")
    assert index.generations() == ["one"]
    index.add(docs.limit(0), "none")
    assert rows(index.search(questions)) == rows(retrieval.bm25(docs, questions))


def test_text_index_reads_its_words_only(spark, tmp_path, questions):
    index = TextIndex(spark, str(tmp_path))
    index.add(corpus(spark, 50), "a")
    plan = index._table("postings", ["a"]).where(F.col("term").isin(["w40"]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan or "PushedFilters: [IsNotNull(term), EqualTo(term" in plan, plan
    for path in (tmp_path / "postings" / "generation=a").glob("*.parquet"):
        terms = [r.term for r in spark.read.parquet(str(path)).collect()]
        assert terms == sorted(terms)


def test_vector_index(spark, tmp_path):
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(12, 8))
    x = centres[rnd.integers(12, size=600)] + 0.1 * rnd.normal(size=(600, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[3].tolist()) for i in range(20)] + [(2000, [0.0] * 8), (2001, None)], "vec_id long, embedding array<float>").repartition(3)
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    whole = vectors.where("embedding is not null")
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.build(vectors.where("vec_id % 3 > 0"), lists=16, sample=200)
    index.add(vectors.where("vec_id % 3 = 0"))
    for k in (1, 10):
        assert rows(index.search(queries, k, probes=2)) == rows(retrieval.nearest(whole, queries, k))
    assert rows(index.search(queries, 900, probes=1)) == rows(retrieval.nearest(whole, queries, 900))  # fewer rows than k
    assert index.rows_in_reach(queries, 10, probes=2) < 0.5


def test_recall_of_some_lists(spark, tmp_path):
    """At least 0.95 of the 10 nearest of every fiftieth vector, from 40 of 64 lists: these vectors have no clusters."""
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.build(vectors)
    want = {(r.query_id, r.doc_id) for r in retrieval.nearest(vectors, queries).collect()}
    got = {(r.query_id, r.doc_id) for r in index.search(queries, probes=40, exact=False).collect()}
    assert len(want & got) >= 0.95 * len(want)


def plain(vectors, queries, k):
    """The k nearest from an expression over all pairs."""
    pairs = vectors.crossJoin(queries).select("query_id", F.col("vec_id").alias("doc_id"), F.round(dot(F.col("embedding"), F.col("query_vector")), 6).alias("score"))
    return retrieval.top_k(pairs, k)


def test_nearest_equals_all_pairs(spark, monkeypatch):
    """Copies, ties after rounding, nulls, odd lengths, NaN and infinity, in several blocks of questions and of rows."""
    monkeypatch.setattr(products, "BLOCK", 7)
    monkeypatch.setattr(products, "ROWS", 16)
    monkeypatch.setattr(products, "PAIRS", 50)
    rnd = np.random.default_rng(2)
    made = [(i, (rnd.integers(-3, 4, 4) / rnd.choice([4, 3000])).tolist()) for i in range(300)] + [(400 + i, [0.5, 0.25, 0.0, 1.0]) for i in range(90)]
    odd = [(500, None), (501, [1.0]), (502, [1.0, None, 0.0, 0.0]), (503, []), (504, [0.0] * 4), (505, [1e8, 1e8, 3e7, 0.1]), (0, [1.0, 0.0, 0.0, 0.0])]
    far = [(600, [float("nan"), 0.0, 0.0, 1.0]), (601, [float("inf"), 1.0, 1.0, 1.0])]
    vectors = spark.createDataFrame(made + odd + far, "vec_id long, embedding array<float>").repartition(3)
    queries = vectors.where("vec_id % 25 = 0 or vec_id > 500").select(F.struct("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    text = lambda df: sorted(map(repr, df.select("query_id", "rank", "doc_id", "score").collect()))
    for k in (1, 10, 500):
        assert text(retrieval.nearest(vectors, queries, k)) == text(plain(vectors, queries, k))
    assert retrieval.nearest(vectors, queries.limit(0)).count() == 0 and retrieval.nearest(vectors.limit(0), queries).count() == 0


def test_rounding_is_sparks(spark):
    x = np.concatenate([np.arange(-50, 50) / 2e6, np.random.default_rng(3).normal(size=500), [1.0000005, -2.5e-7, 0.0, 4503599627.3704965, 1e300, np.inf, -np.inf]])
    want = [r.v for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").select("i", F.round("x", 6).alias("v")).orderBy("i").collect()]
    assert products.rounded(x).tolist() == want


def test_nearest_makes_no_row_a_pair(spark):
    """The plan joins no question with every vector: such rows were sorted by question, and scored by an expression."""
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    plan = retrieval.nearest(vectors, queries)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "Cartesian" not in plan


def test_vector_index_joins_no_pairs(spark, tmp_path):
    """Lists meet their questions in matrix products, not in a join by list that holds all questions of a list."""
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.build(vectors)
    plan = index.search(queries)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
    assert rows(index.search(queries)) == rows(retrieval.nearest(vectors, queries))


def test_best_of_searches_makes_no_row_a_pair(spark):
    plan = QUERIES["jn15_best_of_searches"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "BroadcastNestedLoopJoin" not in plan and "Cartesian" not in plan


def test_bm25_in_blocks_of_questions(spark, monkeypatch):
    """Many words, blocks of a few questions, repeated and null ids: the same as formulas over dictionaries."""
    monkeypatch.setattr(products, "BLOCK_BYTES", 40_000)
    monkeypatch.setattr(products, "ROWS", 8)
    rnd = random.Random(5)
    word = lambda: f"w{int(rnd.paretovariate(0.5)) % 3000}"
    docs = [(i % 190 if i else None, " ".join(word() for _ in range(rnd.randint(0, 60)))) for i in range(200)] + [(900, None), (901, ""), (902, "zz zz"), (903, "zz zz")]
    asked = [(i, " ".join([word() for _ in range(9)] + ["zz"] * (i == 3))) for i in range(300)] + [(300, "unknown"), (301, None)]
    tf, n = {}, len(docs)
    for i, t in docs:
        for w in (t or "").split():
            key = (i, len(t.split()), w)
            tf[key] = tf.get(key, 0) + 1
    mean = sum(len(t.split()) for _, t in docs if t is not None) / (n - 1)
    df = {}
    for _, _, w in tf:
        df[w] = df.get(w, 0) + 1
    raw = {w: np.log(n - d + 0.5) - np.log(d + 0.5) for w, d in df.items()}
    idf = {w: v if v >= 0 else 0.25 * np.mean(list(raw.values())) for w, v in raw.items()}
    want = []
    for q, text in asked[:-1]:
        scores = {i: 0.0 for i, _ in docs}
        for (i, length, w), c in tf.items():
            scores[i] += text.split().count(w) * idf[w] * c * 2.5 / (c + 1.5 * (0.25 + 0.75 * length / mean))
        order = sorted(scores, key=lambda i: (-round(scores[i], 6), -1 if i is None else i))[:10]
        want += [(q, r + 1, i, round(scores[i], 6)) for r, i in enumerate(order)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = retrieval.bm25(frame, spark.createDataFrame(asked, "query_id long, query string"))
    assert [x for x in rows(got.where("doc_id is not null and query_id < 301"))] == sorted(x for x in want if x[2] is not None)
    assert got.where("query_id = 301").count() == 10


def test_bm25_makes_no_row_a_match(spark):
    """Matches of questions and documents are scored in matrix products; none is shuffled, or sorted to be grouped."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = retrieval.bm25(docs, spark.createDataFrame([(1, "the and")], "query_id long, query string"))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "Aggregate" not in plan


def test_text_index_lists_are_made_where_slots_are_read(spark, monkeypatch):
    """No row a word is shuffled: a slot's lists come from its own task, and hold what counting gives."""
    monkeypatch.setattr(text_index, "SLOT_DOCS", 4)
    words = corpus(spark, 30).select("doc_id", retrieval.tokens(F.col("text")).alias("words")).select("doc_id", F.size("words").alias("length"), "words")
    lists = text_index._inverted(words)
    assert "Exchange hashpartitioning" not in lists._jdf.queryExecution().executedPlan().toString()
    flat = lists.where("term is not null").select("term", "slot", "tf_max", "length_min", F.explode("docs").alias("d")).collect()
    want = {}
    for r in words.collect():
        for w in r.words:
            want[w, r.doc_id, r.length] = want.get((w, r.doc_id, r.length), 0) + 1
    assert {(r.term, r.d.doc_id, r.d.length): r.d.tf for r in flat} == want and len(flat) == len(want)
    assert all(r.tf_max >= r.d.tf and r.length_min <= r.d.length for r in flat)


def test_text_index_with_negative_weights(spark, tmp_path):
    """Where all words are in over half of the documents, one without a match may be better than one with some."""
    docs = spark.createDataFrame([(i, "a b" if i < 9 else "") for i in range(12)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b"), (2, "a")], "query_id long, query string")
    index = TextIndex(spark, str(tmp_path))
    index.add(docs, "one")
    assert rows(index.search(asked, 5)) == rows(retrieval.bm25(docs, asked, 5))
