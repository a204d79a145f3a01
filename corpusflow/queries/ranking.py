"""Queries over retrieval: BM25, cosine, fusion, centroids, citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.functions.models import embedder
from corpusflow.functions.scalars import dot
from corpusflow.operators import intel, retrieval
from corpusflow.queries.registry import NOW, query
from corpusflow.operators.text_index import TextIndex
from corpusflow.operators.vector_index import VectorIndex
from corpusflow.session import scratch_path, table

_Q = "(select item_id as query_id, text as query from benchmark where item_id % 10 = 0)"

_BM25 = rf"""corpus as (select doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') as words from documents {{where}}),
stats as (select count(*) as n, avg(len(words)) as mean_length from corpus),
terms as (select query_id, term, count(*) as times from (select query_id, unnest(list_filter(string_split_regex(lower(query), '\s+'), lambda x: x <> '')) as term from {_Q}) group by all),
flat as (select doc_id, len(words) as length, unnest(words) as term from corpus),
tf as (select doc_id, length, term, count(*) as tf from flat group by all),
df as (select term, count(*) as df from tf group by term),
raw as (select term, ln(n - df + 0.5) - ln(df + 0.5) as idf from df, stats),
idf as (select term, case when idf < 0 then 0.25 * (select avg(idf) from raw) else idf end as idf from raw),
scored as (select query_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))) as score from terms join idf using (term) join tf using (term), stats group by all),
sparse as (select query_id, doc_id, round(coalesce(score, 0), 6) as score from (select query_id, doc_id from corpus, (select distinct query_id from terms)) left join scored using (query_id, doc_id) qualify row_number() over (partition by query_id order by round(coalesce(score, 0), 6) desc, doc_id) <= 10)"""

_DOT = "list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda x: x[1]::double * x[2]::double))"


def _questions(spark, sf_dir):
    """Every tenth item as a question."""
    return table(spark, sf_dir, "benchmark").where("item_id % 10 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _vector_queries(spark, sf_dir):
    """Every fiftieth vector as a question."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query(f"with {_BM25.format(where='')} select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from sparse")
def agg04_bm25_top10(spark, sf_dir):
    return retrieval.bm25(table(spark, sf_dir, "documents"), _questions(spark, sf_dir))


@query(f"with {_BM25.format(where='')} select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from sparse")
def jn05_indexed_bm25(spark, sf_dir):
    """An index in two generations, then the questions of agg04 from their words' postings alone."""
    docs, index = table(spark, sf_dir, "documents"), TextIndex(spark, scratch_path(spark, "text-index"))
    for name, rows in (("even", docs.where("doc_id % 2 = 0")), ("odd", docs.where("doc_id % 2 = 1"))):
        index.add(rows, name)
    return index.search(_questions(spark, sf_dir))


@query(f"""with {_BM25.format(where="where source = 'src1'")} select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from sparse""")
def flt05_bm25_one_site(spark, sf_dir):
    return retrieval.bm25(table(spark, sf_dir, "documents").where("source = 'src1'"), _questions(spark, sf_dir))


_TOP10 = f"""select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from
(select q.vec_id as query_id, v.vec_id as doc_id, round({_DOT}, 6) as score from embeddings v, embeddings q where q.vec_id % 50 = 0) qualify rank <= 10"""


@query(_TOP10)
def jn04_cosine_top10(spark, sf_dir):
    return retrieval.nearest(table(spark, sf_dir, "embeddings"), _vector_queries(spark, sf_dir))


@query(_TOP10)
def top03_indexed_top10(spark, sf_dir):
    """The questions of jn04 over an index: rows that the bounds exclude are not scored, and the result is exact."""
    index = VectorIndex(spark, scratch_path(spark, "vector-index"))
    vectors = table(spark, sf_dir, "embeddings")
    index.build(vectors.where("vec_id % 4 > 0"))
    index.add(vectors.where("vec_id % 4 = 0"))
    return index.search(_vector_queries(spark, sf_dir))


@query(f"""with e as (select distinct event_id % 997 as vec_id from events where ts >= timestamp '{NOW}' - interval 15 day and event_type = 'error')
select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from
(select q.vec_id as query_id, v.vec_id as doc_id, round({_DOT}, 6) as score from embeddings v join e using (vec_id), embeddings q where q.vec_id % 50 = 0) qualify rank <= 10""")
def flt04_since_then_top10(spark, sf_dir):
    from corpusflow.functions.scalars import since_cutoff

    recent = table(spark, sf_dir, "events").where((F.col("ts") >= since_cutoff(F.lit("15d"), F.lit(NOW).cast("timestamp"))) & (F.col("event_type") == "error")).select((F.col("event_id") % 997).alias("vec_id"))
    return retrieval.nearest(table(spark, sf_dir, "embeddings").join(recent, "vec_id", "left_semi"), _vector_queries(spark, sf_dir))


@query(f"""with {_BM25.format(where='')},
dense as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as rank from (select q.vec_id as query_id, v.vec_id as doc_id, round({_DOT}, 6) as score from embeddings v, embeddings q where q.vec_id in (select query_id from {_Q})) qualify rank <= 10),
lists as (select query_id, doc_id, rank, 0 as list from dense union all select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id), 1 from sparse),
f as (select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 9) as score, min({{'list': list, 'rank': rank}}) as first from lists group by all)
select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, first, doc_id) as rank from f qualify rank <= 10""")
def ret01_hybrid_rrf(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    questions = _questions(spark, sf_dir).join(vectors, "query_id")
    return retrieval.hybrid(table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings"), questions)


@query("select label, pos, round(avg(v), 6) as mean from (select label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as pos from embeddings) group by all")
def agg05_centroids(spark, sf_dir):
    c = retrieval.centroids(table(spark, sf_dir, "embeddings"))
    return c.select("label", F.posexplode("centroid").alias("pos", "v")).select("label", F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("mean"))


@query("""with c as (select label, pos, avg(v) as m from (select label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as pos from embeddings) group by all),
q as (select vec_id, label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as pos from embeddings)
select vec_id, round(sum(v * m), 6) as similarity from q join c using (label, pos) group by vec_id""")
def grd03_topic_similarity(spark, sf_dir):
    from corpusflow.operators.guards import topic_similarity

    vectors = table(spark, sf_dir, "embeddings")
    return topic_similarity(vectors.withColumnRenamed("embedding", "query_vector"), retrieval.centroids(vectors), "label").select("vec_id", "similarity")


@query(f"""select v.vec_id, round(coalesce(max({_DOT}), 0.0), 6) as best from embeddings v left join (select * from embeddings where vec_id % 50 = 0) q on v.label = q.label group by 1""")
def jn06_best_cosine(spark, sf_dir):
    """Each vector as a sentence, every fiftieth as a chunk of its label's answer."""
    from corpusflow.operators.guards import best_chunk

    vectors = table(spark, sf_dir, "embeddings")
    said = vectors.select(F.col("label").alias("answer_id"), F.col("vec_id").alias("seq"), F.lit("").alias("sentence"), F.col("embedding").alias("vector"))
    chunks = vectors.where("vec_id % 50 = 0").select(F.col("label").alias("answer_id"), F.col("embedding").alias("vector"))
    return best_chunk(said, chunks).select(F.col("seq").alias("vec_id"), F.round("best", 6).alias("best"))


@query(f"""with h as (select q.vec_id as search, v.vec_id as base_id, round(round({_DOT}, 6), 4) as score from embeddings v, embeddings q where q.vec_id % 50 = 0 qualify row_number() over (partition by q.vec_id order by round({_DOT}, 6) desc, v.vec_id) <= 20)
select base_id, score, search from h qualify row_number() over (partition by base_id order by score desc, search) = 1""")
def jn15_best_of_searches(spark, sf_dir):
    hits = retrieval.nearest(table(spark, sf_dir, "embeddings"), _vector_queries(spark, sf_dir), k=20)
    return intel.best_of_searches(hits.select(F.col("query_id").alias("search"), F.col("doc_id").alias("base_id"), F.round("score", 4).alias("score"))).select("base_id", "score", "search")


_CODES = "(select n_nationkey, n_name, 'N' || lpad(n_nationkey::varchar, 2, '0') as code from nation)"


def _codes(spark, sf_dir):
    code = F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", code.alias("code"))


@query(f"""select n_nationkey as query_id, 0 as variant_no, 'who is ' || code || '?' as query from {_CODES} where n_nationkey % 2 = 0 union all select n_nationkey, 1, 'who is ' || n_name || '?' from {_CODES} where n_nationkey % 2 = 0
union all select n_nationkey, 0, 'is ' || lower(n_name) || ' near' from {_CODES} where n_nationkey % 2 = 1 union all select n_nationkey, 1, 'is ' || code || ' near' from {_CODES} where n_nationkey % 2 = 1""")
def jn03_query_variants(spark, sf_dir):
    names = _codes(spark, sf_dir)
    asked = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("who is "), "code", F.lit("?"))).otherwise(F.concat(F.lit("is "), F.lower("n_name"), F.lit(" near")))
    out = retrieval.variants(names.select(F.col("n_nationkey").alias("query_id"), asked.alias("query")), names.select(F.col("code").alias("acronym"), F.col("n_name").alias("full_name")))
    return out.select("query_id", F.col("variant_no").cast("int").alias("variant_no"), "query")


@query("select doc_id as answer_id, 0 as seq, 0 as citation_no, md5(text) as text_md5 from documents union all select doc_id, 3, 1, md5(source) from documents")
def jn07_citations(spark, sf_dir):
    """Of four citations of each answer one repeats and one points nowhere."""
    docs = table(spark, sf_dir, "documents")
    given = [(0, 0, 10, 15), (1, 0, 10, 15), (2, 99, 0, 5), (3, 1, 20, 25)]
    rows = F.array(*[F.struct(F.lit(a).alias("seq"), F.lit(b).alias("document_index"), F.lit(c).alias("start_char"), F.lit(d).alias("end_char")) for a, b, c, d in given])
    citations = docs.select(F.col("doc_id").alias("answer_id"), F.explode(rows).alias("c")).select("answer_id", "c.*", F.lit("x").alias("cited_text"))
    hits = docs.select(F.col("doc_id").alias("answer_id"), F.posexplode(F.array("text", "source")).alias("position", "text"))
    return retrieval.cited(citations, hits).select("answer_id", "seq", "citation_no", F.md5("text").alias("text_md5"))


@query(f"select n_nationkey, '- ' || code || ' = ' || n_name || case when n_nationkey % 2 = 0 then ' (' || lower(n_name) || ')' else '' end as line from {_CODES}")
def str23_glossary_lines(spark, sf_dir):
    from corpusflow.functions.text import glossary_line

    gloss = F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name"))
    return _codes(spark, sf_dir).select("n_nationkey", glossary_line(F.col("code"), F.col("n_name"), gloss).alias("line"))


@query()
def ret04_retrieve(spark, sf_dir):
    """The plan from question to ranked passages, over embedded documents."""
    from corpusflow.plans.retrieve import retrieve

    docs = table(spark, sf_dir, "documents")
    embed = embedder()
    vectors = docs.select(F.col("doc_id").alias("vec_id"), embed(F.col("text")).alias("embedding"))
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("message"))
    return retrieve(docs, vectors, questions, embed)
