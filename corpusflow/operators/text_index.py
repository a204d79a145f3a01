"""A BM25 index that is kept between questions: postings by term in blocks of documents, added to by generation.

A generation is a folder of four tables: `postings` (term, slot, tf_max, length_min, docs), sorted by term and slot so
that a scan for some terms skips the other row groups; `terms` (term, df); `documents` (doc_id, length); and `sums` (one
row), written last, without which a generation does not count. A slot is a block of about SLOT_DOCS documents of one
generation. Its tf_max and length_min bound what a term can add to the score of any document in it, whatever the mean
length becomes.

A search reads the bounds of the questions' terms, scores each question's most promising slots, takes the k-th best
score found as a threshold, and then reads only those slots whose bounds together reach it. The result equals that of
retrieval.bm25 over all documents of the generations asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.operators.retrieval import LITERALS, best_by_terms, small, tokens, top_k
from corpusflow.session import written

SLOT_DOCS = 128
#: Slots of a question that are scored first.
FIRST_SLOTS = 4
TABLES = ("postings", "terms", "documents", "sums")


class TextIndex:
    """root: a folder that driver and executors share. An index found there is used as it is."""

    def __init__(self, spark: SparkSession, root: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25):
        self.spark, self.root = spark, root.rstrip("/")
        self.k1, self.b, self.epsilon = k1, b, epsilon
        self._known: dict[tuple[str, ...], tuple[int, float, float]] = {}

    def generations(self) -> list[str]:
        """Generations that were written whole, in order."""
        held = self._fs(f"{self.root}/sums")
        if not held[0].exists(held[1]):
            return []
        names = [s.getPath() for s in held[0].listStatus(held[1])]
        whole = [p for p in names if held[0].exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(p.getName().removeprefix("generation=") for p in whole)

    def add(self, docs: DataFrame, generation: str, doc_id: str = "doc_id", text: str = "text") -> None:
        """Documents as a generation; one of the same name is replaced. Ids that another generation holds, and null or
        repeated ids, raise ValueError. A null text counts as a document without length."""
        self.drop(generation)
        words = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("words")).select("doc_id", F.size("words").alias("length"), "words")
        lists = written(_inverted(words), "index-lists")
        rows = lists.where("term is null").select(F.explode("docs").alias("d")).select("d.doc_id", "d.length")
        every = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids"), F.sum("length").alias("total"), F.count("length").alias("measured")).first()
        if every.ids != every.n:
            raise ValueError("ids are null or repeated")
        if (old := self.generations()) and not self._table("documents", old).join(rows.select("doc_id"), "doc_id", "left_semi").isEmpty():
            raise ValueError("another generation holds some of these ids")
        # a slot's lists are made where it is read, so the only shuffle is the one that sorts them
        postings = lists.where("term is not null").repartitionByRange("term", "slot").sortWithinPartitions("term", "slot")
        postings.write.mode("overwrite").parquet(self._path("postings", generation))
        self._table("postings", [generation]).select("term", F.size("docs").alias("n")).groupBy("term").agg(F.sum("n").alias("df")).write.mode("overwrite").parquet(self._path("terms", generation))
        rows.select("doc_id", "length").write.mode("overwrite").parquet(self._path("documents", generation))
        self.spark.createDataFrame([(every.n, every.measured, every.total or 0)], "n long, measured long, total long").coalesce(1).write.mode("overwrite").parquet(self._path("sums", generation))
        self._known.clear()

    def drop(self, generation: str) -> None:
        """Removes a generation, its mark of completeness first."""
        for name in reversed(TABLES):
            fs, path = self._fs(self._path(name, generation))
            fs.delete(path, True)
        self._known.clear()

    def search(self, queries: DataFrame, k: int = 10, generations: list[str] | None = None) -> DataFrame:
        """(query_id, doc_id, score, rank) of the k best documents of the generations (of all, if none are named) for
        each query (query_id, query). Rules are those of retrieval.bm25."""
        of = self.generations() if generations is None else sorted(generations)
        if not of:
            return self.spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")
        asked = written(queries.select("query_id", F.explode_outer(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times")), "index-asked")
        n, mean_length, floor = self._statistics(of)
        # the words of a stated set of questions
        held_terms = pa.concat_arrays(asked.where("term is not null").select("term").distinct().orderBy("term").toArrow().column(0).chunks or [pa.array([], pa.string())])
        terms = held_terms.to_pylist()

        def of_terms(name: str) -> DataFrame:
            rows = self._table(name, of)
            return rows.where(F.col("term").isin(terms)) if len(terms) <= LITERALS else rows.join(small(asked.select("term").distinct()), "term", "left_semi")

        df = of_terms("terms").groupBy("term").agg(F.sum("df").alias("df"))
        idf = _idf(n)
        idfs = written(df.select("term", F.when(idf < 0, floor).otherwise(idf).alias("idf")), "index-idf")
        weights = idfs.join(small(asked), "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight"))
        weights = small(written(weights, "index-weights"))
        known = {r.term: r.idf for r in idfs.collect()}  # a number a word of the questions
        weight = np.array([known.get(t, 0.0) for t in terms])
        postings = of_terms("postings")
        k1, b = self.k1, self.b

        def factor(tf, length):
            return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_length))

        def part(tf: Column, length: Column) -> Column:
            return F.col("weight") * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / F.lit(mean_length)))

        def documents(slots: DataFrame, rows: DataFrame) -> DataFrame:
            """(doc_id, length, terms, counts) of the documents in slots (generation, slot)."""
            met = rows.join(small(slots.select("generation", "slot").distinct()), ["generation", "slot"], "left_semi")
            return _by_document(met.select("generation", "slot", "term", "docs"), held_terms)

        if (weight < 0).any():  # a document without a match may then be better than one with some
            every = self._table("documents", of).select("doc_id", F.coalesce("length", F.lit(0)).alias("length"))
            matched = documents(postings, postings).drop("length")
            return top_k(best_by_terms(every.join(matched, "doc_id", "left").select("doc_id", "length", "terms", "counts"), asked, held_terms, weight, factor, k), k)

        def scores(slots: DataFrame, rows: DataFrame) -> DataFrame:
            return best_by_terms(documents(slots, rows), asked, held_terms, weight, factor, k)

        bound = F.sum(F.greatest(F.lit(0.0), part(F.col("tf_max"), F.col("length_min"))))
        bounds = written(postings.select("term", "generation", "slot", "tf_max", "length_min").join(weights, "term").groupBy("query_id", "generation", "slot").agg(bound.alias("bound")), "index-bounds")
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "generation", "slot")
        first = written(bounds.withColumn("at", F.row_number().over(order)).where(F.col("at") <= FIRST_SLOTS).select("generation", "slot").distinct(), "index-first")
        found = scores(first, self._of_slots(postings, first))
        least = top_k(found, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        reach = bounds.join(small(written(least, "index-least")), "query_id", "left").where(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - 1e-6)
        slots = written(reach.select("generation", "slot").distinct(), "index-slots")
        parts = written(scores(slots, self._of_slots(postings, slots)), "index-best")
        zeros = F.broadcast(self._table("documents", of).select("doc_id").orderBy("doc_id").limit(2 * k)).crossJoin(queries.select("query_id").distinct()).select("query_id", "doc_id", F.lit(0.0).alias("score"))
        # what is not in reach is under the k-th best score, so only the zeros of questions with few matches matter
        return top_k(parts.unionByName(zeros.join(parts, ["query_id", "doc_id"], "left_anti")), k)

    @staticmethod
    def _of_slots(postings: DataFrame, slots: DataFrame) -> DataFrame:
        """postings of some slots; a filter that reaches the scan, while they are few."""
        few = [r.slot for r in slots.select("slot").distinct().limit(LITERALS + 1).collect()]
        return postings.where(F.col("slot").isin(few)) if len(few) <= LITERALS else postings

    def _statistics(self, of: list[str]) -> tuple[int, float, float]:
        """(documents, mean length, weight of words that are in over half of them), kept while the generations stay."""
        if tuple(of) not in self._known:
            n, total, measured = self._table("sums", of).agg(F.sum("n"), F.sum("total"), F.sum("measured")).first()
            every = self._table("terms", of).groupBy("term").agg(F.sum("df").alias("df")).agg(F.avg(_idf(n))).first()[0]
            self._known[tuple(of)] = (n, total / measured if total else 1.0, self.epsilon * (every or 0.0))
        return self._known[tuple(of)]

    def _path(self, name: str, generation: str) -> str:
        return f"{self.root}/{name}/generation={generation}"

    def _table(self, name: str, of: list[str]) -> DataFrame:
        rows = [self.spark.read.parquet(self._path(name, g)).withColumn("generation", F.lit(g)) for g in of[:1]]
        if len(of) > 1:  # one scan of all folders; the path tells the generation
            read = self.spark.read.schema(rows[0].drop("generation").schema).parquet(*(self._path(name, g) for g in of))
            return read.withColumn("generation", F.regexp_extract("_metadata.file_path", r"/generation=([^/]*)/[^/]*$", 1))
        return rows[0]

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target


def _idf(n: int) -> Column:
    return F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def _inverted(rows: DataFrame) -> DataFrame:
    """(term, slot, tf_max, length_min, docs) of rows (doc_id, length, words), slot by slot; a slot's row without a term
    has all its documents."""
    doc = T.StructType([rows.schema["doc_id"], T.StructField("tf", T.IntegerType()), T.StructField("length", T.IntegerType())])
    size = SLOT_DOCS

    def of_slot(part: pa.RecordBatch, slot: int) -> pa.RecordBatch:
        part = part.take(pc.array_sort_indices(part.column(0)))
        words = part.column(2)
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        row = np.repeat(np.arange(part.num_rows), sizes)
        key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * part.num_rows + row, return_counts=True)
        term, row = np.divmod(key, part.num_rows)
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        length = part.column(1).take(pa.array(row)).to_numpy(zero_copy_only=False)
        every = pa.array(np.concatenate([row, np.arange(part.num_rows)]))
        tfs = pa.array(np.concatenate([tf, np.zeros(part.num_rows, np.int64)]).astype(np.int32))
        docs = pa.StructArray.from_arrays([part.column(0).take(every), tfs, part.column(1).take(every)], ["doc_id", "tf", "length"])
        offsets = np.concatenate([starts, [len(term), len(every)]]).astype(np.int32)
        none = pa.array([None], pa.int32())
        least = lambda found, v: pa.concat_arrays([pa.array(found.reduceat(v, starts).astype(np.int32) if len(starts) else [], pa.int32()), none])
        names = pa.concat_arrays([coded.dictionary.take(pa.array(term[starts])), pa.array([None], coded.dictionary.type)])
        return pa.RecordBatch.from_arrays([names, pa.array(np.full(len(names), slot)), least(np.maximum, tf), least(np.minimum, length), pa.ListArray.from_arrays(pa.array(offsets), docs)], ["term", "slot", "tf_max", "length_min", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                yield of_slot(batch.slice(at, size), slot)
                slot += 1

    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("slot", T.LongType()), T.StructField("tf_max", T.IntegerType()), T.StructField("length_min", T.IntegerType()), T.StructField("docs", T.ArrayType(doc))])
    return rows.mapInArrow(run, schema)


def _by_document(rows: DataFrame, terms: pa.Array) -> DataFrame:
    """(doc_id, length, terms, counts) of postings (generation, slot, term, docs), which meet by slot."""
    held = rows.sparkSession.sparkContext.broadcast(terms)

    def of_slots(part: pa.Table) -> pa.RecordBatch:
        part = part.combine_chunks()
        code = pc.index_in(part.column("term"), value_set=held.value).to_numpy().astype(np.int32)
        lists = pa.concat_arrays(part.column("docs").chunks)
        flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy()
        ids, tf, length = flat.flatten()
        coded = ids.dictionary_encode()
        doc = coded.indices.to_numpy()
        order = np.argsort(doc, kind="stable")
        starts = np.flatnonzero(np.diff(doc[order], prepend=-1))
        offsets = pa.array(np.concatenate([starts, [len(doc)]]).astype(np.int32))
        columns = [coded.dictionary, length.take(pa.array(order[starts])), pa.ListArray.from_arrays(offsets, pa.array(np.repeat(code, sizes)[order])), pa.ListArray.from_arrays(offsets, tf.take(pa.array(order)))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "length", "terms", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            part = part if rest is None else pa.concat_tables([rest, part])
            slot, generation = part.column("slot").to_numpy(), part.column("generation").combine_chunks().dictionary_encode()
            generation = (generation.combine_chunks() if isinstance(generation, pa.ChunkedArray) else generation).indices.to_numpy()
            edges = np.flatnonzero((np.diff(slot) != 0) | (np.diff(generation) != 0)) + 1
            if len(edges):  # the last slot may go on in the next batch
                yield of_slots(part.slice(0, edges[-1]))
                part = part.slice(edges[-1])
            rest = part
        if rest is not None:
            yield of_slots(rest)

    doc = rows.schema["docs"].dataType.elementType
    schema = T.StructType([doc["doc_id"], doc["length"], T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])
    return rows.repartition("generation", "slot").sortWithinPartitions("generation", "slot").mapInArrow(run, schema)
