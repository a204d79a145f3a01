"""An index of vectors in inverted lists around centroids, with an exact mode.

Centroids are fitted on a bounded sample; every row is in the list of its nearest centroid c, with its distance r to it.
Lists are partitions of the table, sorted by r. For a question q and a row x of the list, <q, x> <= <q, c> + |q| r (the
triangle inequality around c), so a list can hold a row of score s only where r >= (s - <q, c>) / |q|.

A search first ranks the rows of each question's `probes` most promising lists. In exact mode the k-th best score of
these is the s that the other rows must reach: lists whose largest r is too small are skipped, and of the others only
rows beyond the least r are read. The result then equals retrieval.nearest over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.operators import products
from corpusflow.operators.retrieval import top_k
from corpusflow.session import written

#: Rows that the centroids are fitted on, and at most so many bytes of them.
SAMPLE, SAMPLE_BYTES = 16_384, 64 << 20
LISTS, PROBES = 64, 8


class VectorIndex:
    """root: a folder that driver and executors share. Vectors have one length; null vectors are not indexed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, vectors: DataFrame, lists: int = LISTS, item: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> None:
        """A new index of all vectors. The sample is the rows with the smallest hashes of their ids."""
        rows = vectors.where(F.col(vector).isNotNull()).select(F.col(item).alias("id"), F.col(vector).alias("v"))
        dims = rows.select(F.size("v").alias("n")).first()
        some = rows.orderBy(F.xxhash64("id"), "id").limit(min(sample, max(lists, SAMPLE_BYTES // (8 * max(dims.n, 1))))).select("v").toPandas()["v"] if dims else []
        centres = _fitted(np.stack(some).astype(np.float64), lists) if len(some) else np.zeros((0, 0))
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/centres")
        self._write(rows, centres, "overwrite")

    def add(self, vectors: DataFrame, item: str = "vec_id", vector: str = "embedding") -> None:
        """More rows, around the centroids that the index has."""
        centres = np.array([r.centre for r in self.spark.read.parquet(f"{self.root}/centres").orderBy("list").collect()])
        self._write(vectors.where(F.col(vector).isNotNull()).select(F.col(item).alias("id"), F.col(vector).alias("v")), centres, "append")

    def _write(self, rows: DataFrame, centres: np.ndarray, mode: str) -> None:
        held = self.spark.sparkContext.broadcast(centres)

        @F.pandas_udf("list int, r double")
        def nearest_centre(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            squares = (held.value**2).sum(1)
            for part in parts:
                x = np.stack(part.to_numpy()).astype(np.float64)
                at = np.argmin(squares - 2 * x @ held.value.T, axis=1)
                yield pd.DataFrame({"list": at.astype(np.int32), "r": np.sqrt(((x - held.value[at]) ** 2).sum(1))})

        placed = rows.withColumn("c", nearest_centre("v")).select("id", "v", "c.list", "c.r")
        # a list may hold most rows: its files are ranges of r
        placed.repartitionByRange("list", "r", "id").sortWithinPartitions("list", "r").write.mode(mode).partitionBy("list").parquet(f"{self.root}/lists")
        sizes = self._lists().groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("r_max"))
        sizes.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/sizes")

    def _lists(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/lists")

    def _bounds(self, asked: products.Questions, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(near, norm, r_max, first) of questions and lists, a row a list: near is <q, c>, r_max the largest r of the
        list; first tells the `probes` most promising lists of each question. An empty list has no r_max."""
        rows = self.spark.read.parquet(f"{self.root}/centres").join(self.spark.read.parquet(f"{self.root}/sizes"), "list", "left").orderBy("list").collect()  # a row a list
        r_max = np.array([-np.inf if r.r_max is None else r.r_max for r in rows])[:, None]
        with np.errstate(all="ignore"):
            centres = np.array([r.centre for r in rows]).reshape(len(rows), -1)
            same = centres.shape[1] == asked.vectors.shape[1]
            near = centres @ asked.vectors.T if same else np.full((len(rows), len(asked.ids)), np.nan)
            norm = np.where(asked.whole, asked.norms, 0.0)
            hope = np.where(r_max == -np.inf, -np.inf, np.nan_to_num(near + norm * r_max / 2, nan=np.inf))
        first = np.zeros(near.shape, bool)
        np.put_along_axis(first, np.argsort(-hope, axis=0, kind="stable")[:probes], True, axis=0)
        return near, norm, r_max, first & (r_max > -np.inf)

    def _rows(self, reach: np.ndarray) -> DataFrame:
        """(doc_id, v, list, r) of the rows that reach (a row a list, the least r of each question) names, in the order of `best`."""
        least = reach.min(1, initial=np.inf)
        rows = self._lists().where(F.col("list").isin(np.flatnonzero(least < np.inf).tolist()))
        if (r := float(least.min(initial=np.inf))) > 0:
            rows = rows.where(F.col("r") >= r)
        return rows.select(F.col("id").alias("doc_id"), "v", F.col("list").cast("long").alias("list"), "r").sortWithinPartitions("list", "doc_id")

    @staticmethod
    def _beyond(near: np.ndarray, norm: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The r from which a row can have a score of `least`. Scores are rounded; a question without k rows so far, or
        of a zero vector, may need any row."""
        with np.errstate(all="ignore"):
            r_min = (least - 2e-6 - near) / norm
        return np.where((norm > 0) & np.isfinite(r_min), np.maximum(r_min, 0.0), 0.0)

    def search(self, queries: DataFrame, k: int = 10, probes: int = PROBES, exact: bool = True) -> DataFrame:
        """(query_id, doc_id, score, rank) of queries (query_id, query_vector); ties go to the smaller id.

        Questions are taken in blocks; a block's bounds (a number a question and list) are made by the driver.
        """
        id_type = queries.schema["query_id"].dataType
        parts = []
        for asked in products.question_blocks(queries):
            near, norm, r_max, first = self._bounds(asked, probes)
            reach = np.where(first, 0.0, np.inf)
            found = top_k(products.best(self._rows(reach), asked, k, id_type, reach), k)
            if not exact:
                parts.append(found)
                continue
            found = written(found, "vector-found")
            least = self._least(found, asked, k)
            r_min = self._beyond(near, norm, least)
            reach = np.where(first | (r_min > r_max), np.inf, r_min)
            more = products.best(self._rows(reach), asked, k, id_type, reach, np.where(np.isnan(least), -np.inf, least))
            parts.append(top_k(found.drop("rank").unionByName(more), k))
        if not parts:
            empty = T.StructType([T.StructField("query_id", id_type), T.StructField("doc_id", self._lists().schema["id"].dataType), T.StructField("score", T.DoubleType())])
            return top_k(self.spark.createDataFrame([], empty), k)
        # an id of several rows may be in several blocks
        return parts[0] if len(parts) == 1 else top_k(reduce(DataFrame.unionByName, parts).drop("rank"), k)

    @staticmethod
    def _least(found: DataFrame, asked: products.Questions, k: int) -> np.ndarray:
        """The k-th best score of each question of a block; NaN without one."""
        rows = found.where(F.col("rank") == k).select("query_id", "score").toArrow()
        scores = dict(zip(map(repr, rows.column(0).to_pylist()), rows.column(1).to_pylist(), strict=True))
        return np.array([scores.get(repr(i)) for i in asked.ids.to_pylist()], float)

    def rows_in_reach(self, queries: DataFrame, k: int = 10, probes: int = PROBES) -> float:
        """Which share of all pairs of a question and a row an exact search scores."""
        read = pairs = 0
        for asked in products.question_blocks(queries):
            near, norm, _, first = self._bounds(asked, probes)
            reach = np.where(first, 0.0, np.inf)
            found = top_k(products.best(self._rows(reach), asked, k, queries.schema["query_id"].dataType, reach), k)
            r_min = np.sort(np.where(first, 0.0, self._beyond(near, norm, self._least(found, asked, k))), axis=1)

            def count(batches: Iterator[pa.RecordBatch], held=self.spark.sparkContext.broadcast(r_min)) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    lists, r = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                    met = sum(int(np.searchsorted(held.value[i], r[lists == i], side="right").sum()) for i in np.unique(lists))
                    yield pa.RecordBatch.from_arrays([pa.array([met]), pa.array([len(r) * held.value.shape[1]])], ["met", "pairs"])

            met, n = self._lists().select(F.col("list").cast("long"), "r").mapInArrow(count, "met long, pairs long").agg(F.sum("met"), F.sum("pairs")).first()
            read, pairs = read + (met or 0), pairs + (n or 0)
        return read / max(pairs, 1)


def _fitted(points: np.ndarray, k: int) -> np.ndarray:
    """k-means centres, from points that are spread over the sample."""
    centres = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)]
    for _ in range(10):
        near = np.argmin((centres**2).sum(1) - 2 * points @ centres.T, axis=1)
        centres = np.array([points[near == i].mean(0) if (near == i).any() else c for i, c in enumerate(centres)])
    return np.unique(centres, axis=0)
