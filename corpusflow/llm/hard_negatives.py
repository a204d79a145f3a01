"""Hard negatives by a Voronoi-partitioned exact join on inner products.

Vectors become whole numbers, so scores are exact. A vector x is augmented to (x, sqrt(M^2 - |x|^2)), with M the largest
norm, and an anchor a to (a, 0): their squared distance is |a|^2 + M^2 - 2 <a, x>, so large inner products are small
distances. Rows belong to the cell of their nearest pivot and carry their distance r to it. Anchors belong to groups of
at most GROUP_ANCHORS near each other.

What an anchor needs is a least score, found among a bounded sample of the rows (the pivots' sample): no row below it
can be in the result. With it, a ball around the anchor bounds, by the triangle inequality, the r that rows of a cell can
have, and, by the distance to the planes between pivots, which cells can have any. The bounds of a group's anchors
together replicate a row only to the groups that it might serve. Each group's rows meet its anchors in blocks of about
BLOCK_ROWS rows by the hash of the id, by matrix products; the best of all blocks are merged by rank. One such join finds
the positives, and one the negatives, whose least scores follow from the positives'.

The sample and the pivots change only how many rows are copied, never the result. Where vectors have no clusters, the
bounds hold nothing back, and each row meets each group: anchors x rows in blocks.

Rules:
- Component x counts as floor(scale x), in doubles. Rows with a null id, label or vector, or a null, NaN or infinite
  component take no part. Shorter vectors are filled up with zeros. Squared norms of 2^62 or more raise ValueError.
- Scores order downwards, ties by smaller id. An anchor's others are the rows with another id.
- Positives are the first `positives` others of the same label; fewer, if there are fewer.
- Negatives of an anchor and a positive of score p are the first `negatives` others of another label whose score n has
  lowest p <= 100 n <= highest p. A pair without one has no row; so has an anchor without positives.
- Repeated rows are rows of their own, as anchors, too. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.shared import BROADCAST_ROWS, Scratch, small_batches, tidy

#: Rows of the sample (and at most so many bytes of them), and pivots made of it.
SAMPLE, SAMPLE_BYTES, PIVOTS = 4096, 16 << 20, 64
GROUP_ANCHORS, BLOCK_ROWS = 512, 1024


def whole_numbers(rows: DataFrame, id: str, vector: str, label: str, anchor: Column, scale: int) -> DataFrame:
    """(id, label, q, norm2, anchor) of the rows that take part."""
    given = rows.select(F.col(id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("x"), anchor.alias("anchor")).where("id is not null and label is not null and x is not null")
    given = given.where(~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    floors = given.select("id", "label", "anchor", F.transform("x", lambda v: F.floor(v * scale).cast("double")).alias("q"))
    return floors.withColumn("norm2", F.aggregate("q", F.lit(0.0), lambda total, v: total + v * v))


@dataclass(frozen=True)
class Space:
    """The pivots and the sample, in the augmented space. It goes to the executors: its size is bounded by the sample's."""

    dims: int
    most2: float  # M^2
    ids: np.ndarray
    labels: np.ndarray
    sample: np.ndarray
    pivots: np.ndarray

    @property
    def kind(self) -> type:
        """Numbers in which inner products are exact: none exceeds M^2, nor does a part of one."""
        return np.float32 if self.most2 < 2**24 else np.float64 if self.most2 < 2**53 else np.int64

    def matrix(self, lists: pa.ListArray) -> np.ndarray:
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(self.kind)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        if (sizes == self.dims).all():
            return flat.reshape(len(lists), self.dims)
        out = np.zeros((len(lists), self.dims), self.kind)
        out[np.arange(self.dims)[None, :] < sizes[:, None]] = flat
        return out

    def augmented(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.column_stack([x, np.sqrt(np.maximum(self.most2 - (x * x).sum(1), 0))])

    def distances(self, points: np.ndarray) -> np.ndarray:
        squares = (points * points).sum(1)[:, None] + (self.pivots * self.pivots).sum(1) - 2 * points @ self.pivots.T
        return np.sqrt(np.maximum(squares, 0))

    def anchor_distances(self, x: np.ndarray) -> np.ndarray:
        return self.distances(np.column_stack([x.astype(np.float64), np.zeros(len(x))]))


def _pivots(points: np.ndarray, k: int) -> np.ndarray:
    """k-means centres of the sample; equal ones count once."""
    centres = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)]
    for _ in range(8):
        near = np.argmin((centres * centres).sum(1) - 2 * points @ centres.T, axis=1)
        centres = np.array([points[near == i].mean(0) if (near == i).any() else c for i, c in enumerate(centres)])
    return np.unique(centres, axis=0)


def _space(rows: DataFrame, pivots: int) -> Space | None:
    """None for no rows."""
    of = rows.agg(F.max("norm2").alias("m"), F.max(F.size("q")).alias("d")).first()
    if of.m is None:
        return None
    if of.m >= 2.0**62:
        raise ValueError("the vectors are too long: their inner products may exceed 64 bits")
    size = max(pivots, min(SAMPLE, SAMPLE_BYTES // (4 * max(of.d, 1))))
    sample = rows.select("id", "label", "q").orderBy(F.xxhash64("id"), "id").limit(size).toArrow().sort_by("id").combine_chunks()
    found = Space(of.d, of.m, sample["id"].to_numpy(), sample["label"].to_numpy(), np.zeros(0), np.zeros((0, 0)))
    q = found.matrix(sample["q"].combine_chunks())
    centres = _pivots(found.augmented(q), pivots)
    return Space(found.dims, found.most2, found.ids, found.labels, q, centres)


def _in_cells(rows: DataFrame, held) -> DataFrame:
    """rows with their cell and distance to its pivot, and a number of their own."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = held.value
        for batch in batches:
            d = space.distances(space.augmented(space.matrix(batch.column(2))))
            cell = np.argmin(d, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell], pa.float64())], [*batch.schema.names, "cell", "r"])

    given = rows.select("id", "label", F.col("q").cast("array<int>").alias("q"), "norm2", "anchor", F.monotonically_increasing_id().alias("row"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields)
    return given.mapInArrow(run, f"{fields}, cell int, r double")


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, highest first; ties by place."""
    if len(scores) > 8 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        held = np.flatnonzero(scores >= least)
        return held[np.argsort(-scores[held], kind="stable")[:k]]
    return np.argsort(-scores, kind="stable")[:k]


def _bands(scores: list[int], lowest: int, highest: int) -> list[tuple[int, int]]:
    """Of each positive score, the least and the greatest score of its negatives."""
    return [(-(-lowest * p // 100), highest * p // 100) for p in scores]


def _home(anchors: DataFrame, held, positives: int) -> DataFrame:
    """anchors with their nearest pivot and the least score that a positive may have: that of the last of enough rows of
    the sample, or null."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = held.value
        for batch in batches:
            x, labels, ids = space.matrix(batch.column(2)), batch.column(1).to_numpy(zero_copy_only=False), batch.column(0).to_numpy()
            home, need = np.argmin(space.anchor_distances(x), axis=1), []
            for i, scores in enumerate(x @ space.sample.T):
                own = scores[(space.labels == labels[i]) & (space.ids != ids[i])]
                need.append(int(own[_best(own, positives)[-1]]) if len(own) >= positives else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32()), pa.array(need, pa.int64())], [*batch.schema.names, "home", "need"])

    given = anchors.select("id", "label", "q", "row")
    return given.mapInArrow(run, f"id long, label {given.schema['label'].dataType.simpleString()}, q array<int>, row long, home int, need long")


def _group_of(anchors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(home, first, parts): the groups of a pivot's anchors. One row a pivot.

    Pivots are taken in a chain of neighbours; those with few anchors share a group, those with many have several.
    """
    counts = {r.home: r.n for r in anchors.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()}
    left, chain = set(counts), []
    while left:
        at = min(left, key=lambda i: (0 if not chain else float(((pivots[i] - pivots[chain[-1]]) ** 2).sum()), i))
        chain.append(at)
        left.remove(at)
    rows, group, held = [], 0, 0
    for home in chain:
        parts = -(-counts[home] // GROUP_ANCHORS)
        if held and held + counts[home] > GROUP_ANCHORS:
            group, held = group + 1, 0
        rows.append((home, group, parts))
        group, held = (group, held + counts[home]) if parts == 1 else (group + parts, 0)
    return F.broadcast(anchors.sparkSession.createDataFrame(rows, "home int, first int, parts int"))


def _reach(anchors: DataFrame, held) -> DataFrame:
    """(group, cell, low, high): which distances to its pivot a row of the cell can have to serve an anchor of the group."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = held.value
        apart = np.sqrt(np.maximum(((space.pivots[:, None] - space.pivots[None]) ** 2).sum(2), 0))
        for batch in batches:
            group, x = batch.column(0).to_numpy(), space.matrix(batch.column(1))
            norm2 = (x.astype(np.float64) ** 2).sum(1)
            need = np.where(np.isnan(n := batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)), -np.inf, n)
            radius = np.sqrt(np.maximum(norm2 + space.most2 - 2 * np.maximum(need, -np.sqrt(norm2 * space.most2)), 0))
            radius += 1e-7 * (np.sqrt(norm2) + np.sqrt(space.most2)) + 1e-6  # for rounding
            d = space.anchor_distances(x)
            in_reach = np.ones(d.shape, bool)
            for j in range(d.shape[1]):
                planes = np.divide(d[:, j : j + 1] ** 2 - d**2, 2 * apart[j], out=np.full(d.shape, -np.inf), where=apart[j] > 0)
                in_reach[:, j] = planes.max(axis=1, initial=-np.inf) <= radius
            low, high = np.where(in_reach, d - radius[:, None], np.inf), np.where(in_reach, d + radius[:, None], -np.inf)
            order = np.argsort(group, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) > 0])) if len(order) else order
            low, high = np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)
            g, c = np.nonzero(low <= high)
            yield pa.RecordBatch.from_arrays([pa.array(group[order][first][g], pa.int32()), pa.array(c, pa.int32()), pa.array(low[g, c]), pa.array(high[g, c])], ["group", "cell", "low", "high"])

    some = anchors.select("group", "q", "need").mapInArrow(run, "group int, cell int, low double, high double")
    return some.groupBy("group", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def _joined(scratch: Scratch, cells: DataFrame, anchors: DataFrame, held, search, schema: str) -> DataFrame:
    """search(space, anchors, rows) over the blocks of each group's rows. anchors: group, q, need and more; rows: id,
    label, q, by id."""
    reach = scratch.table(_reach(anchors, held), "reach")
    served = (F.col("r") >= F.col("low")) & (F.col("r") <= F.col("high"))

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df

    copies = cells.select("cell", "r").join(small(reach), "cell").where(served).groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    blocks = scratch.table(copies, "blocks")
    dealt = small(scratch.table(reach.join(blocks, "group"), "dealt"))
    rows = cells.join(dealt, "cell").where(served).select("group", F.pmod(F.xxhash64("row"), "blocks").cast("int").alias("block"), "id", "label", "q")
    asked = anchors.join(small(blocks), "group").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def run(key, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.Table.from_pylist([], schema=out)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(search(held.value, a.combine_chunks(), b.sort_by("id").combine_chunks()), out, strict=True)], schema=out)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))
    return asked.groupBy("group", "block").cogroup(rows.groupBy("group", "block")).applyInArrow(run, schema)


def _scores(space: Space, a: pa.Table, b: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, places, scores): for each anchor, the rows of another id that score no less than it needs."""
    x, y = space.matrix(a["q"].combine_chunks()), space.matrix(b["q"].combine_chunks())
    ids, others = a["id"].to_numpy(), b["id"].to_numpy()
    need = np.array([-(2**62) if n is None else n for n in a["need"].to_pylist()])
    for at in range(0, len(x), 64):
        for i, row in enumerate((x[at : at + 64] @ y.T).astype(np.int64), at):
            places = np.flatnonzero((row >= need[i]) & (others != ids[i]))
            yield i, places, row[places]


def _positives(k: int):
    def search(space: Space, a: pa.Table, b: pa.Table) -> list[list]:
        labels, other = a["label"].to_numpy(), b["label"].to_numpy()
        ids, rows, out = b["id"].to_numpy(), a["row"].to_numpy(), []
        for i, places, scores in _scores(space, a, b):
            own = other[places] == labels[i]
            places, scores = places[own], scores[own]
            out += [(rows[i], ids[places[j]], scores[j]) for j in _best(scores, k)]
        return [list(c) for c in zip(*out, strict=True)] or [[], [], []]

    return search


def _negatives(k: int, lowest: int, highest: int):
    def search(space: Space, a: pa.Table, b: pa.Table) -> list[list]:
        labels, other, ids = a["label"].to_numpy(), b["label"].to_numpy(), b["id"].to_numpy()
        rows, wanted, out = a["row"].to_numpy(), a["wanted"].to_pylist(), []
        for i, places, scores in _scores(space, a, b):
            apart = other[places] != labels[i]
            places, scores = places[apart], scores[apart]
            for rank, (low, high) in enumerate(_bands([w["score"] for w in wanted[i]], lowest, highest), 1):
                within = np.flatnonzero((scores >= low) & (scores <= high))
                out += [(rows[i], rank, ids[places[j]], scores[j]) for j in within[_best(scores[within], k)]]
        return [list(c) for c in zip(*out, strict=True)] or [[], [], [], []]

    return search


def _wanted(anchors: DataFrame, held, k: int, lowest: int, highest: int) -> DataFrame:
    """anchors with the least score of any negative: of each positive that of the last of enough rows of the sample
    within its band, or else the band's lower end."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = held.value
        for batch in batches:
            x, labels, ids = space.matrix(batch.column(2)), batch.column(1).to_numpy(zero_copy_only=False), batch.column(0).to_numpy()
            need = []
            for i, (scores, wanted) in enumerate(zip((x @ space.sample.T).astype(np.int64), batch.column(5).to_pylist(), strict=True)):
                apart = scores[(space.labels != labels[i]) & (space.ids != ids[i])]
                least = []
                for low, high in _bands([w["score"] for w in wanted], lowest, highest):
                    within = apart[(apart >= low) & (apart <= high)]
                    if low <= high:
                        least.append(int(within[_best(within, k)[-1]]) if len(within) >= k else low)
                need.append(min(least, default=None))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(need, pa.int64())], [*batch.schema.names, "need"])

    given = anchors.select("id", "label", "q", "row", "group", "wanted")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields)
    return given.mapInArrow(run, f"{fields}, need long").where("need is not null")  # no band holds a whole number


def mined(rows: DataFrame, anchor: Column, id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 3, lowest: int = 50, highest: int = 95, scale: int = 256, pivots: int = PIVOTS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). anchor: which rows are anchors, a
    condition over the columns of rows."""
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    small_batches(spark)
    given = whole_numbers(rows, id, vector, label, anchor, scale)
    space = _space(given, pivots)
    if space is None:
        return spark.createDataFrame([], schema)
    held, scratch = spark.sparkContext.broadcast(space), Scratch(spark, "hard-negatives")
    cells = scratch.table(_in_cells(given, held), "cells")
    asked = scratch.table(_home(cells.where("anchor"), held, positives), "anchors")
    group = F.col("first") + F.pmod(F.xxhash64("row"), "parts").cast("int")
    grouped = asked.join(_group_of(asked, space.pivots), "home").select("id", "label", "q", "row", "need", group.alias("group"))
    found = _joined(scratch, cells, grouped, held, _positives(positives), "row long, positive_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "positive_id")
    best = scratch.table(found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= positives), "positives")
    lists = best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "positive_id", "score"))).alias("wanted"))
    wanting = scratch.table(_wanted(grouped.drop("need").join(lists, "row"), held, negatives, lowest, highest), "wanting")
    found = _joined(scratch, cells, wanting, held, _negatives(negatives, lowest, highest), "row long, k int, negative_id long, negative_score long")
    order = Window.partitionBy("row", "k").orderBy(F.desc("negative_score"), "negative_id")
    last = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    of = wanting.select("row", F.col("id").alias("anchor_id"), F.explode("wanted").alias("w")).select("row", "anchor_id", "w.*")
    return last.join(of, ["row", "k"]).select("anchor_id", "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")
