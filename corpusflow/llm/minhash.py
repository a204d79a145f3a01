"""MinHash near-dedup by min-max hashing.

Each of PERMUTATIONS hash functions is evaluated once a shingle and both its minimum and its maximum are kept, so half
as many evaluations give as many signature values; the two agree with the probability of the Jaccard similarity each,
and together have less variance than two minima. Bands of two functions (four values) make the candidates: at a
similarity of 0.8 a pair misses all 32 bands with a probability of 5e-8. Each link is confirmed on the full sets.

Scale:
- Equal sets are one node, found by a 128-bit key, so copies cost nothing further.
- A bucket of any size is linked to one hub (its smallest node) first. Only buckets that still hold several components
  go on: to the hubs of all their bands, then for some rounds to hubs drawn anew. All of this is one pair a member.
- What is left in buckets of at most BUCKET members meets pair by pair. Nodes of larger ones go to an inverted index of
  their rarest shingles: two sets that are similar enough share one of the rarest (1 - t) n + 1 of each, and the place
  where they first meet, and how many of the first they share, bound what they can share in all. Only pairs that pass this bound come out. Of the
  smaller set, fewer of its rarest are enough. The entries of a frequent shingle are dealt into a square of cells, so
  none is a task of its own and copies grow with the power 1.5 of a shingle's sets; the pairs compared grow with their
  square, as any exact search among texts that share all their shingles does. Sizes are compared before sets are read.
- Components are found by label propagation with pointer jumping on written tables; nothing of it comes to the driver.

Rules: words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a set is the distinct runs of `words` words. A text with
fewer words is one shingle of all of them; without words (or null) the set is empty and linked with nothing. Repeated
ids and repeated rows are separate documents; a null id has the group's smallest other id, or null. Links are inclusive
of the threshold. Extra columns are ignored; an empty table gives an empty table. A word of any length is one word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.shared import Scratch, slices, tidy

WORDS, PERCENT = 5, 80
PERMUTATIONS, PER_BAND = 64, 2
#: Nodes of larger buckets find their remaining links through the index, after at most so many rounds of so many new hubs.
BUCKET, ROUNDS, HUBS = 50, 3, 8
#: A shingle that N sets hold has N / CELL cells: at most about N * CELL of its pairs meet in one.
CELL = 512
#: So many first shingles stand with each entry, to be counted against those of others; sets with more go without.
SHOWN = 64
#: Places of the table that the index takes its order from, and the parts that it is added up in.
SLOTS, PARTS = 1 << 18, 16
#: Rows of two longs that may be broadcast.
BROADCAST = 100_000
_MASK = (1 << 64) - 1
_K = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xD6E8FEB86659FD93)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 200_000:
                self.clear()
            self[word] = found
        return found


_rng = np.random.default_rng(20240101)
_A = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M
    x = (x ^ (x >> np.uint64(32))) * _M
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes | None, words: int = WORDS, hashes: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `words` words. `hashes` keeps those of words from text to text."""
    found = (text or b"").lower().split()
    h = np.fromiter(map((_Words() if hashes is None else hashes).__getitem__, found), np.uint64, len(found))
    if not len(h):
        return h
    width = min(words, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = out * _K + h[i : len(h) - width + 1 + i]
    return np.unique(_mix(out))


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(minima, maxima) under each permutation, of a set that is not empty."""
    low, high = np.full(PERMUTATIONS, _MASK, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), 2048):
        values = shingles[None, at : at + 2048] * _A[:, None] + _B[:, None]
        low, high = np.minimum(low, values.min(1)), np.maximum(high, values.max(1))
    return low, high


def bands(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit key a band: PER_BAND permutations, both ends of each."""
    low, high = signature(shingles)
    key = np.arange(PERMUTATIONS // PER_BAND, dtype=np.uint64)
    for i in range(PER_BAND):
        key = _mix(key * _K + low[i::PER_BAND]) * _K + high[i::PER_BAND]
    return _mix(key)


def _longs(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(_longs(np.concatenate(arrays)) if arrays else np.zeros(0, np.int64)))


def text_key(text: str) -> Column:
    """128 bits of the text as two longs."""
    return F.struct(F.xxhash64(F.col(text)).alias("t"), F.xxhash64(F.lit(1), F.col(text)).alias("u"))


def signed(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """(uid, doc_id, row, n, key, bands): row is text_key(text); uid is unique once written."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, hashes = TaskContext.get().partitionId() << 40, _Words()
        for batch in batches:
            for part in slices(batch, 1):
                sets = [shingle_set(x.as_py(), words, hashes) for x in part.column(1).cast(pa.binary())]
                keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                none = np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(uid, uid + len(sets)), pa.int64()), part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), _lists([bands(s) if len(s) else none for s in sets])],
                    ["uid", "doc_id", "row", "n", "key", "bands"],
                )
                uid += len(sets)

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), text_key(text).alias("row"))
    return chosen.mapInArrow(run, "uid long, doc_id long, row struct<t:long,u:long>, n long, key binary, bands array<long>")


def _sets(docs: DataFrame, doc_id: str, text: str, words: int, wanted: DataFrame) -> DataFrame:
    """(uid, n, sh) of the wanted (uid, row)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Words()
        for batch in batches:
            for part in slices(batch, 1):
                sets = [shingle_set(x.as_py(), words, hashes) for x in part.column(1).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), _lists([_longs(s) for s in sets])], ["uid", "n", "sh"])

    few = wanted.limit(BROADCAST + 1).count() <= BROADCAST
    found = docs.select(F.col(text).cast("string").alias("__text"), text_key(text).alias("row")).join(F.broadcast(wanted) if few else wanted, "row").select("uid", "__text")
    return found.mapInArrow(run, "uid long, n long, sh array<long>").dropDuplicates(["uid"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (a, b), those whose sets overlap enough."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                a, b = left[i].values.to_numpy(), right[i].values.to_numpy()
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("uid").alias("a"), F.col("sh").alias("x"))
    two = sets.select(F.col("uid").alias("b"), F.col("sh").alias("y"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _near(n: str, m: str, percent: int):
    """Whether sets of such sizes can be similar enough."""
    return (100 * F.least(F.col(n), F.col(m)) >= percent * F.greatest(F.col(n), F.col(m)))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): the smallest node that edges (a, b) reach, for every node on an edge."""
    both = scratch.table(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = scratch.table(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("around"))
        lower = labels.join(around, labels["node"] == around["a"], "left").select("node", "label", F.least("label", F.coalesce("around", "label")).alias("low"))
        lower = scratch.table(lower, "lower")
        to = labels.select(F.col("node").alias("low"), F.col("label").alias("jump"))
        jumped = scratch.table(lower.join(to, "low", "left").select("node", F.col("label").alias("old"), F.least("low", F.coalesce("jump", "low")).alias("label")), "labels")
        scratch.drop(labels, lower)
        labels = jumped.select("node", "label")
        labels.scratch_path = jumped.scratch_path
        if jumped.where("old <> label").isEmpty():
            scratch.drop(both)
            return labels


class _Links:
    """Labels of nodes, merged by rounds of confirmed pairs."""

    def __init__(self, sets: DataFrame, scratch: Scratch, percent: int):
        self.sets, self.scratch, self.percent = sets, scratch, percent
        self.labels: DataFrame | None = None

    def label(self, rows: DataFrame, of: str, name: str) -> DataFrame:
        """rows with the label of the node in column `of`; a node without one is its own."""
        if self.labels is None:
            return rows.withColumn(name, F.col(of))
        few = self.labels.limit(BROADCAST + 1).count() <= BROADCAST
        known = self.labels.select(F.col("node").alias(of), F.col("label").alias("__l"))
        return rows.join(F.broadcast(known) if few else known, of, "left").withColumn(name, F.coalesce("__l", of)).drop("__l")

    def merge(self, pairs: DataFrame) -> int:
        """Confirms pairs (a, b); how many held."""
        pairs = self.scratch.table(pairs, "pairs")
        if pairs.isEmpty():
            return 0
        edges = self.scratch.table(_confirmed(pairs, self.sets, self.percent), "held")
        held = edges.count()
        if held:
            before = self.labels
            if before is not None:  # between labels; all labelled nodes then follow their label
                for c in ("a", "b"):
                    edges = self.label(edges, c, "__of").withColumn(c, F.col("__of")).drop("__of")
                edges = edges.where("a <> b")
            self.labels = found = components(edges, self.scratch)
            if before is not None:
                moved = before.join(found.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
                self.labels = self.scratch.table(moved.unionByName(found.join(before, "node", "left_anti")), "merged")
                self.scratch.drop(before, found)
        self.scratch.drop(pairs)
        return held


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, component, row): component is a number that its rows alone share, row is text_key(text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    rows = scratch.table(signed(docs, doc_id, text, words), "signed")
    full = rows.where("n > 0")
    classes = scratch.table(full.groupBy("key").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "classes")
    nodes = full.join(classes.select("uid"), "uid", "left_semi")
    banded = nodes.select("uid", "n", F.explode("bands").alias("band"))
    hubs = scratch.table(banded.groupBy("band").agg(F.min(F.struct("uid", "n")).alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1").select("band", F.col("hub.uid").alias("hub"), F.col("hub.n").alias("hub_n"), "size"), "hubs")
    members = scratch.table(banded.join(hubs, "band"), "members")  # the same way at every size, unless Spark finds hubs small
    labels = None
    if not members.isEmpty():
        wanted = nodes.select("uid", "row").join(members.select("uid").distinct(), "uid", "left_semi")
        sets = scratch.table(_sets(docs, doc_id, text, words, wanted), "sets")
        links = _Links(sets, scratch, percent)
        able = members.where(F.col("uid") != F.col("hub")).where(_near("n", "hub_n", percent))
        links.merge(able.groupBy("uid").agg(F.min("hub").alias("b")).withColumnRenamed("uid", "a"))
        _more(members, links, percent)
        labels = links.labels
        scratch.drop(members, sets)
    known = classes.select("key", "uid", "least", "copies")
    if labels is None:
        groups = known.where("copies > 1").select("key", F.col("uid").alias("label"), F.col("least").alias("component"))
    else:
        of = known.join(labels.withColumnRenamed("node", "uid"), "uid", "left").withColumn("label", F.coalesce("label", "uid"))
        of = scratch.table(of.where("copies > 1 or label <> uid").unionByName(of.join(labels.where("label <> node").select("label").distinct(), "label", "left_semi").where("copies = 1 and label = uid")), "grouped")
        least = scratch.table(of.groupBy("label").agg(F.min("least").alias("component")), "least")
        groups = of.join(least, "label").select("key", "label", "component")
    groups = scratch.table(groups, "groups")
    joined = rows.select("doc_id", "n", "key", "row", "uid").join(groups.withColumn("__in", F.lit(True)), "key", "left")
    component = F.when((F.col("n") > 0) & F.col("__in"), F.col("component")).otherwise(F.col("doc_id"))
    own = F.when((F.col("n") > 0) & F.col("__in"), F.col("label")).otherwise(F.col("uid"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), own.alias("component"), "row")


def _more(members: DataFrame, links: _Links, percent: int) -> None:
    """The rounds after the first: buckets that hold several components."""
    s = links.scratch

    def off_hub(rows: DataFrame) -> DataFrame:
        """Members that are not in their hub's component: a bucket without any is one component, and stays one."""
        return s.table(links.label(links.label(rows, "uid", "label"), "hub", "hub_label").where("label <> hub_label").select(members.columns), "off-hub")

    apart = off_hub(members)
    links.merge(apart.where(_near("n", "hub_n", percent)).select(F.col("uid").alias("a"), F.col("hub").alias("b")).distinct())

    by_node = s.table(members.groupBy("uid", "n").agg(F.collect_list(F.when(F.col("size") > BUCKET, F.col("band"))).alias("bands")).where(F.size("bands") > 0), "by-node")

    def in_large(apart: DataFrame, turn: int) -> DataFrame:
        """(uid, n, band, label) of nodes in large buckets of several components; band is one of those, drawn by turn."""
        mixed = s.table(apart.where(F.col("size") > BUCKET).select("band").distinct(), "mixed")
        drawn = F.struct(F.xxhash64(F.lit(turn), "band").alias("draw"), "band")
        few = [r.band for r in mixed.limit(BROADCAST + 1).collect()]
        if len(few) <= BROADCAST:
            known = by_node.sparkSession.sparkContext.broadcast(np.sort(np.array(few, np.int64)))
            key = np.uint64(2 * turn + 1) * _K

            @tidy
            def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    keep, chosen = [], []
                    for i, bands in enumerate(batch.column(2)):
                        own = np.intersect1d(bands.values.to_numpy(), known.value)
                        if len(own):
                            keep.append(i)
                            chosen.append(int(own[np.argmin(_mix(own.view(np.uint64) * key))]))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64())), pa.array(chosen, pa.int64())], ["uid", "n", "band"])

            nodes = by_node.mapInArrow(choose, "uid long, n long, band long")
        else:
            each = by_node.select("uid", "n", F.explode("bands").alias("band")).join(mixed, "band", "left_semi")
            nodes = each.groupBy("uid", "n").agg(F.min(drawn).band.alias("band"))
        return s.table(links.label(nodes, "uid", "label"), "in-large")

    apart = off_hub(apart)
    large = in_large(apart, 0)
    for turn in range(ROUNDS):
        draw = lambda k: F.min(F.struct(F.xxhash64(F.lit(turn * HUBS + k), "uid").alias("draw"), F.col("uid").alias("b"), F.col("n").alias("m"), F.col("label").alias("y")))  # noqa: E731, B023
        drawn = large.groupBy("band").agg(F.array(*[draw(k) for k in range(HUBS)]).alias("d")).select("band", F.explode("d").alias("d")).select("band", "d.b", "d.m", "d.y").distinct()
        if not links.merge(large.join(s.table(drawn, "drawn"), "band").where(F.col("label") != F.col("y")).where(_near("n", "m", percent)).select(F.col("uid").alias("a"), "b").distinct()):
            break
        apart = off_hub(apart)
        large = in_large(apart, turn + 1)
    narrow = apart.where(F.col("size") <= BUCKET).select("band").distinct()
    rest = s.table(links.label(members.where(F.col("size") <= BUCKET).join(narrow, "band", "left_semi").select("band", "uid", "n"), "uid", "label"), "rest")
    left, right = (rest.select("band", F.col("uid").alias(u), F.col("n").alias(n), F.col("label").alias(x)) for u, n, x in (("a", "n", "x"), ("b", "m", "y")))
    small = left.join(right, "band").where("a < b and x <> y").where(_near("n", "m", percent)).select("a", "b").distinct()
    links.merge(small.unionByName(_by_rarest(large.select("uid", "n", "label"), links.sets, s, percent)).distinct())


def _slots(nodes: DataFrame) -> np.ndarray:
    """How many of the shingles of nodes (uid, n, label, sh) fall on each of SLOTS places: at least how many sets have one."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SLOTS, np.int64)
        for batch in batches:
            lists = batch.column(0)
            held += np.bincount(lists.flatten().to_numpy() & (SLOTS - 1), minlength=SLOTS)
        for part in range(PARTS):
            own = held[part :: PARTS]
            at = np.flatnonzero(own)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at.astype("<i4").tobytes()]), pa.array([own[at].astype("<i8").tobytes()])], ["part", "at", "n"])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = np.zeros(SLOTS // PARTS, np.int64)
        for at, n in zip(rows.column("at"), rows.column("n"), strict=True):
            total[np.frombuffer(at.as_buffer(), "<i4")] += np.frombuffer(n.as_buffer(), "<i8")
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([total.astype("<i8").tobytes()])})

    out = np.zeros(SLOTS, np.int64)
    for r in nodes.select("sh").mapInArrow(count, "part int, at binary, n binary").groupBy("part").applyInArrow(add, "part int, n binary").collect():  # SLOTS numbers
        out[r.part :: PARTS] = np.frombuffer(r.n, "<i8")
    return out


def _by_rarest(nodes: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(a, b): pairs of nodes (uid, n, label) of different labels, with all that are similar enough among them.

    Each set is ordered from its rarest shingle on, by the counts of a table of SLOTS places; any one order for all sets
    is exact, this one keeps pairs few. What two sets share must begin within the first n - ceil(t n) + 1 of the larger
    and the first n - ceil(2 t n / (1 + t)) + 1 of the smaller one, and from there at most the shorter rest can be shared.
    """
    if nodes.isEmpty():
        return nodes.select(F.col("uid").alias("a"), F.col("uid").alias("b"))
    held = scratch.table(nodes.join(sets.select("uid", "sh"), "uid").select("uid", "n", "label", "sh"), "sets-of-big")
    counts = nodes.sparkSession.sparkContext.broadcast(_slots(held))

    @tidy
    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, n, label, shingles in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                own = shingles.values.to_numpy()
                seen = counts.value[own & (SLOTS - 1)]
                first = np.lexsort((own, seen))[: n - (n * percent + 99) // 100 + 1]
                place = np.flatnonzero(seen[first] > 1)  # a place that one shingle has is one set's alone
                k = len(place)
                if k:
                    found = own[first[place]]
                    whole = pa.array([found.tolist() if k <= SHOWN else None] * k, pa.list_(pa.int64()))
                    smaller = pa.array(place <= n + -2 * percent * n // (100 + percent))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, uid)), pa.array(np.full(k, n)), pa.array(np.full(k, label)), pa.array(found), pa.array(place + 1), whole, smaller], ["uid", "n", "label", "s", "i", "first", "smaller"])

    first = scratch.table(held.mapInArrow(rarest, "uid long, n long, label long, s long, i long, first array<long>, smaller boolean"), "rarest")
    left, right = _dealt(first, scratch)
    left = left.select("s", "cell", F.col("uid").alias("a"), "n", F.col("label").alias("x"), "i", F.col("first").alias("p"))
    right = right.select("s", "cell", F.col("uid").alias("b"), F.col("n").alias("m"), F.col("label").alias("y"), F.col("i").alias("j"), F.col("first").alias("q"))
    enough = lambda most: (100 + percent) * most >= percent * (F.col("n") + F.col("m"))
    # what both have among their first is known where these are few; all else that they share lies behind the first of one
    rest = lambda n: F.ceil(n * percent / 100) - 1
    known = F.size(F.array_intersect("p", "q")) + F.greatest(rest(F.col("n")), rest(F.col("m")))
    few = F.col("p").isNull() | F.col("q").isNull() | enough(known)
    met = left.join(right, ["s", "cell"]).where("(n < m or n = m and a < b) and x <> y").where(_near("n", "m", percent) & enough(1 + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))) & few)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _dealt(first: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Entries (uid, s, smaller, ...) as smaller and as larger sets, with the cells (s, cell) where each of both meets each once.

    A shingle's cells are a square: an entry stands in one of its rows as the smaller, in one of its columns as the larger.
    """
    held = first.groupBy("s").agg(F.count(F.lit(1)).alias("held"), F.count_if("smaller").alias("smaller")).where("held > 1 and smaller > 0")
    sides = scratch.table(held.select("s", F.ceil(F.sqrt(F.col("held") / CELL)).cast("int").alias("side")), "sides")
    few = sides.limit(BROADCAST + 1).count() <= BROADCAST
    entries = scratch.table(first.join(F.broadcast(sides) if few else sides, "s"), "entries")
    own, each = F.pmod(F.xxhash64("uid"), F.col("side")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("side") - 1))
    row = entries.where("smaller").select("*", each.alias("at")).withColumn("cell", own * F.col("side") + F.col("at"))
    column = entries.select("*", each.alias("at")).withColumn("cell", F.col("at") * F.col("side") + own)
    return row, column
