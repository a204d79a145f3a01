"""Line dedup: lines that many documents repeat are removed from all of them.

Line hashes live in levelled sorted runs, as in a log-structured merge tree. A run is a table of (hash, documents that
hold it) in buckets by the hash, each sorted by it, and all runs of a store have the same buckets. A batch of documents
is reduced to its distinct hashes, the one shuffle that it costs. Hashes that are known as frequent have runs of their
own and leave the batch by merge anti-joins; the rest of the batch is merge-joined with the older runs, so that hashes
whose counts together reach `min_docs` become the next run of known hashes, and then becomes a run of level 0. When a
level holds `fan_out` runs, they are merged two by two, by a full outer merge join that adds the counts, into one run of
the next level, so each hash is rewritten once a level. All these joins are bucket by bucket, in the buckets' own
order, without a shuffle.

There are BATCHES batches, or more where one would have over BATCH_DOCS documents. A store has a bucket for each
BUCKET_ROWS hashes, at least four and at most spark.sql.shuffle.partitions.

Rules, the same for any size of input:
- A text is split at \\n. A null or empty text is one empty line.
- A line's key is the line without ASCII white space ([\\x20\\x09-\\x0D]) at both ends, A-Z lower-cased.
- Keys shorter than `min_chars` code points are never dropped.
- A key counts once a document however often it repeats there. Two rows with the same id or text are two documents.
- Kept lines stay in order, unchanged, joined by \\n. When all lines go, the text is empty; a null text stays null
  unless `null_as_empty`.
- Hashes have 128 bits: xxh3_128 of the key's UTF-8 bytes.
- An empty table gives an empty table. Other columns pass through, whatever their names but n_lines and n_dropped.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.shared import BROADCAST_ROWS, Scratch, free_name, tidy

MIN_DOCS = 10
BATCHES, BATCH_DOCS, BUCKET_ROWS = 4, 500_000_000, 2_000_000
FAN_OUT = 2
_SORTED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
_SPACE = b" \t\n\x0b\x0c\r"


def _key(line: bytes) -> bytes:
    return line.strip(_SPACE).lower()


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _counts(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


class Levels:
    """Runs (h, n) in levels; `fan_out` runs of a level become one of the next. All are bucketed and sorted by h."""

    def __init__(self, scratch: Scratch, buckets: int, fan_out: int):
        self.scratch, self.buckets, self.fan_out = scratch, buckets, fan_out
        self.levels: list[list[DataFrame]] = []

    @property
    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def run(self, counted: DataFrame, name: str) -> DataFrame:
        with sorted_runs(self.scratch.spark):
            return self.scratch.run(counted, name, "h", self.buckets)

    def add(self, run: DataFrame) -> None:
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(run)
        at = 0
        while at < len(self.levels) and len(self.levels[at]) >= self.fan_out:
            old, self.levels[at] = self.levels[at], []
            if len(self.levels) == at + 1:
                self.levels.append([])
            self.levels[at + 1].append(self.merged(old, f"level{at + 1}"))
            self.scratch.drop(*old)
            at += 1

    def merged(self, runs: list[DataFrame], name: str) -> DataFrame:
        """One run of the runs' hashes, each with the sum of its counts."""
        out = runs[0]
        for i, r in enumerate(runs[1:]):
            joined = merge_of(out, r)
            done, out = out, self.run(joined, name)
            if i:
                self.scratch.drop(done)
        return out


def merge_of(a: DataFrame, b: DataFrame) -> DataFrame:
    """(h, n) of two runs. A union grouped by h would leave a hash of both twice: Spark takes a union of bucketed tables
    as dealt by their hash, but reads their buckets apart."""
    n = F.coalesce(a.n, F.lit(0)) + F.coalesce(b.n, F.lit(0))
    return a.hint("merge").join(b, a.h == b.h, "full_outer").select(F.coalesce(a.h, b.h).alias("h"), n.alias("n"))


@contextlib.contextmanager
def sorted_runs(spark: SparkSession) -> Iterator[None]:
    """Within it, buckets of one file count as sorted, so joins by the hash sort nothing again."""
    old = spark.conf.get(_SORTED, None)
    spark.conf.set(_SORTED, "true")
    try:
        yield
    finally:
        spark.conf.set(_SORTED, old) if old is not None else spark.conf.unset(_SORTED)


class LineRuns:
    """The runs of all hashes but the known ones, and those of the known (frequent) hashes."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fan_out: int = FAN_OUT, buckets: int = 4):
        self.spark, self.min_docs, self.buckets = spark, min_docs, buckets
        self.scratch = Scratch(spark, "line-runs")
        self.seen, self.known = Levels(self.scratch, buckets, fan_out), Levels(self.scratch, buckets, fan_out)

    def counts(self) -> DataFrame:
        """(h, n): how many documents held h before it was known as frequent, or hold it so far."""
        return self.seen.merged(self.seen.runs, "counts") if self.seen.runs else self.spark.createDataFrame([], "h binary, n bigint")

    def frequent(self) -> DataFrame:
        """The distinct hashes of at least min_docs documents. Known runs have no hash in common."""
        if not self.known.runs:
            return self.scratch.table(self.spark.createDataFrame([], "h binary"), "frequent")
        return self.scratch.table(reduce(DataFrame.unionByName, (r.select("h") for r in self.known.runs)), "frequent")

    def add(self, hashes: DataFrame) -> None:
        """One batch: hashes has one row for each document and key."""
        run = self.seen.run(hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).repartition(self.buckets, "h"), "batch")
        if self.known.runs:  # what is known as frequent needs no more counting
            left = run
            for known in self.known.runs:
                left = left.hint("merge").join(known.select("h"), "h", "left_anti")
            batch, run = run, self.seen.run(left, "run")
            self.scratch.drop(batch)
        total, n = run.select("h", "n"), F.col("n")
        for i, older in enumerate(self.seen.runs):
            total = total.hint("merge").join(older.select("h", F.col("n").alias(f"n{i}")), "h", "left")
            n = n + F.coalesce(F.col(f"n{i}"), F.lit(0))
        self.known.add(self.known.run(total.select("h", n.alias("n")).where(F.col("n") >= self.min_docs), "known"))
        self.seen.add(run)

    def drop(self) -> None:
        self.scratch.drop(*self.seen.runs, *self.known.runs)


def _dropper(frequent: set[bytes] | None, min_chars: int, out_schema: pa.Schema, at: int, null_as_empty: bool):
    """Rewrites column `at`; with frequent None, the last column of each batch lists the row's own frequent hashes."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = None if frequent is not None else batch.column(batch.num_columns - 1).to_pylist()
            texts, lines_in, lines_out = [], [], []
            for i, data in enumerate(_texts(batch.column(at))):
                lines = (data or b"").split(b"\n")
                known = frequent if own is None else set(own[i] or ())
                kept = [x for x in lines if not (known and _counts(k := _key(x), min_chars) and _hash(k) in known)] if known else lines
                texts.append(None if data is None and not null_as_empty else b"\n".join(kept))
                lines_in.append(len(lines))
                lines_out.append(len(lines) - len(kept))
            columns = [batch.column(i) for i in range(batch.num_columns - (own is not None))]
            columns[at] = pa.array(texts, pa.binary()).cast(out_schema.field(at).type)
            columns += [pa.array(lines_in, pa.int64()), pa.array(lines_out, pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out_schema, strict=True)], schema=out_schema)

    return run


def dedup_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = 1, batches: int | None = None, fan_out: int = FAN_OUT, null_as_empty: bool = False, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with frequent lines removed from `text`, plus n_lines and n_dropped (both long).

    Other columns pass through; columns already named n_lines or n_dropped raise ValueError. The frequent keys go to
    the executors as a broadcast while there are at most broadcast_rows of them; beyond, each text joins its own.
    """
    spark = docs.sparkSession
    if {"n_lines", "n_dropped"} & set(docs.columns):
        raise ValueError("docs already has a column n_lines or n_dropped")
    if batches is None:
        batches = max(BATCHES, -(-docs.count() // BATCH_DOCS))
    scratch = Scratch(spark, "lines")
    hashed = scratch.table(_in_batches(docs, text, min_chars, batches), "hashes", "batch")
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    store = LineRuns(spark, min_docs, fan_out, max(4, min(most, -(-hashed.count() // BUCKET_ROWS))))
    for b in range(batches):
        store.add(hashed.where(F.col("batch") == b).select("h"))
    frequent = store.frequent()
    store.drop()
    scratch.drop(hashed)
    schema, at = _arrow_schema(docs), docs.columns.index(text)
    ddl = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    if frequent.limit(broadcast_rows + 1).count() <= broadcast_rows:
        known = spark.sparkContext.broadcast({bytes(r.h) for r in frequent.collect()})

        def run(it, known=known):
            return _dropper(known.value, min_chars, schema, at, null_as_empty)(it)

        return docs.mapInArrow(run, ddl)
    # by the text's own hash: equal texts lose the same lines, and ids need not be unique
    of, own = free_name(docs, "text_hash"), free_name(docs, "own_lines")
    keyed = docs.withColumn(of, F.xxhash64(text))
    lines = _text_hashes(keyed, text, of, min_chars).join(frequent, "h").groupBy("of").agg(F.collect_set("h").alias(own))
    joined = keyed.join(scratch.table(lines.withColumnRenamed("of", of), "own"), of, "left").select(*docs.columns, own)
    return joined.mapInArrow(_dropper(None, min_chars, schema, at, null_as_empty), ddl)


def _in_batches(docs: DataFrame, text: str, min_chars: int, batches: int) -> DataFrame:
    """(h, batch): a row for each document and distinct key in it; documents go to the batches in turn."""

    @tidy
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in rows:
            out, of = [], []
            for data in _texts(batch.column(0)):
                keys = {_key(line) for line in (data or b"").split(b"\n")}
                found = [_hash(k) for k in keys if _counts(k, min_chars)]
                out += found
                of += [seen % batches] * len(found)
                seen += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(of, pa.int32())], ["h", "batch"])

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "h binary, batch int")


def _text_hashes(keyed: DataFrame, text: str, of_column: str, min_chars: int) -> DataFrame:
    @tidy
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out, of = [], []
            for data, t in zip(_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                found = [_hash(k) for k in {_key(line) for line in (data or b"").split(b"\n")} if _counts(k, min_chars)]
                out += found
                of += [t] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(out, pa.binary())], ["of", "h"])

    return keyed.select(F.col(text).cast("string"), of_column).mapInArrow(run, "of long, h binary").distinct()


def _arrow_schema(docs: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(docs.schema).append(pa.field("n_lines", pa.int64())).append(pa.field("n_dropped", pa.int64()))
