"""Sharding: a two-pass external shuffle of records into shards, in DataFrame functions only.

Pass 1 scatters records by seeded hashes into buckets that fit in memory and writes them: a record's shard depends on
its key and the number of shards alone, its bucket within the shard on a seeded hash of the record's place. Pass 2
gathers each bucket, sorts it by a seeded hash, applies Fisher-Yates (Spark's `shuffle`, with a seed), numbers the
records from the bucket's offset in its shard, and write_shards() writes them where they are, without a third shuffle.

The law is `key`, by a jump consistent hash: the j-th jump of a key leads from shard b to (b + 1) / u, u a hash of (key, j)
in (0, 1], and the last place below n is the key's shard. That gives every shard the same share, one more shard takes
rows only into itself, and the work grows with log n.

Rules: equal keys share a shard (null keys are equal). Repeated rows are separate records with slots of their own.
The bytes of each shard are measured, over all columns, and it gets buckets by them: a shard with a hot key has more
buckets, none of them larger, as a record's place in the input is what its bucket hashes. A record larger than a bucket
is one bucket. Within a shard, slots count from 0 without gaps.
The order is reproducible for the same files and partition settings; the shard always is. Columns named shard, slot,
grown_shard, size or with a leading `__` in the input raise ValueError. An empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.shared import Scratch

SHARDS = 40
BUCKET_BYTES = 8 << 20
SEED = 17


def jumps(key: Column, shards: int) -> Column:
    """struct<b, j>: the last place of the key's jumps below `shards`, and the first that is not."""
    # a key makes ln(n) jumps on average; that it makes so many has no chance worth naming
    most = 16 + 8 * math.ceil(math.log(shards + 1))
    u = lambda i: (F.shiftrightunsigned(F.xxhash64(key, i), 11) + 1) / F.lit(float(1 << 53))
    jump = lambda s, i: F.struct(s.j.alias("b"), F.least(F.floor((s.j + 1) / u(i)), F.lit(1 << 62)).alias("j"))
    start = F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(most)), start, lambda s, i: F.when(s.j < shards, jump(s, i)).otherwise(s))


def consistent_shard(key: Column, shards: int) -> Column:
    return jumps(key, shards).b.cast("int")


def record_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def _all_bytes(records: DataFrame) -> Column:
    """About what a record takes in memory."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)).cast("long") for c, kind in records.dtypes if kind in ("string", "binary")]
    return sum(texts, F.lit(16 * len(records.columns) + 32).cast("long"))


def shuffle_into_shards(records: DataFrame, key: str, text: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """records with size, shard, slot and grown_shard (its shard were there one more)."""
    clash = {"size", "shard", "slot", "grown_shard"} & set(records.columns) | {c for c in records.columns if c.startswith("__")}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are made here")
    jumped = records.withColumn("__jumps", jumps(F.col(key), shards))
    measured = {r.shard: r.b for r in jumped.groupBy(F.col("__jumps.b").alias("shard")).agg(F.sum(_all_bytes(records)).alias("b")).collect()}
    count = [max(1, math.ceil(measured.get(s, 0) / bucket_bytes)) for s in range(shards)]
    first = [sum(count[:s]) for s in range(shards)]
    of = lambda numbers: F.element_at(F.array(*[F.lit(n) for n in numbers]), (F.col("shard") + 1).cast("int")).cast("long")
    placed = (
        jumped.withColumn("size", record_bytes(F.col(text)))
        .withColumn("__row", F.monotonically_increasing_id())
        .withColumn("shard", F.col("__jumps.b").cast("int"))
        .withColumn("grown_shard", F.when(F.col("__jumps.j") == shards, F.lit(shards)).otherwise(F.col("shard")).cast("int"))
        .withColumn("__bucket", of(first) + F.pmod(F.xxhash64(F.lit(seed), "__row", key, "size"), of(count)))
        .drop("__jumps")
    )
    # written, as a row's place may change when its input is read again, and counts must be those of the same buckets
    placed = Scratch(records.sparkSession, "sharding").table(placed, "scattered", compression="zstd")
    record = F.struct(F.xxhash64(F.lit(seed + 1), "__row").alias("__order"), "__row", *[c for c in placed.columns if c not in ("__row", "__bucket", "shard")])
    gathered = (
        placed.select("__bucket", "shard", record.alias("__record"))
        .repartition(sum(count), "__bucket")
        .groupBy("__bucket")
        .agg(F.first("shard").alias("shard"), F.sort_array(F.collect_list("__record")).alias("__records"))
        .sortWithinPartitions("__bucket")
        .withColumn("__records", F.shuffle("__records", F.lit(seed)))
    )
    counted = placed.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return (
        gathered.join(starts, "__bucket")
        .select("shard", "__start", F.posexplode("__records").alias("__pos", "__record"))
        .select(*[F.col(f"__record.`{c}`").alias(c) for c in [*records.columns, "size"]], "shard", (F.col("__start") + F.col("__pos")).alias("slot"), F.col("__record.grown_shard").alias("grown_shard"))
    )


def write_shards(shuffled: DataFrame, path: str) -> DataFrame:
    """One folder a shard, each file in slot order with whole buckets; the records as read back."""
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path, compression="zstd")
    return shuffled.sparkSession.read.schema(shuffled.schema).parquet(path).select(*shuffled.columns)
