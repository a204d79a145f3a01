"""State: file deltas, keyed merges, eviction, offsets, first-write-wins tables. All return new tables; none is
overwritten while it is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.retrieval import small


def file_delta(before: DataFrame, now: DataFrame, key: str = "path", compare: tuple[str, ...] = ("mtime_ns", "size_bytes"), label: str | None = None) -> DataFrame:
    """(key, change): NEW, MODIFIED, UNCHANGED or DELETED. With a label, only its part of the state counts."""
    if label is not None:
        before = before.where(F.col("label") == label)
        now = now.where(F.col("label") == label)
    old = before.select(key, F.struct(*compare).alias("old"))
    new = now.select(key, F.struct(*compare).alias("new"))
    change = F.when(F.col("old").isNull(), "NEW").when(F.col("new").isNull(), "DELETED").when(F.col("old").eqNullSafe(F.col("new")), "UNCHANGED").otherwise("MODIFIED")
    return old.join(new, key, "full_outer").select(key, change.alias("change"))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in that order, which must tell a key's rows apart. Rows meet after a partial maximum, so
    a key may have any share of them."""
    rest = [c for c in rows.columns if c not in keys]
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), place).alias("__r")) if rest else rows.select(*keys).distinct()
    return best.select(*[F.col(f"`{c}`") if c in keys else F.col(f"__r.`{c}`").alias(c) for c in rows.columns])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """old with the rows of new in place of those with the same keys; of repeated new rows the last in `order` wins.

    Without an order nothing tells which is last: equal rows are one, and a key with different rows is an error.
    """
    if order:
        last = latest(new, keys, order)
    else:
        rest = F.struct(*[F.col(f"`{c}`") for c in new.columns])
        counted = new.distinct().groupBy(*keys).agg(F.first(rest).alias("__r"), F.count(F.lit(1)).alias("__n"))
        checked = F.when(F.col("__n") > 1, F.raise_error(F.lit(f"repeated {keys} need an order")).cast(new.schema)).otherwise(F.col("__r"))
        last = counted.select(checked.alias("__r")).select("__r.*")
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last, allowMissingColumns=True)


def evict_stale(chunks: DataFrame, batches: DataFrame) -> DataFrame:
    """chunks without those of a (source_url) in batches under another ingestion_batch_id."""
    current = batches.select("source_url", F.col("ingestion_batch_id").alias("__current")).distinct()
    gone = chunks.join(current, "source_url").where(F.col("ingestion_batch_id") != F.col("__current")).select("source_url", "ingestion_batch_id").distinct()
    return chunks.join(gone, ["source_url", "ingestion_batch_id"], "left_anti")


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key), key, "left_anti")


def first_wins(tables: list[DataFrame], keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, value): the first in table order, then by `order`."""
    one = None
    for i, t in enumerate(tables):
        part = t.select(*keys, value, F.struct(F.lit(i).alias("t"), F.col(order).alias("o")).alias("__at"))
        one = part if one is None else one.unionByName(part)
    return one.groupBy(*keys).agg(F.min_by(value, "__at").alias(value))


def offset_order(value: Column) -> Column:
    """What offsets of one kind are compared by: whole numbers by their size, times by their instant; tokens not at all.

    Fields kind ('number', 'time' or 'token'), number and time. Strings are numbers if they are all digits, and times if
    they are ISO times; columns of other types keep their type's order.
    """
    text = value.cast("string")
    number = F.when(text.rlike(r"^\d{1,38}$"), text.cast("decimal(38,0)"))
    time = F.when(text.rlike(r"^\d{4}-\d\d-\d\d"), F.try_to_timestamp(text))
    kind = F.when(number.isNotNull(), "number").when(time.isNotNull(), "time").otherwise("token")
    return F.struct(kind.alias("kind"), number.alias("number"), time.alias("time"))


def merged_offsets(offsets: DataFrame, advanced: DataFrame) -> DataFrame:
    """(source, value): the highest advanced value of a source replaces its old one, unless that is of the same kind and
    higher, so offsets never move back; a token replaces the old one. Other sources keep theirs, and null values count
    as none."""
    best = advanced.where("value is not null").groupBy("source").agg(F.max_by("value", F.struct(offset_order(F.col("value")), "value")).alias("new"))
    both = offsets.select("source", F.col("value").alias("old")).join(best, "source", "full_outer")
    old, new = offset_order(F.col("old")), offset_order(F.col("new"))
    higher = (old.kind == new.kind) & (old.kind != "token") & (old > new)
    return both.select("source", F.when(F.col("new").isNull() | higher, F.col("old")).otherwise(F.col("new")).alias("value"))


def seeded_offsets(offsets: DataFrame, sources: DataFrame) -> DataFrame:
    """offsets (source, value) with a row for each registered source (source, first) that has none yet."""
    new = sources.join(offsets.select("source"), "source", "left_anti").select("source", F.col("first").alias("value"))
    return offsets.unionByName(new)


def after_offset(items: DataFrame, offsets: DataFrame, source: str = "source", ts: str = "ts") -> DataFrame:
    """Items later than their source's offset; a source without one gives all."""
    o = offsets.select(F.col("source").alias("__s"), F.col("value").alias("__v"))
    return items.join(small(o), F.col(source) == F.col("__s"), "left").where(F.col("__v").isNull() | (F.col(ts) > F.col("__v"))).drop("__s", "__v")


def preserved(state: DataFrame, rescanned: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """Entries of labels that were not scanned, and all that the scan of `labels` found."""
    return state.join(small(labels.select(label).distinct()), label, "left_anti").unionByName(rescanned)


def reverted(delta: DataFrame, failed: DataFrame, key: str = "path") -> DataFrame:
    """(key, change, applied): changes whose embedding failed are not applied."""
    bad = failed.select(key).distinct().withColumn("__bad", F.lit(True))
    return delta.join(bad, key, "left").withColumn("applied", F.col("__bad").isNull()).drop("__bad")


def merged_seeds(seeds: DataFrame, made: DataFrame, question: str = "question") -> DataFrame:
    """Seeds, then made questions that no seed asks already."""
    same = lambda c: F.lower(F.trim(c))
    known = seeds.select(same(F.col(question)).alias("__q")).distinct()
    new = made.withColumn("__q", same(F.col(question))).join(known, "__q", "left_anti").drop("__q")
    return seeds.withColumn("source", F.lit("seed")).unionByName(new.withColumn("source", F.lit("synth")))


def new_links(links: DataFrame, seen: DataFrame, url: str = "url") -> DataFrame:
    return links.select(url).distinct().join(seen.select(url), url, "left_anti")


def reachable(links: DataFrame, start: DataFrame, max_depth: int, checkpoint_every: int = 3) -> DataFrame:
    """(url, depth) from the start set over (source, target) links, by rounds of joins with what is unseen."""
    seen = start.select("url").distinct().withColumn("depth", F.lit(0))
    front = seen
    for depth in range(1, max_depth + 1):
        front = links.join(front.select(F.col("url").alias("source")), "source", "left_semi").select(F.col("target").alias("url")).distinct().join(seen, "url", "left_anti").withColumn("depth", F.lit(depth))
        seen = seen.unionByName(front)
        if depth % checkpoint_every == 0 and seen.sparkSession.sparkContext.getCheckpointDir():
            seen, front = seen.checkpoint(), front.checkpoint()
    return seen
