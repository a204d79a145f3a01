"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only.

An item of q shingles is inside a document when the document holds at least `threshold` of them. Items are partitioned
by size, into classes of q from 2^c to 2^(c+1) - 1. A class sets two numbers:
- the sketch length k: each item is sketched by the k smallest of its shingles' hashes, a bottom-k MinHash, where k is
  one more than the shingles that the class's largest item may miss. So a document that contains the item holds at
  least one shingle of its sketch, however long the document is, and no qualifying pair is missed;
- the shingles that a document must have to contain the class's smallest item: shorter documents skip the class.

Documents probe the classes with all shingles of the whole text. Pairs found are verified by exact containment: the
item's shingles and the document's, each made once, are counted where they meet, so a document that holds thousands of
items costs its own shingles and theirs.

Rules:
- Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; a shingle is `words` words in a row.
- An item with fewer words than that (or no text) has no shingles and matches nothing, and so does such a document.
- Repeated shingles count once. Repeated item or document rows: ids are taken as given, and a pair of ids is reported
  once, with the best containment of its rows. Null ids never match. Extra columns are ignored.
- An empty table of documents or items gives no rows.
- Sketches go to the executors by broadcast while the items have at most `broadcast_rows` shingles (a count that is
  checked); beyond, Spark shuffles both sides. The same holds for the ids of documents to be verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.shared import BROADCAST_ROWS, Scratch

WORDS = 5
THRESHOLD = 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACES = r"[\x20\x09-\x0D]+"


def runs(text: Column, words: int = WORDS) -> Column:
    """array<long>: the hashes of all runs of `words` words in order; empty if there are fewer."""
    tokens = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _SPACES), lambda w: w != "")
    hashed = F.transform(tokens, lambda w: F.xxhash64(w))
    # a one-element array binds the hashes to a name, or each step of the inner loop would make them anew
    rolled = F.transform(F.array(hashed), lambda a: F.slice(F.transform(a, lambda x, i: F.xxhash64(x, *[F.get(a, i + j) for j in range(1, words)])), F.lit(1), F.greatest(F.size(a) - (words - 1), F.lit(0))))
    return F.element_at(rolled, 1)


def shingles(text: Column, words: int = WORDS) -> Column:
    """array<long>: runs(), each once."""
    return F.array_distinct(runs(text, words))


def sketched(items: DataFrame, item_id: str, text: str, words: int, threshold: float) -> DataFrame:
    """(item_id, item, q, size_class, need, sketch, sh): sketch is the bottom k of the item's set sh.

    k and need, the fewest shingles of a document that holds such an item, are those of the item's size class.
    """
    q, least = F.size("sh"), F.pow(F.lit(2.0), F.col("size_class"))
    most = 2 * least - 1
    k = most - F.ceil(most * threshold - 1e-9) + 1
    return (
        items.where(F.col(item_id).isNotNull())
        .select(F.col(item_id).cast("long").alias("item_id"), F.xxhash64(F.col(text)).alias("item"), shingles(F.col(text), words).alias("sh"))
        .where(q > 0)
        .withColumn("q", q)
        .withColumn("size_class", F.length(F.bin("q")) - 1)
        .withColumn("need", F.ceil(least * threshold - 1e-9).cast("int"))
        .withColumn("sketch", F.slice(F.transform(F.array_sort(F.transform("sh", lambda h: F.struct(F.xxhash64(h).alias("order"), h.alias("h")))), lambda x: x.h), F.lit(1), k.cast("int")))
        .dropDuplicates(["item_id", "item"])
    )


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared_shingles, containment), one row for each document that holds an item."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontam")
    index = scratch.table(sketched(items, item_id, item_text, words, threshold), "items")
    small = (index.agg(F.coalesce(F.sum("q"), F.lit(0)).alias("n")).first().n) <= broadcast_rows
    hint = F.broadcast if small else (lambda df: df)
    keys = index.select("item_id", "item", "q", "need", F.explode("sketch").alias("h"))
    # rows of one id are told apart by their text's hash
    full = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(doc_text)).alias("row"), F.col(doc_text).alias("__text"))
    # a row of its own binds the runs and their number, or they would be made for each
    held = F.transform(F.array(runs(F.col("__text"), words)), lambda a: F.struct(F.size(a).alias("n"), a.alias("sh")))
    probes = full.select("doc_id", "row", F.explode(held).alias("r")).select("doc_id", "row", "r.n", F.explode("r.sh").alias("h"))
    pairs = scratch.table(probes.join(hint(keys), "h").where(F.col("n") >= F.col("need")).select("doc_id", "row", "item_id", "item").distinct(), "pairs")
    wanted = pairs.select("doc_id", "row").distinct()
    few = wanted.limit(broadcast_rows + 1).count() <= broadcast_rows
    held = full.join(F.broadcast(wanted) if few else wanted, ["doc_id", "row"], "left_semi").select("doc_id", "row", F.explode(shingles(F.col("__text"), words)).alias("h")).distinct()
    asked = pairs.join(hint(index.select("item_id", "item", "q", "sh")), ["item_id", "item"]).select("doc_id", "row", "item_id", "item", "q", F.explode("sh").alias("h"))
    counted = asked.join(held, ["doc_id", "row", "h"]).groupBy("doc_id", "row", "item_id", "item", "q").agg(F.count(F.lit(1)).alias("shared"))
    verified = counted.where(F.col("shared") >= F.ceil(F.col("q") * F.lit(threshold) - F.lit(1e-9)))
    best = verified.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("shared") / F.col("q")).alias("c"), "q", "shared")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.q").cast("long").alias("item_shingles"), F.col("b.shared").cast("long").alias("shared_shingles"), F.round("b.c", 6).alias("containment"))


def without_items(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without those that hold an item; rows with a null id stay."""
    doc_id = options.get("doc_id", "doc_id")
    rows = options.get("broadcast_rows", BROADCAST_ROWS)
    hit = Scratch(docs.sparkSession, "decontam").table(contained_items(docs, items, **options).select(F.col("doc_id").alias(doc_id)).distinct(), "hit")
    return docs.join(F.broadcast(hit) if hit.limit(rows + 1).count() <= rows else hit, doc_id, "left_anti")
