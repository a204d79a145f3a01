"""Importance resampling towards a target distribution over hashed n-grams, by CRC combination algebra.

A feature is a run of 1 to `ngrams` words joined by one space, and its bucket is the CRC-32 of its bytes modulo
`buckets`. No n-gram is ever written out: the CRC of each distinct word is computed once a block, and that of a longer
run follows from crc(a + b) = Z(len b) crc(a) xor crc(b), where Z(n), the shift by n zero bytes, is a matrix over GF(2),
held as four tables of 256 values (matrices of the powers of two for long words).

Three passes: the corpus and the target are counted by bucket (a vector of `buckets` counts a task, summed by Spark);
each document's weight is the sum of its features' gains, with the gains broadcast (`buckets` numbers); the written
scores are dealt by range of score, and a document's rank is its place in its range plus the sizes of the ranges before.

Rules:
- A-Z are lower-cased, and only they. Words are maximal runs of 0-9, a-z and characters beyond ASCII. Whole texts.
- A null or empty text has no words: weight 0, and it is not drawn. Texts may have any length: long ones are taken in
  blocks that end between words and carry their last words on.
- gain = floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) for s of the corpus' S features and t of the
  target's T; an empty corpus or target counts 0.
- score = weight + floor(-1000 ln(-ln((h + 0.5) / 2^32))), with h the first 8 hexadecimal digits of
  sha256("<seed>:<id>"); a null id is the empty string there. So equal rows have equal scores.
- Of the N documents with at least `min_words` words, floor(percent N / 100) with the highest scores are drawn; ties go
  to smaller ids, null last. Each row with the same id counts by itself.
- Only id and text are read, so other columns may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.shared import Scratch, keeping, slices, small_batches, worker_state

BUCKETS, NGRAMS = 10_000, 3
#: Bytes of text that are counted at once.
BLOCK_BYTES = 4 << 20
_SHORT = 256
_POLYNOMIAL = np.uint32(0xEDB88320)  # of CRC-32, reflected

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


class Shifts:
    """Z(n): what n zero bytes after a text do to its CRC-32, for many n and CRCs at once."""

    def __init__(self):
        byte = np.arange(256, dtype=np.uint32)  # what a zero byte shifts out of a register, divided bit by bit
        for _ in range(8):
            byte = (byte >> np.uint32(1)) ^ np.where(byte & np.uint32(1), _POLYNOMIAL, np.uint32(0))
        short = [(np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()]  # Z(0)
        for _ in range(_SHORT):
            short.append((short[-1] >> np.uint32(8)) ^ byte[short[-1] & np.uint32(255)])
        self.short = np.concatenate(short)
        self.powers = [short[_SHORT]]  # Z(256), Z(512), ...
        for _ in range(23):
            self.powers.append(self._apply(self.powers[-1], 0, self.powers[-1]))

    @staticmethod
    def _apply(tables: np.ndarray, at: np.ndarray | int, crc: np.ndarray) -> np.ndarray:
        out = tables[at + (crc & np.uint32(255)).astype(np.int64)]
        for k in range(1, 4):
            out = out ^ tables[at + 256 * k + ((crc >> np.uint32(8 * k)) & np.uint32(255)).astype(np.int64)]
        return out

    def __call__(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = self._apply(self.short, (n % _SHORT) * 1024, crc)
        if len(n) and n.max() >= _SHORT:
            for k, tables in enumerate(self.powers):
                far = (n >> (8 + k)) & 1 == 1
                if far.any():
                    out[far] = self._apply(tables, 0, out[far])
        return out


class Grams:
    """Buckets of the features of texts."""

    def __init__(self, buckets: int, ngrams: int):
        self.buckets, self.ngrams, self.shift = buckets, ngrams, Shifts()

    def words(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(CRC, CRC with a space before, length with the space, text) of each word; text i ends at byte ends[i]."""
        inside = _WORD[data]
        first, last = inside.copy(), inside.copy()
        border = np.zeros(len(data) + 1, bool)
        border[ends] = True
        first[1:] &= ~inside[:-1] | border[1:-1]
        last[:-1] &= ~inside[1:] | border[1:-1]
        starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
        bounds = np.zeros(2 * len(starts) + 1, np.int64)  # words and what is between them, in turn
        bounds[:-1:2], bounds[1::2] = starts, stops
        bounds[-1] = len(data)
        held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = held.take(pa.array(np.arange(0, 2 * len(starts), 2))).dictionary_encode()
        distinct, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        space = zlib.crc32(b" ")
        crc = np.array([zlib.crc32(w) for w in distinct], np.uint32)[which]
        spaced = np.array([zlib.crc32(w, space) for w in distinct], np.uint32)[which]
        return crc, spaced, stops - starts + 1, np.searchsorted(ends, starts, side="right")

    def blocks(self, data: bytes, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(buckets of features, text of each, words of each text so far counted here) block by block."""
        flat = np.frombuffer(data.translate(_LOWER), np.uint8)
        at, carry = 0, None
        while at < len(flat):
            to = self._end(flat, at)
            here = np.clip(ends - at, 0, to - at)
            crc, spaced, size, of = words = self.words(flat[at:to], here)
            known = 0
            if carry is not None:
                known = len(carry[0])
                crc, spaced, size, of = words = tuple(np.concatenate(x) for x in zip(carry, words, strict=True))
            found, owner = [crc[known:]], [of[known:]]
            run = crc
            for n in range(2, self.ngrams + 1):  # run: CRCs of the runs of n - 1 words that end at each word from n - 2 on
                run = self.shift(run[:-1], size[n - 1 :]) ^ spaced[n - 1 :] if len(run) > 1 else run[:0]
                whole = of[n - 1 :] == of[: len(of) - n + 1]
                whole[: max(0, known - n + 1)] = False  # counted with the block before
                found.append(run[whole])
                owner.append(of[n - 1 :][whole])
            yield np.concatenate(found).astype(np.int64) % self.buckets, np.concatenate(owner), of[known:]
            carry = tuple(x[-self.ngrams + 1 :] if self.ngrams > 1 else x[:0] for x in words)
            at = to

    @staticmethod
    def _end(flat: np.ndarray, at: int) -> int:
        """The end of a block: a place between words, or the end of all."""
        to = at + BLOCK_BYTES
        while to < len(flat):
            gaps = np.flatnonzero(~_WORD[flat[at:to]])
            if len(gaps):
                return at + int(gaps[-1]) + 1
            to += BLOCK_BYTES
        return len(flat)


def _texts(batch: pa.RecordBatch, column: int) -> tuple[bytes, np.ndarray]:
    """All texts of a batch in one buffer, and where each ends. A null text is empty."""
    texts = batch.column(column)
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), pc.fill_null(texts.cast(pa.binary()), b"")), b"")[0]
    return joined.as_py() or b"", ends


def _grams(buckets: int, ngrams: int) -> Grams:
    return worker_state(f"importance-{buckets}-{ngrams}", lambda: Grams(buckets, ngrams))


def feature_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, ngrams: int = NGRAMS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket that has any."""
    small_batches(texts.sparkSession)

    @keeping("importance")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total = _grams(buckets, ngrams), np.zeros(buckets, np.int64)
        for whole in batches:
            for batch in slices(whole, 0):
                for found, _, _ in grams.blocks(*_texts(batch, 0)):
                    total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    counted = texts.select(F.col(text).cast("string")).mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, from the two results of feature_counts: `buckets` rows at most."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, held in ((corpus, s), (target, t)):
        for r in counts.collect():
            held[r.bucket] = r.n
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id: str = "doc_id", text: str = "text", ngrams: int = NGRAMS) -> DataFrame:
    """(id, n_words, n_features, weight) of each row. gain: of each bucket; it is sent to the executors."""
    spark, buckets = docs.sparkSession, len(gain)
    small_batches(spark)
    held = spark.sparkContext.broadcast(gain.astype(np.float64))

    @keeping("importance")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _grams(buckets, ngrams)
        for whole in batches:
            for batch in slices(whole, 1):
                n = batch.num_rows
                words, features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
                for found, of, words_of in grams.blocks(*_texts(batch, 1)):
                    words += np.bincount(words_of, minlength=n)
                    features += np.bincount(of, minlength=n)
                    weight += np.bincount(of, held.value[found], n).astype(np.int64)  # whole numbers far below 2^53
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, features, weight))], ["id", "n_words", "n_features", "weight"])

    given = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    return given.mapInArrow(run, f"id {given.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def scored(weights: DataFrame, seed: int = 42) -> DataFrame:
    """weights with score: the weight plus noise drawn by the id, so that the best are a sample without replacement."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weights.withColumn("score", F.col("weight") + noise)


def ranked(scores: DataFrame, percent: int = 5, min_words: int = 20) -> DataFrame:
    """scores with rank: 1, 2, ... of the drawn rows, null of the others. No window over all rows: rows are sorted by
    range of score, and a range's rows are numbered from the end of the range before."""
    scratch = Scratch(scores.sparkSession, "importance")
    rows = scratch.table(scores.withColumn("row", F.monotonically_increasing_id()), "scores")
    fits = (F.col("n_words") >= min_words).alias("fits")
    order = [F.desc("fits"), F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]  # row keeps equal rows from one range
    ranges = rows.select("*", fits).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = scratch.table(ranges.withColumn("place", F.monotonically_increasing_id()).select("*", F.shiftright("place", 33).alias("range"), (F.col("place").bitwiseAND((1 << 33) - 1) + 1).alias("at")).drop("place", "row"), "ranges")
    scratch.drop(rows)
    before, total, fit = {}, 0, 0
    for r in sorted(placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.count_if("fits").alias("fit")).collect()):  # one row a task
        before[r.range], total, fit = total, total + r.n, fit + r.fit
    starts = F.broadcast(scores.sparkSession.createDataFrame(list(before.items()), "range long, before long"))
    rank = F.col("before") + F.col("at")
    return placed.join(starts, "range").withColumn("rank", F.when(rank <= fit * percent // 100, rank)).drop("range", "before", "at", "fits")


def resampled(docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 5, min_words: int = 20, buckets: int = BUCKETS, ngrams: int = NGRAMS, seed: int = 42) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of each row of docs; rank is null where a row is not drawn."""
    gain = gains(feature_counts(docs, text, buckets, ngrams), feature_counts(target, target_text, buckets, ngrams), buckets)
    return ranked(scored(weighed(docs, gain, id, text, ngrams), seed), percent, min_words).withColumnRenamed("id", id)
