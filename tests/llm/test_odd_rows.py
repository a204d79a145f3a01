"""Each operator on one table of nulls, empty and very long texts, ties, repeated rows and clashing column names."""

import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusflow.llm import decontam, language_id, license_scan, line_dedup, minhash, packing, piece_bpe, sharding, token_counts, warc_zip

#: Names that operators use inside, or might.
CLASHES = ["uid", "row", "n", "ids", "key", "band", "h", "batch", "n_tokens_", "component", "part", "shard_", "cell", "label", "term"]


def texts():
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    long = " ".join(rnd.choice(words) for _ in range(60_000))  # over 250 kB
    near = " ".join(rnd.choice(words) for _ in range(300))
    return [None, "", " \t\n ", "one", "the same text here again today", "the same text here again today", near, near + " more", "x" * 200_000, long, "é漢字😀 \x00   end\r\n", "a\n" * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s" if i % 3 else None) for i, t in enumerate(texts())] + [(4, texts()[4], "s"), (None, "no id", None), (7, "another text of the same id", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for i, name in enumerate(CLASHES):
        df = df.withColumn(name, F.lit(i) if i % 2 else F.lit("z"))
    return df.repartition(4)


def held(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_line_dedup(docs):
    out = line_dedup.dedup_lines(docs.drop("n_lines"), min_docs=2, null_as_empty=True)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"] and Counter(r.doc_id for r in out.collect()) == Counter(i for i, _ in held(docs))


def test_sharding(docs):
    rows = sharding.shuffle_into_shards(docs.select("doc_id", "text"), "doc_id", "text", shards=5).collect()
    assert len(rows) == docs.count()
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert {(r.doc_id, r.size) for r in rows} == {(i, len((t or "").encode()) + 16) for i, t in held(docs)}
    assert sharding.shuffle_into_shards(docs.select("doc_id", "text").limit(0), "doc_id", "text", shards=5).count() == 0


def test_packing(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pack(docs, path, window=512, end_id=2).collect()
    tokenizer = Tokenizer.from_file(path)
    want = Counter((i, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in held(docs))
    got = Counter()
    for r in pieces:
        got[r.doc_id, r.doc_tokens] += r.length
    assert got == Counter({k: n * k[1] for k, n in want.items()})
    windows = Counter()
    for r in pieces:
        windows[r.sequence_id] += r.length
    assert sorted(windows) == list(range(len(windows))) and sum(n < 512 for n in windows.values()) <= 1
    assert packing.pack(docs.limit(0), path).count() == 0


def test_token_counts(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    out = token_counts.counted(docs.select("doc_id", "text"), path, limit=512).collect()
    assert Counter((r.doc_id, r.n_tokens, r.over_limit) for r in out) == Counter((i, n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in held(docs))
    assert token_counts.counted(docs.select("doc_id", "text").limit(0), path, limit=512).count() == 0


def test_near_duplicates(docs):
    out = minhash.near_duplicates(docs, words=5, percent=80).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in held(docs))
    of = {(r.doc_id, r.n_shingles): r.component_id for r in out}
    assert all(of[i, n] == i for (i, n) in of if n == 0)
    assert {c for (i, n), c in of.items() if i in (4, 5) and n} == {4}
    assert len({c for (i, n), c in of.items() if i in (6, 7) and n > 100}) == 1


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, "same text here again today"), (2, None), (3, ""), (1, "w1 w2"), (4, texts()[6])], "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    found = {(r.doc_id, r.item_id) for r in decontam.contained_items(docs, items, words=5, threshold=0.8).collect()}
    assert found == {(4, 1), (5, 1), (6, 4), (7, 4)}
    assert decontam.contained_items(docs.limit(0), items, words=5, threshold=0.8).count() == decontam.contained_items(docs, items.limit(0), words=5, threshold=0.8).count() == 0


def test_license_scan(docs):
    paths = docs.withColumn("path", F.when(F.col("doc_id") > 2, F.concat(F.lit("a/"), "doc_id")))
    assert Counter(r.doc_id for r in license_scan.scan(paths).collect()) == Counter(i for i, _ in held(docs))


def test_language(docs):
    labelled = docs.select("doc_id", "text", F.when(F.col("doc_id") < 9, "xx").alias("lang"), "source")
    out = language_id.identify_fitted(labelled.select("doc_id", "text", "source"), labelled, keep=["doc_id"], host="source").collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in held(docs))


def test_warc_of_large_and_repeated_pages(spark):
    rows = [(1, "http://a.example/1", None), (2, None, ""), (3, "http://a.example/3", "é" * 3_000_000), (4, "http://b.example", "é" * 3_000_000), (4, "http://b.example", "again"), (None, "http://c.example", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("offset", F.lit(3)).repartition(3)
    out = warc_zip.read_packages(warc_zip.write_packages(pages, min_revisit_bytes=0)).collect()
    assert Counter((r.record_id, r.payload_bytes) for r in out) == Counter((i, len((h or "").encode())) for i, _, h in rows)
    assert [r.refers_to for r in out if r.record_id == 4 and r.payload_bytes > 100] == [3]
    assert warc_zip.read_packages(warc_zip.write_packages(pages.limit(0), min_revisit_bytes=0)).count() == 0


def test_sentencepiece(docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    out = piece_bpe.encoded(docs.select("doc_id", "text"), path).collect()
    crc = lambda ids: zlib.crc32(repr(ids).encode())
    assert Counter((r.doc_id, crc(r.ids)) for r in out) == Counter((i, crc(None if t is None else library.encode(t))) for i, t in held(docs))
