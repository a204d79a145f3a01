"""Packing, WARC packages, sharding, token counts, audio: round trips and brute force on small fixtures."""

import hashlib
import io
import random
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusflow.llm import audio, packing, sharding, token_counts, warc_zip

DOCS = "doc_id long, text string, source string, length int"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "  \n", "don't we'll 're 'r 'v 'lx 's 'st ''s", "a  b\n\n c\t\td", "x<|endoftext|>y <|startoftext|>", "日本語 テスト １２３ ½", "É́ ǅ \U0001f600", "a" * 700, " " * 300 + "x", "\x1c\x1d z\x85q\xa0r", "ΣΑΣ İ", "é tést", "the " * 2000]


def texts(n=40, seed=4):
    rnd = random.Random(seed)
    return [*ODD, *("".join(rnd.choice("abelrstvdm'' \n\té1２x.,!<|日Ω") for _ in range(rnd.randint(0, 300))) for _ in range(n))]


# --- packing ---


def test_word_tokens_equal_the_library():
    mine, library = packing.WordTokens(WORD), Tokenizer.from_file(WORD)
    for t in texts(300):
        assert np.frombuffer(mine.ids(t or ""), np.uint16).tolist() == library.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("partition_tokens", [1_000_000, 500])
def test_packing(spark, partition_tokens):
    rnd = random.Random(1)
    rows = [(i, t, rnd.choice(["big"] * 8 + ["small", None]), 1) for i, t in enumerate(texts(60))]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    out = packing.pack(docs, WORD, window=64, partition_tokens=partition_tokens).collect()
    library = Tokenizer.from_file(WORD)
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t, _, _ in rows}
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in out:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        assert np.frombuffer(r.ids, np.uint32).tolist() == ids[r.doc_id][r.start : r.start + r.length]
        by_doc[r.doc_id].append((r.start, r.length))
        by_window[r.sequence_id].append((r.offset, r.length, r.source))
    for i, all_ids in ids.items():
        at = 0
        for start, length in sorted(by_doc[i]):
            assert start == at
            at += length
        assert at == len(all_ids)
    assert sorted(by_window) == list(range(-(-sum(map(len, ids.values())) // 64)))
    for w, parts in by_window.items():
        at = 0
        for offset, length, _ in sorted(parts, key=lambda p: p[0]):
            assert offset == at
            at += length
        assert at == 64 or w == max(by_window)


def test_mixture_is_kept():
    left = [6000, 3000, 1000]
    served = np.zeros(3)
    for at, take in packing.deficit_round_robin(left, [0, 0, 0], [0.6, 0.3, 0.1], 0, 64):
        served += take
        if at + 64 <= 9900:
            assert np.abs(served - served.sum() * np.array([0.6, 0.3, 0.1])).max() < 2
    assert served.tolist() == left


def test_deficits_are_carried_between_partitions():
    takes = [t for _, t in packing.deficit_round_robin([40, 60], [30.0, -30.0], [0.5, 0.5], 0, 50)]
    assert takes[0] == [40, 10] and sum(map(sum, takes)) == 100


def test_packing_empty(spark):
    assert packing.pack(spark.createDataFrame([], DOCS), WORD).count() == 0


# --- WARC ---


@pytest.mark.parametrize("zip64", [False, True])
def test_packages(spark, zip64):
    rnd = random.Random(3)
    pages = [(i, f"http://h/{i}\r\n", rnd.choice([None, "", "same", "é" * 50, f"own {i}", "x" * 200_000 if i == 7 else "y"]), 5) for i in range(80)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, record_type int").repartition(3)
    manifest = warc_zip.write_packages(df, zip64=zip64, package_bytes=20_000)
    got = {r.record_id: r for r in warc_zip.read_packages(manifest).collect()}
    assert len(got) == 80 == manifest.agg(F.sum("records")).first()[0]
    first = {}
    for i, _, html, _ in pages:
        data = (html or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), warc_zip.sha1_base32(data))
        if data in first:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", first[data], None)
        else:
            first[data] = i
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, data)
    fs, path = pafs.FileSystem.from_uri(manifest.first().package)
    with zipfile.ZipFile(io.BytesIO(fs.open_input_file(path).read())) as z:
        assert z.testzip() is None and set(z.namelist()) == {warc_zip.DATA, warc_zip.INDEX}


def test_short_payloads_are_no_revisits(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = {r.record_id: r.record_type for r in warc_zip.read_packages(warc_zip.write_packages(df, min_revisit_bytes=4)).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert warc_zip.read_packages(warc_zip.write_packages(df.limit(0))).count() == 0


def test_zip_directory_of_other_writers(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("k", b"value" * 10)
        z.writestr("packed", b"value" * 10, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\5\6 is not here"
    with pa.memory_map(str(path)) as f:
        d = warc_zip.ZipDirectory(f)
        assert d.read("k", 5, 5) == b"value"
        with pytest.raises(ValueError):
            d.place("packed")
    (tmp_path / "b").write_bytes(b"no zip")
    with pa.memory_map(str(tmp_path / "b")) as f, pytest.raises(ValueError):
        warc_zip.ZipDirectory(f)


# --- sharding ---


def test_sharding(spark):
    rows = [(i % 90 if i % 3 else None, f"t{i}" * (i % 40), "s", 1) for i in range(400)] + [(5, None, None, 1)] * 3
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    out = sharding.shuffle_into_shards(docs, "doc_id", "text", shards=7, bucket_bytes=2000).collect()
    assert Counter((r.doc_id, r.text, r.source, r.length) for r in out) == Counter(rows)
    by_shard = defaultdict(list)
    for r in out:
        by_shard[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 7) and r.size == len((r.text or "").encode()) + 16
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert all(len({r.shard for r in out if r.doc_id == i}) == 1 for i in {r.doc_id for r in out})


def test_shards_are_even_and_stable(spark):
    ids = spark.range(20_000).select(*[sharding.consistent_shard(F.col("id"), n).alias(f"s{n}") for n in (1, 10, 11)])
    counts = [r["count"] for r in ids.groupBy("s10").count().collect()]
    assert len(counts) == 10 and min(counts) > 1800 and max(counts) < 2200
    assert ids.where("s11 <> s10 and s11 <> 10 or s1 <> 0").count() == 0
    assert 1500 < ids.where("s11 = 10").count() < 2150


def test_sharding_edges(spark, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    assert sharding.shuffle_into_shards(docs, "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        sharding.shuffle_into_shards(docs.withColumnRenamed("length", "slot"), "doc_id", "text")
    some = spark.createDataFrame([(i, "x", "s", 1) for i in range(50)], DOCS)
    sharding.write_shards(sharding.shuffle_into_shards(some, "doc_id", "text", shards=3), str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 50


# --- token counts ---


def test_token_counts_equal_the_library(spark):
    library = Tokenizer.from_file(BYTE)
    rows = [(i, t, "s", 1) for i, t in enumerate(texts(300))]
    out = token_counts.counted(spark.createDataFrame(rows, DOCS).repartition(3), BYTE, limit=100).collect()
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t, _, _ in rows}
    assert {r.doc_id: r.n_tokens for r in out} == want
    assert all(r.over_limit == (r.n_tokens > 100) and r.n_bytes == len((rows[r.doc_id][1] or "").encode()) for r in out)
    assert token_counts.counted(spark.createDataFrame([], DOCS), BYTE, 1).count() == 0


def test_full_table_falls_back(monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_STATES", 40)
    counter, library = token_counts.TokenCounter(BYTE), Tokenizer.from_file(BYTE)
    some = [t or "" for t in texts(80)]
    assert counter.counts(some) == [len(library.encode(t, add_special_tokens=False).ids) for t in some]
    assert counter.counts([]) == []


def test_classes_of_all_characters():
    import regex

    classes = token_counts._classes()
    assert all((classes[ord(c)] == token_counts._CNUM) == bool(regex.match(r"\p{N}", c)) for c in map(chr, range(0x3000)))
    splitter = Tokenizer.from_file(BYTE).pre_tokenizer
    for cp in [*range(0, 0x3000, 7), 0x1C, 0x85, 0xA0, 0x180E, 0x200B, 0x3000, 0xFEFF]:
        joined = len(splitter.pre_tokenize_str("a" + chr(cp))) == 1
        letter = classes[cp] in (token_counts._CLETTER, token_counts._CSTMD, token_counts._CR, token_counts._CV, token_counts._CLL, token_counts._CE)
        assert joined == letter, hex(cp)


# --- audio ---


def test_wav_round_trip():
    for data in (b"", b"\0\xff", b"abc", bytes(range(256)) * 40):
        assert audio.from_wav(audio.to_wav(data)) == (data, audio.RATE)
    with pytest.raises(ValueError):
        audio.from_wav(b"RIFF....AVI ")
    with pytest.raises(ValueError):
        audio.from_wav(audio.to_wav(b"abcdef")[:-3])


def test_resample_keeps_tones():
    t = np.arange(8000) / 16000
    y = audio.resample(np.sin(2 * np.pi * 440 * t), 12000, 16000)
    u = np.arange(len(y)) / 12000
    assert len(y) == 6000 and np.abs(y - np.sin(2 * np.pi * 440 * u))[100:-100].max() < 0.01
    assert np.abs(audio.resample(np.sin(2 * np.pi * 7500 * t), 12000, 16000))[100:-100].max() < 0.01


def test_segments_by_hysteresis():
    db = np.array([-40, -15, -5, -15, -15, -30, -15, -30, -3, 0.0])
    assert audio.segments(10 ** (db / 10)) == [(2, 5), (8, 10)]
    assert audio.segments(np.zeros(4)) == []


def test_log_mel_in_blocks(monkeypatch):
    x = np.random.default_rng(0).normal(size=20_000)
    whole = audio.log_mel(x, 12000)
    monkeypatch.setattr(audio, "BLOCK", 7)
    assert np.allclose(whole[0], audio.log_mel(x, 12000)[0]) and np.allclose(whole[1], audio.log_mel(x, 12000)[1])
    tone = audio.log_mel(np.sin(2 * np.pi * 1000 * np.arange(6000) / 12000), 12000)[0]
    assert abs(int(tone[5].argmax()) - 6) <= 2


def test_audio_tensors(spark):
    clips = [(1, audio.to_wav(bytes(range(256)) * 60), 9), (2, None, 9), (3, audio.to_wav(b""), 9), (4, audio.to_wav(b"a"), 9)]
    out = audio.audio_features(spark.createDataFrame(clips, "clip long, media binary, start int")).collect()
    assert {r.clip for r in out} == {1, 4} and all(len(r.log_mel) == audio.FRAMES * audio.MELS for r in out)
    spans = [(r.start_ms, r.end_ms) for r in sorted(out, key=lambda r: r.tensor_no) if r.clip == 1]
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    tensors = audio.tensor_array(np.zeros((2, audio.FRAMES, audio.MELS)))
    assert tensors.type.shape == [audio.FRAMES, audio.MELS]


def test_texts_as_audio(spark):
    rows = [(i, t, "s", 1) for i, t in enumerate([*ODD[:6], "é" * 288, "é" * 289, "same", "same"])]
    out = {r.doc_id: r for r in audio.texts_as_audio(spark.createDataFrame(rows, DOCS)).collect()}
    for i, t, _, _ in rows:
        data = (t or "").encode()
        full = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
    assert out[8].feature == out[9].feature and out[8].media_sha256 == out[9].media_sha256
    assert audio.texts_as_audio(spark.createDataFrame([], DOCS)).count() == 0


# --- edges: nulls, repeated rows, skew, long texts ---


def test_packages_of_null_and_repeated_ids(spark):
    """One response a payload, also where ids repeat; null ids stay; addresses come back."""
    big = "z" * 3_000_000
    rows = [(1, "http://a", "x", 0), (1, "http://a", "x", 0), (2, None, "x", 0), (None, "http://n", "x", 0), (None, "http://m\r\nb", "only null", 0), (None, None, "only null", 0), (7, "", None, 0), (8, "u", "", 0), (9, "u", big, 0), (9, "v", big, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, start int").repartition(3)
    got = warc_zip.read_packages(warc_zip.write_packages(df, package_bytes=10_000), index_bytes=150).collect()
    kinds = Counter((r.record_id, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert kinds == Counter({(1, "response", None, 1): 1, (1, "revisit", 1, 1): 1, (2, "revisit", 1, 1): 1, (None, "revisit", 1, 1): 1, (None, "response", None, 9): 2, (7, "response", None, 0): 1, (8, "revisit", 7, 0): 1, (9, "response", None, 3_000_000): 1, (9, "revisit", 9, 3_000_000): 1})
    assert Counter(r.url for r in got) == Counter(None if u is None else u.replace("\r", "%0D").replace("\n", "%0A") for _, u, _, _ in rows)


@pytest.mark.parametrize("index_bytes", [1, 97, 1 << 20])
def test_packages_are_read_in_parts(spark, index_bytes):
    df = spark.createDataFrame([(i, f"http://h/{i}", f"page {i}") for i in range(60)], "page_id long, url string, html string").repartition(2)
    out = warc_zip.read_packages(warc_zip.write_packages(df), index_bytes=index_bytes).collect()
    assert sorted((r.record_id, r.url, bytes(r.payload)) for r in out) == sorted((i, f"http://h/{i}", b"page %d" % i) for i in range(60))


def test_damaged_packages(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("näme", b"value" * 100)
        z.writestr("k", b"value" * 100)
    data = bytearray(path.read_bytes())
    at = data.rfind(b"value", 0, data.find(b"PK\1\2"))
    data[at] ^= 1
    path.write_bytes(bytes(data))
    with pa.memory_map(str(path)) as f:
        d = warc_zip.ZipDirectory(f)
        assert set(d.members) == {"näme", "k"} and d.read("näme") == b"value" * 100
        with pytest.raises(ValueError, match="CRC"):
            d.read("k")


def test_buckets_of_a_hot_shard(spark, monkeypatch):
    """Three quarters of the rows share a key: its shard gets more buckets, not larger ones."""
    from corpusflow.llm.shared import Scratch

    seen = []
    table = Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, *a, **b: seen.append(table(self, df, *a, **b)) or seen[-1])
    rows = [(None if i % 4 else i, "x" * 500, "s", 1) for i in range(2000)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    out = sharding.shuffle_into_shards(docs, "doc_id", "text", shards=5, bucket_bytes=50_000)
    sizes = [r.b for r in seen[0].groupBy("__bucket").agg(F.sum(F.length("text")).alias("b")).collect()]
    assert max(sizes) < 2 * 50_000 and len(sizes) > 20
    hot = {r.shard for r in out.where("doc_id is null").select("shard").distinct().collect()}
    slots = defaultdict(list)
    for r in out.select("shard", "slot").collect():
        slots[r.shard].append(r.slot)
    assert len(hot) == 1 and all(sorted(x) == list(range(len(x))) for x in slots.values()) and sum(map(len, slots.values())) == 2000


def test_shards_of_thousands(spark):
    ids = spark.range(5000).select(sharding.consistent_shard(F.col("id"), 10_000).alias("a"), sharding.consistent_shard(F.col("id"), 10_001).alias("b"))
    rows = ids.collect()
    assert all(r.a == r.b or r.b == 10_000 for r in rows) and len({r.a for r in rows}) > 3500 and max(r.a for r in rows) < 10_000


def test_resample_equals_direct_convolution():
    x = np.random.default_rng(2).normal(size=400)
    up, down, half = 3, 4, 8
    n = np.arange(-half * 4, half * 4 + 1)
    taps = up / 4 * np.sinc(n / 4) * np.hanning(len(n) + 2)[1:-1]
    dense = np.zeros(len(x) * up)
    dense[::up] = x
    want = np.convolve(dense, taps)[half * 4 :][::down][: -(-len(x) * up // down)]
    got = audio.resample(x, 12000, 16000)
    assert np.allclose(got, want)
    assert np.allclose(np.concatenate([audio.resample_range(x, 12000, 16000, a, min(a + 37, 300)) for a in range(0, 300, 37)]), got)


def test_log_mel_equals_slow_transform():
    x = np.random.default_rng(3).normal(size=1000)
    mel, energy = audio.log_mel(x, 12000)
    k = np.arange(audio.FRAME)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * k / audio.FRAME)
    hz = lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = [hz(m) for m in np.linspace(0, 2595 * np.log10(1 + 6000 / 700), audio.MELS + 2)]
    padded = np.concatenate([x, np.zeros(5000)])
    for f in range(len(mel)):
        part = padded[f * audio.HOP : f * audio.HOP + audio.FRAME] * window
        power = [abs(np.sum(part * np.exp(-2j * np.pi * b * k / audio.FRAME))) ** 2 for b in range(audio.FRAME // 2 + 1)]
        for m in range(audio.MELS):
            total = 0.0
            for b, p in enumerate(power):
                at = b * 12000 / audio.FRAME
                total += p * max(0.0, min((at - edges[m]) / (edges[m + 1] - edges[m]), (edges[m + 2] - at) / (edges[m + 2] - edges[m + 1])))
            assert abs(mel[f, m] - np.log(total + audio.FLOOR)) < 1e-6
        assert abs(energy[f] - np.sum(part**2)) < 1e-9


def test_stored_tensors_of_a_long_clip():
    """Blocks give the same tensors as the whole signal at once, read back from their Arrow stream."""
    data = np.random.default_rng(4).integers(0, 256, 2_500_000, dtype=np.uint8).tobytes()
    stream, frames, spans = audio.store_tensors(audio.to_wav(data))
    mel, energy = audio.log_mel(audio.resample((np.frombuffer(data, np.uint8) - 127.5) / 127.5, 12000, 16000), 12000)
    batches = list(audio.stored_batches(stream))
    assert batches[0].column(0).type.shape == [audio.FRAMES, audio.MELS] and len(batches) > 1
    stored = np.concatenate([b.column(0).to_numpy_ndarray().reshape(-1, audio.MELS) for b in batches])[:frames]
    assert frames == len(mel) and np.allclose(stored, mel, atol=1e-4) and spans == [(a * 16, b * 16) for a, b in audio.segments(energy)]
    ends = [x for b in batches for x in b.column(2).to_pylist()]
    assert ends[-1] == frames * 16 and audio.feature_string(stream, spans).startswith(f"{frames}:{len(spans)}:")


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 5)], "doc_id long, text string, source string, n long")
    odd = docs.withColumns({"ids": F.lit(1), "offset": F.lit(2), "sequence_id": F.lit(3), "uid": F.lit(4), "h": F.lit(5), "key": F.lit(6), "band": F.lit(7), "row": F.lit(8), "media": F.lit(9)})
    assert packing.pack(odd, WORD).count() == 1 and token_counts.counted(odd, BYTE, 1).first().n_tokens == 2
    assert audio.texts_as_audio(odd).first().n_bytes == 3
    pages = odd.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumn("url", F.lit("u"))
    assert warc_zip.read_packages(warc_zip.write_packages(pages)).count() == 1


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b", None, 1), (None, "a b", None, 1), (3, None, None, 1), (3, None, None, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(str(r.doc_id) for r in audio.texts_as_audio(docs).collect()) == ["3", "3", "None", "None"]
    assert sorted((str(r.doc_id), r.n_tokens) for r in token_counts.counted(docs, BYTE, 1).collect()) == [("3", 0), ("3", 0), ("None", 2), ("None", 2)]
    assert sum(r.length for r in packing.pack(docs, WORD).collect()) == sum(r.doc_tokens for r in packing.pack(docs, WORD).collect())
    assert sharding.shuffle_into_shards(docs, "doc_id", "text", shards=2).count() == 4
