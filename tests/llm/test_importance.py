"""Importance resampling against brute force over written-out n-grams."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusflow.llm import importance

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
AZ = {c: c + 32 for c in range(65, 91)}


def features(text, ngrams=3):
    words = WORD.findall((text or "").translate(AZ))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, ngrams + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, percent, min_words, buckets=10_000, ngrams=3, seed=42):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    of = [(i, *features(t, ngrams)) for i, t in rows]
    s = Counter(bucket(f) for _, _, fs in of for f in fs)
    t = Counter(bucket(f) for x in target for f in features(x, ngrams)[1])
    S, T = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)}
    out = []
    for i, n, fs in of:
        weight = sum(gain[bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    for k, r in enumerate(fit[: len(fit) * percent // 100]):
        r[5] = k + 1
    return Counter(tuple(r) for r in out)


def got(df):
    return Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("block", [4 << 20, 64])
def test_crcs_of_runs(block, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK_BYTES", block)
    rnd = random.Random(block)
    texts = ["", "one", "a b", "é漢字 Ünd x9 _a", "w" * 700 + " b " + "v" * 5000 + " c d", "x" * 255 + " " + "y" * 256 + " z"]
    texts += ["".join(rnd.choice("aB é,.\n12") for _ in range(rnd.randint(0, 300))) for _ in range(60)] + ["end", "start"]
    data = [t.encode() for t in texts]
    for ngrams in (1, 2, 3, 5):
        found = [Counter() for _ in texts]
        words = np.zeros(len(texts), int)
        for buckets, of, words_of in importance.Grams(1 << 32, ngrams).blocks(b"".join(data), np.cumsum([len(d) for d in data])):
            words += np.bincount(words_of, minlength=len(texts))
            for b, i in zip(buckets.tolist(), of.tolist(), strict=True):
                found[i][b] += 1
        assert words.tolist() == [features(t)[0] for t in texts]
        assert found == [Counter(zlib.crc32(f.encode()) for f in features(t, ngrams)[1]) for t in texts]


def test_same_as_brute_force(spark):
    rnd = random.Random(13)
    words = ["clown", "The", "river", "É", "12", "über-all", "x_y", "漢字"]
    rows = [(i % 150 if i % 40 else None, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))) for i in range(300)]
    rows += [(500, None), (501, ""), (502, "long word " * 30_000), (503, "z" * 100_000)] + [(600, rows[5][1])] * 40
    target = ["the river clown 12", None, "É é", "river the the"]
    docs = spark.createDataFrame([(i, t, 1, "a") for i, t in rows], "doc_id long, text string, id int, score string").repartition(6)
    items = spark.createDataFrame([(t,) for t in target], "text string")
    out = importance.resampled(docs, items, percent=30, min_words=7)
    assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert got(out) == brute(rows, target, 30, 7)
    assert got(importance.resampled(docs, items, percent=100, min_words=0, buckets=97, ngrams=2, seed=7)) == brute(rows, target, 100, 0, 97, 2, 7)
    assert got(importance.resampled(docs, items.limit(0))) == brute(rows, [], 5, 20)
    assert importance.resampled(docs.limit(0), items).count() == 0


def test_query(spark):
    from corpusflow.llm.queries import op13_importance

    sf = "/root/testdata/sf0.001"
    read = lambda name, *columns: [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*columns).collect()]
    want = brute(read("documents", "doc_id", "text"), [t for (t,) in read("benchmark", "text")], 5, 20)
    out = op13_importance(spark, sf).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out) == Counter({(a, c, d, e, f): n for (a, _, c, d, e, f), n in want.items()})
    assert sum(r["rank"] is not None for r in out) > 5
