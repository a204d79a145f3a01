"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from corpusflow.llm import piece_bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as f:
        return piece_bpe.Model(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def lists(model, texts):
    data = [t.encode() for t in texts]
    ids, counts = model.encode(b"".join(data), np.cumsum([len(d) for d in data]))
    assert counts.sum() == len(ids)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])], ids, np.concatenate([[0], np.cumsum(counts)])


ALPHABETS = ["ab ", "aeinrst", "ha=-_*#. \n", "é漢字 か😀\x00▁", "abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/"]


@pytest.mark.parametrize("block", [1 << 21, 300])
def test_same_ids_and_texts_as_the_library(model, library, block, monkeypatch):
    monkeypatch.setattr(piece_bpe, "BLOCK_CHARS", block)
    rnd = random.Random(block)
    texts = ["", " ", "▁", "a▁b", "<s>", "<0x41>", "①ﬁ", "\n\n", "", *(" " * n for n in range(90)), *("x" + " " * n + "the" for n in range(90))]
    texts += ["".join(rnd.choice(a) for _ in range(rnd.randint(0, 90))) for a in ALPHABETS for _ in range(400)]
    texts += ["".join(rnd.choice(a) for _ in range(3000)) for a in ALPHABETS]
    got, ids, offsets = lists(model, texts)
    want = library.encode(texts)
    assert got == want
    assert model.decode(ids.astype(np.int64), offsets) == [library.decode(w) for w in want]


def test_very_long_texts(model, library):
    """A long run of spaces, of a letter, a text without spaces, and one of several blocks."""
    texts = [" " * 300_000, "a" * 300_000, "".join(random.Random(1).choice("abcxyz019") for _ in range(50_000)), "the cat  sat\n" * 200_000]
    assert lists(model, texts)[0] == library.encode(texts)


def test_decodes_any_ids(model, library):
    rnd = random.Random(3)
    rows = [[rnd.choice([0, 1, 2, rnd.randrange(3, 259), rnd.randrange(259, 32000), 28705, 260]) for _ in range(rnd.randint(0, 12))] for _ in range(3000)]
    flat = np.array([i for r in rows for i in r], np.int64)
    got = model.decode(flat, np.concatenate([[0], np.cumsum([len(r) for r in rows])]))
    assert got == [library.decode(r) for r in rows]
    with pytest.raises(ValueError):
        model.decode(np.array([32000]), np.array([0, 1]))


def test_columns(spark, library):
    texts = [None, "", "Hello  world", "Hello  world", "x" * 100_000]
    docs = spark.createDataFrame([(i % 2, t, [7], "z") for i, t in enumerate(texts)], "doc_id long, text string, symbols array<int>, word string").repartition(2)
    ids = piece_bpe.encoded(docs, PATH)
    out = piece_bpe.decoded(ids, PATH).collect()
    assert sorted((r.doc_id, r.text or "", r.ids or []) for r in out) == sorted((i % 2, t or "", library.encode(t or "")) for i, t in enumerate(texts))
    assert all(r.decoded == r.text and r.symbols == [7] and r.word == "z" for r in out) and sum(r.ids is None for r in out) == 1
    assert piece_bpe.decoded(piece_bpe.encoded(docs.limit(0), PATH), PATH).count() == 0
    with pytest.raises(ValueError):
        piece_bpe.encoded(docs.withColumnRenamed("word", "IDS"), PATH)
    with pytest.raises(ValueError):
        piece_bpe.encoded(docs, b"")


def test_query(spark, library):
    from corpusflow.llm.queries import op11_sentencepiece

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {i: (len(ids := library.encode(t)), sha(",".join(map(str, ids))), sha(library.decode(ids))) for i, t in texts.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op11_sentencepiece(spark, sf).collect()} == want
