"""The pipeline's stages against brute force on a small corpus, and the registered queries with SQL."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from corpusflow.llm.queries import ORACLE_SQL, QUERIES
from corpusflow.queries.compare import connect, difference
from tests.llm.test_text_operators import brute_components, brute_lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int"
SF = "/root/testdata/sf0.001"


def documents():
    rnd = random.Random(8)
    vocab = {"en": ["the", "house", "with", "garden", "and", "of", "river", "thing", "she"], "de": ["das", "haus", "mit", "garten", "und", "fluss", "sie", "ding", "schön"]}
    rows = []
    for i in range(90):
        l = rnd.choice(["en", "de"])
        lines = [" ".join(rnd.choice(vocab[l]) + str(rnd.randint(0, 30)) for _ in range(rnd.randint(3, 30))) for _ in range(rnd.randint(1, 4))]
        if i % 4 == 0:
            lines.insert(0, "Share this PAGE ")
        rows.append((i, "\n".join(lines), l, f"s{i % 3}", 0, 1))
    rows += [(100 + i, rows[i][1], "en", "s0", 0, 1) for i in range(5)]
    rows += [(110, None, None, None, None, None), (111, "", "en", "s1", 0, 1), (112, "!!! 123", "en", "s1", 0, 1)]
    return rows


def test_stages(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    item = rows[7][1].split("\n")[-1]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == corpus_pipeline.COLUMNS
        kept.append(sorted(map(tuple, docs.select("doc_id", "text", "n_chars").collect())))
    after = [r for r in rows if r[0] < 110]
    assert [k[:2] for k in kept[0]] == sorted((r[0], r[1]) for r in after)
    lines = brute_lines([t for _, t, _ in kept[0]], 10)
    assert kept[1] == [(d, text, len(text)) for (d, _, _), (_, _, text) in zip(kept[0], lines, strict=True)]
    assert any(dropped for _, dropped, _ in lines)
    parent, _ = brute_components([t for _, t, _ in kept[1]], 5, 80)
    assert kept[2] == [k for i, k in enumerate(kept[1]) if parent[i] == i] and len(kept[2]) < len(kept[1])
    sh = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(len(w) - 4)}
    q = sh(item)
    assert kept[3] == [k for k in kept[2] if not q or len(q & sh(k[1])) < 0.8 * len(q)]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t, _ in kept[3]}
    got = Counter()
    for r in pieces:
        got[r.doc_id] += r.length
        assert r.doc_tokens == want[r.doc_id]
    assert got == Counter(want)


def test_stages_take_an_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_language_stage_without_labels(spark, tmp_path):
    stage = dict(corpus_pipeline.STAGES)["language"]
    assert stage(spark, spark.createDataFrame([], SCHEMA), str(tmp_path)).count() == 0
    rows = [(1, "the house", None, "s", 9, 1), (2, "12 !", None, "s", 4, 1), (3, None, None, None, None, None)]
    assert [r.doc_id for r in stage(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()] == [1]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert difference(spark, connect(SF), name, QUERIES[name], ORACLE_SQL[name], SF) == ""


def test_line_dedup_as_sql_on_a_larger_table(spark):
    sf, name = "/root/testdata/sf0.01", "op2_line_dedup"
    assert difference(spark, connect(sf), name, QUERIES[name], ORACLE_SQL[name], sf) == ""


def test_language_on_held_out_documents(spark):
    """Over 98 % of labelled documents that the model was not fitted on."""
    from corpusflow.llm import language_id

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    model = language_id.fit_on(docs.where("doc_id % 2 = 0"), per_language=40)
    out = language_id.identify(docs.where("doc_id % 2 = 1"), model, host="source").collect()
    assert np.mean([r.lang == r.lang_id for r in out]) > 0.98 and np.mean([r.lang_accepted for r in out]) > 0.99


def test_near_copies_keep_one_of_repeated_rows(spark, tmp_path):
    """Repeated rows, one id with two texts, and groups without ids: one row of each group stays."""
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "red blue green grey black white"
    rows = [(1, a), (1, a), (2, a), (3, b), (3, b + " "), (None, b), (None, c), (None, c), (5, "short"), (5, "short"), (6, None), (6, None), (7, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0, 1) for d, t in rows], SCHEMA)
    kept = Counter((r.doc_id, (r.text or "").strip()) for r in dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, str(tmp_path)).collect())
    assert kept == Counter({(1, a): 1, (3, b): 1, (None, c): 1, (5, "short"): 1, (6, ""): 2, (7, ""): 1})


def test_all_stages_take_an_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
