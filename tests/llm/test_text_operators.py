"""Line dedup, near dedup, decontamination, language ID, licence scan on small fixtures, against brute force."""

import math
import random
import textwrap
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import decontam, language_id, license_scan, line_dedup, minhash

DOCS = "doc_id long, text string, extra string, n int"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# --- line dedup ---


def brute_lines(texts, min_docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    counts = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and counts[key(x)] >= min_docs)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_line_dedup(spark, broadcast_rows):
    rnd = random.Random(5)
    common = ["  Menu ", "MENU\r", "menu", "É", "é", "", "   ", "Home\t", "x" * 5000]
    texts = ["\n".join(rnd.choice([*common, f"own {i} {j}"]) for j in range(rnd.randint(1, 9))) for i in range(60)] + [None, "", "menu", "menu"]
    docs = spark.createDataFrame([(i % 50, t, "e", 1) for i, t in enumerate(texts)], DOCS).repartition(5)
    out = line_dedup.dedup_lines(docs, min_docs=4, null_as_empty=True, broadcast_rows=broadcast_rows)
    assert out.columns == ["doc_id", "text", "extra", "n", "n_lines", "n_dropped"]
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect())
    assert got == Counter((i % 50, *x) for i, x in enumerate(brute_lines(texts, 4)))


def test_line_dedup_edges(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0
    kept = line_dedup.dedup_lines(spark.createDataFrame([(None, None, None, None)], DOCS)).collect()
    assert kept[0].text is None and kept[0].n_lines == 1
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, n_lines long"))


def test_line_runs_levels(spark):
    runs = line_dedup.LineRuns(spark, min_docs=99, fan_out=2)
    for _ in range(5):
        runs.add(spark.createDataFrame([(b"a",), (b"b",)], "h binary"))
    assert [len(level) for level in runs.seen.levels] == [1, 0, 1]
    assert sorted((bytes(r.h), r.n) for r in runs.counts().collect()) == [(b"a", 5), (b"b", 5)]
    assert runs.frequent().count() == 0


def test_line_runs_frequent_over_batches(spark):
    """No hash stands twice in a run, whatever the number of merges, and a key of several batches is found."""
    runs = line_dedup.LineRuns(spark, min_docs=4, fan_out=2, buckets=2)
    rnd, total = random.Random(1), Counter()
    for _ in range(4):
        batch = [rnd.randrange(400).to_bytes(2, "big") for _ in range(300)]
        total.update(batch)
        runs.add(spark.createDataFrame([(h,) for h in batch], "h binary"))
    found = [bytes(r.h) for r in runs.frequent().collect()]
    assert len(found) == len(set(found)) and set(found) == {h for h, n in total.items() if n >= 4}
    counted = [bytes(r.h) for r in runs.counts().collect()]
    assert len(counted) == len(set(counted)) and set(counted) == set(total)


def test_line_runs_merge_without_shuffle(spark):
    runs = line_dedup.LineRuns(spark, min_docs=99, fan_out=9)
    for i in range(2):
        runs.add(spark.createDataFrame([(bytes([j, i]),) for j in range(200)], "h binary"))
    with line_dedup.sorted_runs(spark):
        merged = line_dedup.merge_of(*runs.seen.runs)
        merged.collect()
        plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan, plan


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_line_dedup_over_batches(spark, broadcast_rows):
    """40 lines that 10 of 400 documents each hold, one copy a batch or more: all 400 go; a very long text stays whole."""
    texts = [f"shared {i % 40}\nown {i}" for i in range(400)] + ["long " * 400_000 + "\nshared 3", "shared 41\nshared 41"]
    docs = spark.createDataFrame([(i, t, "x", b"y") for i, t in enumerate(texts)], "doc_id long, text string, text_hash string, Own_Lines binary").repartition(3)
    out = line_dedup.dedup_lines(docs, min_docs=10, broadcast_rows=broadcast_rows)
    assert out.columns == ["doc_id", "text", "text_hash", "Own_Lines", "n_lines", "n_dropped"]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in out.collect()}
    assert got == dict(enumerate(brute_lines(texts, 10))) and sum(x[1] for x in got.values()) == 401


# --- near dedup ---


def brute_components(texts, words, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def corpus(seed=3, n=120):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rnd.choice(vocab) for _ in range(rnd.randint(5, 120))] for _ in range(12)]
    texts = []
    for i in range(n):
        t = list(rnd.choice(base)) if i % 3 else [rnd.choice(vocab) for _ in range(rnd.randint(1, 60))]
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):
            t[rnd.randrange(len(t))] = rnd.choice(vocab)
        texts.append(" ".join(t))
    return [*texts, None, "", " \n", "a b", "A  B", "a b c", "word " * 3000]


@pytest.mark.parametrize("bucket", [1, 50])
def test_near_duplicates(spark, bucket, monkeypatch):
    monkeypatch.setattr(minhash, "BUCKET", bucket)
    monkeypatch.setattr(minhash, "CELL", 3)
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "e", 1) for i, t in enumerate(texts)], DOCS).repartition(4)
    got = {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in minhash.near_duplicates(docs, words=4, percent=80).collect()}
    parent, sizes = brute_components(texts, 4, 80)
    assert got == {i: (p, n, p == i) for i, (p, n) in enumerate(zip(parent, sizes, strict=True))}


def test_near_duplicates_edges(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e", "", 0), (None, "a b c d e", "", 0), (7, "a b c d e", "", 0), (7, "a b c d e", "", 0), (9, "a b c d e f", "", 0)], DOCS)
    got = Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == Counter({(None, 7, False): 2, (7, 7, True): 2, (9, 9, True): 1})


def test_min_and_max_estimate_jaccard():
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = minhash.signature(np.unique(x[:2000])), minhash.signature(np.unique(x[1000:]))
    both = np.concatenate([a[0] == b[0], a[1] == b[1]])
    assert abs(both.mean() - 1 / 3) < 0.15


def test_components(spark):
    from corpusflow.llm.shared import Scratch

    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (7, 7)]
    got = dict(rows_of(minhash.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"))))
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 103: 100}


# --- decontamination ---


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_contained_items(spark, broadcast_rows):
    rnd = random.Random(2)
    vocab = [f"v{i}" for i in range(3000)]
    items = [[rnd.choice(vocab) for _ in range(n)] for n in (4, 5, 6, 12, 30, 80)] + [["q"] * 9]
    docs = []
    for i in range(80):
        t = [rnd.choice(vocab) for _ in range(rnd.randint(0, 400))]
        if i % 2:
            part = list(rnd.choice(items))
            for _ in range(rnd.choice([0, 0, 1, 2])):
                part[rnd.randrange(len(part))] = "zz"
            at = rnd.randint(0, len(t))
            t = t[:at] + part + t[at:]
        docs.append(" ".join(t).upper() if i % 5 == 0 else "\n".join(t))
    docs += [None, "", "q q q q q"]
    sh = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(len(w) - 4)}
    want = {(i, j) for i, d in enumerate(docs) for j, it in enumerate(items) if (q := sh(" ".join(it))) and len(q & sh(d)) >= 0.8 * len(q)}
    d = spark.createDataFrame([(i, t, "e", 1) for i, t in enumerate(docs)] + [(None, " ".join(items[3]), "", 0), (1, docs[1], "", 0)], DOCS)
    b = spark.createDataFrame([(j, " ".join(it), 3) for j, it in enumerate(items)] + [(3, " ".join(items[3]), 3), (None, "a b c d e", 1), (8, None, 1)], "item_id long, text string, doc_id int")
    got = decontam.contained_items(d, b, broadcast_rows=broadcast_rows).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert decontam.without_items(d, b).where("doc_id is null").count() == 1


def test_contained_items_empty(spark):
    d, b = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert decontam.contained_items(d, b).count() == 0
    assert decontam.contained_items(spark.createDataFrame([(1, "a b c d e f", "", 0)], DOCS), b).count() == 0


# --- language ID ---

SENTENCES = {"en": "the quick brown fox jumps over the lazy dog and then sleeps in the sun", "de": "der schnelle braune fuchs springt ueber den faulen hund und schlaeft dann", "fr": "le renard brun rapide saute par dessus le chien paresseux et dort ensuite"}


def test_language_evidence():
    model = language_id.fit([(t, l) for l, t in SENTENCES.items() for _ in range(3)])
    even = np.zeros(3)
    for l, t in SENTENCES.items():
        assert language_id.posterior(model, t.encode(), None, None, even)[::2] == (l, True)
    assert language_id.posterior(model, b"", "fr", None, even)[0] == "fr"
    assert language_id.posterior(model, None, None, "de", even) [::2] == ("de", False)
    assert language_id.posterior(model, b'<html lang="de-AT">x', None, None, even)[0] == "de"
    assert not language_id.posterior(model, b"1234567890 !!! ### $$$", None, None, even)[2]
    prior = np.log([0.1, 0.1, 0.8])
    assert language_id.posterior(model, b"", None, None, prior)[0] == "fr"


def test_language_held_out(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(240):
        l = rnd.choice(list(SENTENCES))
        words = SENTENCES[l].split()
        rows.append((i, " ".join(rnd.choice(words) for _ in range(12)), l, f"http://a.example.{l}/x", f"h{i % 4}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, url string, host string")
    model = language_id.fit_on(docs.where("doc_id < 120"), per_language=30)
    out = language_id.identify(docs, model, host="host", url="url").where("doc_id >= 120").collect()
    assert sum(r.lang == r.lang_id for r in out) >= 0.98 * len(out) and all(r.lang_accepted for r in out)
    joined = language_id.identify(docs, model, url="url", broadcast_rows=0).select("doc_id", "lang_id")
    assert joined.count() == 240


def test_language_edges(spark):
    model = language_id.fit([(t, l) for l, t in SENTENCES.items()])
    docs = spark.createDataFrame([(1, None, None, None), (2, "", "h", None), (3, "the dog", None, None)], "doc_id long, text string, source string, n int")
    got = {r.doc_id: r.lang_accepted for r in language_id.identify(docs, model, host="source").collect()}
    assert got == {1: False, 2: False, 3: True}
    assert language_id.identify(docs.limit(0), model, host="source").count() == 0
    with pytest.raises(ValueError):
        language_id.fit_on(spark.createDataFrame([], "text string, lang string"))
    with pytest.raises(ValueError):
        language_id.identify(docs.withColumnRenamed("n", "lang_id"), model)


def test_language_fit_of_many_copies(spark, monkeypatch):
    """Each language is fitted on its distinct texts, however many copies they have and wherever their hashes lie."""
    fitted = []
    monkeypatch.setattr(language_id, "fit", fitted.append)
    few = spark.range(16000).selectExpr("concat('la casa del rio ', id % 5) as text", "'es' as lang")
    many = spark.range(3000).selectExpr("concat('the house by the river ', id) as text", "'en' as lang")
    copies = spark.range(4000).selectExpr("'the house by the river 7' as text", "'en' as lang")
    language_id.fit_on(few.union(many).union(copies))
    rows = fitted[0]
    assert Counter(l for _, l in rows) == {"es": 5, "en": 400} and len(set(rows)) == 405
    by_hash = [r.text for r in many.orderBy(F.xxhash64("text")).limit(400).collect()]
    assert {t for t, l in rows if l == "en"} == set(by_hash)
    with pytest.raises(ValueError):
        language_id.fit_on(few.union(many), max_languages=1)


def test_language_accepted_by_all_evidence(spark):
    """und is a class: what speaks for or against a language changes the decision where the text leaves it open."""
    model = language_id.fit([(t, l) for l, t in SENTENCES.items()])
    accepted = lambda text, said, prior: language_id.posterior(model, text, said, None, np.log(prior))[2]
    assert accepted(b"the dog", None, [0.25] * 4) and not accepted(b"the dog", None, [1e-30] * 3 + [1.0])
    assert not accepted(b"ab", None, [0.2, 0.2, 0.2, 0.4]) and accepted(b"ab", "fr", [0.2, 0.2, 0.2, 0.4])


def test_language_of_pages(spark):
    from corpusflow.llm.queries import op3_language_id

    sf = "/root/testdata/sf0.001"
    out = op3_language_id(spark, sf).collect()
    docs, pages = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/pages.parquet")
    assert Counter(r.doc_id for r in out if r.page_id is None) == Counter(r.doc_id for r in docs.collect())
    got = {r.page_id: r.lang_id for r in out if r.page_id is not None}
    assert set(got) == {r.page_id for r in pages.collect()}
    fitted = {r.lang for r in docs.collect()}
    said = {r.page_id: r.l for r in pages.select("page_id", F.regexp_extract("html", "lang=\"?([a-z]{2})", 1).alias("l")).collect() if r.l in fitted}
    assert said and np.mean([got[i] == l for i, l in said.items()]) > 0.9


# --- licence scan ---


def test_license_scan(spark):
    mit = license_scan.TEMPLATES["MIT"][1]
    files = [
        (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0.", 0),
        (2, "a/b/c.py", "print(1)\n" * 400, 0),
        (3, "a/b/COPYING.txt", mit, 0),
        (4, "a/x/y.py", "# Licensed under CC BY-NC 4.0.\ncode " + "word " * 200, 0),
        (5, "z/q.py", None, 0),
        (6, None, "", 0),
        (7, "a/x/z.py", "a driving license is not one of ours", 0),
        (7, "a/x/z.py", "a driving license is not one of ours", 0),
        (8, "top.py", "This work is licensed under the GNU General Public License, version 3.", 0),
    ]
    out = Counter((r.doc_id, r.license, r.basis) for r in license_scan.scan(spark.createDataFrame(files, "doc_id long, path string, text string, score int")).collect())
    assert out == Counter({(1, "Apache-2.0", "file"): 1, (2, "MIT", "inherited"): 1, (3, "MIT", "file"): 1, (4, "CC-BY-NC-4.0", "header"): 1, (5, None, None): 1, (6, None, None): 1, (7, "Apache-2.0", "inherited"): 2, (8, "GPL-3.0", "header"): 1})
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0


def test_license_of_wrapped_notices(spark):
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    lgpl = "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    bsd, mit = license_scan.TEMPLATES["BSD-3-Clause"][0] + ":", license_scan.TEMPLATES["MIT"][1]
    code = "\n#\nimport os\n\n\ndef run():\n    return os.name\n" + "value = run()\n" * 20
    header = lambda t: "\n".join("# " + x for x in textwrap.wrap(t, 60)) + code
    files = [(i, f"{i}/a.py", header(t)) for i, t in enumerate([gpl, lgpl, bsd, mit])] + [(4, "4/terms.txt", textwrap.fill(license_scan.TEMPLATES["AGPL-3.0"][0], 50)), (5, "4/b.py", code), (6, "6/n.txt", "wool shed river moon\n" * 9 + "Released under the MIT License."), (7, "6/c.py", code)]
    out = {r.doc_id: (r.license, r.basis, r.score) for r in license_scan.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert [out[i][:2] for i in range(4)] == [(l, "header") for l in ("GPL-2.0", "LGPL-3.0", "BSD-3-Clause", "MIT")] and min(out[i][2] for i in range(4)) > 0.8
    assert out[4][:2] == ("AGPL-3.0", "file") and out[5][:2] == ("AGPL-3.0", "inherited") and out[4][2] > 0.9
    assert out[6] == ("MIT", "header", 1.0) and out[7] == (None, None, None)


def test_language_priors_and_posteriors_equal_brute_force(spark):
    """Host, domain and corpus counts without the row's own class, and the fused posterior, row by row."""
    rnd = random.Random(6)
    model = language_id.fit([(t, l) for l, t in SENTENCES.items()])
    names = [*model.languages, "und"]
    hosts = ["a.x.org", "b.x.org", "c.y.de", "lone", None]  # and one without letters
    rows = []
    for i in range(120):
        words = SENTENCES[rnd.choice(list(SENTENCES))].split()
        text = rnd.choice([" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 9))), None, "", "12 - 3", "zq xj"])
        rows.append((i % 90, text, rnd.choice(hosts[:1] * 4 + hosts), rnd.choice([None, "de", "FR", "xx"]), rnd.choice([None, "http://q.fr/1", "not an address"])))
    rows.append((200, "1 2", "d.x.org", None, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, said string, url string")
    own = [language_id.likelihood(model, t.encode() if t is not None else None, said, "fr" if url == "http://q.fr/1" else None) for _, t, _, said, url in rows]
    domain = lambda h: ".".join(h.split(".")[-2:]) if h and "." in h else None

    def share(of, i, above):
        counts = np.zeros(len(names))
        for j in of:
            if j != i and own[j][1] is not None:
                counts[own[j][1]] += 1
        return (counts + 1) / (counts.sum() + len(names)) if above is None else (counts + 20 * above) / (counts.sum() + 20)

    want = Counter()
    for i, r in enumerate(rows):
        p = share(range(len(rows)), i, None)
        if domain(r[2]):
            p = share([j for j, x in enumerate(rows) if domain(x[2]) == domain(r[2])], i, p)
        p = share([j for j, x in enumerate(rows) if (x[2] or "") == (r[2] or "")], i, p)
        lang, post, ok = language_id.posterior(model, r[1].encode() if r[1] is not None else None, r[3], "fr" if r[4] == "http://q.fr/1" else None, np.log(p))
        want[(r[0], lang, round(post, 6), ok)] += 1
    out = language_id.identify(docs, model, host="host", url="url", declared="said", keep=["doc_id"])
    assert out.columns == ["doc_id", "lang_id", "lang_posterior", "lang_accepted"]
    assert Counter((r.doc_id, r.lang_id, r.lang_posterior, r.lang_accepted) for r in out.collect()) == want


def test_language_of_one_very_long_text(spark):
    model = language_id.fit([(t, l) for l, t in SENTENCES.items()])
    docs = spark.createDataFrame([(1, (SENTENCES["fr"] + " ") * 100_000, 5), (2, SENTENCES["de"], 5), (2, SENTENCES["de"], 5)], "doc_id long, text string, score int")
    assert sorted((r.doc_id, r.lang_id, r.score) for r in language_id.identify(docs, model).collect()) == [(1, "fr", 5), (2, "de", 5), (2, "de", 5)]


# --- licence scan, brute force ---


def slow_license(texts, threshold=0.6):
    """(licence, score) a text: every template over every place where a pair with a trigger meets, in plain Python."""
    words = lambda t: "".join(c if c.isascii() and c.isalnum() else " " for c in (t or "").lower()).split()
    terms = lambda ws: Counter(ws) + Counter(zip(ws, ws[1:], strict=False))
    templates = [(l, [w.decode() for w in ws]) for l, ws, _ in license_scan.LIST]
    known = {t for _, ws in templates for t in terms(ws)}
    texts = [words(t) for t in texts]
    df = Counter(t for ws in texts for t in set(terms(ws)) & known)
    idf = lambda t: np.log((1 + len(texts)) / (1 + (df[t] if t in known else min(1, len(texts))))) + 1
    out = []
    for ws in texts:
        best = (None, 0.0)
        for l, ts in templates:
            target = {t: n * idf(t) for t, n in terms(ts).items()}
            size = np.sqrt(sum(x * x for x in target.values()))
            for i in range(len(ws) - 1):
                for o in range(len(ts) - 1):
                    if ws[i : i + 2] == ts[o : o + 2] and license_scan.TRIGGERS & set(ts[o : o + 2]):
                        part = terms(ws[max(0, i - o) : max(0, i - o + len(ts))])
                        dot = sum(n * idf(t) * target.get(t, 0) for t, n in part.items())
                        # a term outside the templates is one of its own each time
                        norm = np.sqrt(sum((n * idf(t)) ** 2 if t in known else n * idf(t) ** 2 for t, n in part.items()))
                        cos = round(dot / norm / size, 6)
                        if cos > best[1] + 1e-7:
                            best = (l, cos)
        out.append(best if best[1] >= threshold else (None, None))
    return out


def test_license_scan_equals_brute_force(spark):
    rnd = random.Random(9)
    texts = [None, "", "the public licensed the work under version control", "license", "a driving license"]
    for _ in range(45):
        l, ws, _ = rnd.choice(license_scan.LIST)
        ws = [w.decode() for w in ws]
        for _ in range(rnd.choice([0, 0, 1, 3])):
            ws[rnd.randrange(len(ws))] = rnd.choice(["foo", "the", "license", "bar"])
        noise = lambda: " ".join(rnd.choice(["code", "value", "the", "software", "x1"]) for _ in range(rnd.randint(0, 30)))
        texts.append(textwrap.fill(f"{noise()} {' '.join(ws)} {noise()}", rnd.choice([30, 70, 1000])))
    files = spark.createDataFrame([(i, f"d{i}/f.py", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.score) for r in license_scan.scan(files.repartition(3)).collect()}
    want = slow_license(texts)
    for i, (l, score) in enumerate(want):
        assert got[i][0] == l and (l is None or abs(got[i][1] - score) < 2e-6), (i, got[i], want[i], texts[i])
    assert got[2] == (None, None) and got[3] == (None, None)


def test_license_ties_long_texts_and_whole_licences(spark):
    mit = "MIT License\n\nCopyright (c) 2020 Some Body\n\n" + textwrap.fill(license_scan.TEMPLATES["MIT"][0], 70)
    mpl = textwrap.fill(license_scan.TEMPLATES["MPL-2.0"][0], 60)
    long_ = "word " * 400_000 + "released under the ISC License " + "word " * 1000
    files = [(1, "a/terms", mit), (2, "a/x/y.c", "int main;"), (3, "b/terms", mpl), (4, "b/c/d/e.c", None), (5, "c/big.c", long_), (6, "e/LICENCE.md", "Released under the MIT License"), (7, "e/LICENSE", "Released under the ISC License"), (8, "e/f.c", "x"), (8, "e/f.c", "x")]
    out = Counter((r.doc_id, r.license, r.basis) for r in license_scan.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect())
    assert {(1, "MIT", "file"), (2, "MIT", "inherited"), (3, "MPL-2.0", "file"), (4, "MPL-2.0", "inherited"), (5, "ISC", "header"), (6, "MIT", "file"), (7, "ISC", "file")} <= set(out)
    assert out[(8, "ISC", "inherited")] == 2


# --- near dedup in large buckets ---


def test_near_duplicates_in_large_buckets(spark):
    """Hundreds of texts share a long passage, so they share buckets without being copies; near copies are among them."""
    rnd = random.Random(12)
    vocab = [f"t{i}" for i in range(5000)]
    passage = [rnd.choice(vocab) for _ in range(70)]
    texts = []
    for i in range(450):
        own = [rnd.choice(vocab) for _ in range(rnd.choice([4, 8, 12, 20]))]
        t = passage + own if i % 2 else own + passage
        texts.append(" ".join(t))
        if i % 9 == 0:
            t[rnd.randrange(len(t))] = "other"
            texts.append(" ".join(t))
    docs = spark.createDataFrame([(i, t, "e", 1) for i, t in enumerate(texts)], DOCS).repartition(4)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, words=4, percent=80).collect()}
    parent, _ = brute_components(texts, 4, 80)
    assert got == dict(enumerate(parent))


def generated(df):
    """Rows that the Generate nodes of a collected DataFrame made."""
    out, open_ = 0, [df._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            open_.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            open_.append(node.plan())
        else:
            if kind == "GenerateExec":
                out += node.metrics().apply("numOutputRows").value()
            open_ += [node.children().apply(i) for i in range(node.children().size())]
    return out


@pytest.mark.parametrize("sets", [60, 240])
def test_pairs_by_rarest_of_one_large_group(spark, sets, monkeypatch):
    """Sets that share half of their shingles: the pairs are exact, and copies of entries grow by less than the square."""
    monkeypatch.setattr(minhash, "CELL", 4)
    rnd = random.Random(sets)
    shared, found = list(range(1, 41)), []
    for i in range(sets):
        own = found[-1] if i % 10 == 9 else set(shared) | {1000 * (i + 1) + j for j in range(rnd.randint(0, 12))}
        found.append((own | {1000 * (i + 1) + 500}) if i % 10 == 9 else own)
    nodes = spark.createDataFrame([(i, len(s), i) for i, s in enumerate(found)], "uid long, n long, label long")
    held = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(found)], "uid long, sh array<long>")
    out = minhash._by_rarest(nodes, held, minhash.Scratch(spark, "test"), 80)
    got = {(r.a, r.b) for r in out.collect()}
    similar = {(a, b) for b in range(sets) for a in range(b) if 100 * len(found[a] & found[b]) >= 80 * len(found[a] | found[b])}
    assert similar and similar <= got
    # a copy a cell of a row or column; a copy of each entry a cell made 2265 and 28925
    assert sets < generated(out) <= 5 * sets * math.ceil((sets / 4) ** 0.5)


def test_contained_items_of_one_page_with_all(spark):
    """A page that lists hundreds of items, one very long text, and repeated rows."""
    items = [(i, f"item number {i} asks what {i} and {i + 1} make together", 0) for i in range(300)]
    page = "\n".join(t for _, t, _ in items)
    docs = [(1, page, "e", 1), (1, page, "e", 1), (2, "word " * 300_000 + items[7][1], "e", 1), (3, None, "e", 1)]
    got = decontam.contained_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string, q int"))
    pairs = Counter((r.doc_id, r.item_id) for r in got.collect())
    assert pairs == Counter([(1, i) for i in range(300)] + [(2, 7)])
