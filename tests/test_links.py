"""Components, clusters of work items and names in questions, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import graph, intel, retrieval


def brute_components(nodes, edges):
    least = {n: n for n in nodes} | {x: x for e in edges for x in e if None not in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a is not None and b is not None and least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return least


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(500 + i, 501 + i) for i in range(70)] + [(900, i) for i in range(901, 990)] + [(1, None), (None, None), (5, 5)]
    nodes = list(range(0, 310, 2))
    rnd.shuffle(edges)
    out = graph.components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in out.collect()} == brute_components([*nodes, 1], edges)
    none = graph.components(spark.createDataFrame([(3,), (None,)], "node long"), spark.createDataFrame([], "a long, b long"))
    assert [(r.node, r.component) for r in none.collect()] == [(3, 3)]


def test_linked_items(spark):
    rows = [
        (1, "p", "t1", [], ["Alpha"]), (2, "p", "t1", None, None), (3, "q", "t1", ["A-1"], ["alpha"]),
        (4, None, None, ["A-1", None], []), (5, "p", "", [""], ["ALPHA", "common"]), (6, "p", None, [], ["common"]),
        (7, "p", None, [], ["common", ""]), (8, "p", None, None, ["common"]), (9, None, "t9", [], []), (10, "", "t9", [], []),
    ]
    items = spark.createDataFrame(rows, "item_id long, project string, thread string, tickets array<string>, keywords array<string>")
    got = {r.item_id: r.cluster_id for r in intel.linked(items, rare=3).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 3: 3, 4: 3, 6: 6, 7: 7, 8: 8, 9: 9, 10: 9}
    assert {r.cluster_id for r in intel.linked(items, rare=4).where("item_id in (5, 6, 7, 8)").collect()} == {1}


def test_a_keyword_or_thread_of_half_the_items(spark):
    """Their links are as many as items, and a large thread is one cluster."""
    items = spark.range(20_000).select(F.col("id").alias("item_id"), F.lit("p").alias("project"), F.when(F.col("id") % 2 == 0, "hot").alias("thread"), F.array().cast("array<string>").alias("tickets"), F.array(F.lit("all"), F.concat(F.lit("w"), F.floor(F.col("id") / 5))).alias("keywords"))
    out = intel.linked(items, rare=4).groupBy("cluster_id").count().collect()
    assert sorted(r["count"] for r in out)[-1] == 10_000 and len(out) == 10_001


def brute_variants(query, names, limit=3):
    """By regular expressions, each name against the question."""
    found = {}
    edge = lambda x: r"(?<![A-Za-z0-9])" + re.escape(x) + r"(?![A-Za-z0-9])"
    for a, f in names:
        if re.search(edge(a), query):
            found.setdefault(re.sub(edge(a), lambda _, f=f: f, query), []).append((1, -len(a), a))
        if re.search(edge(f), query, re.IGNORECASE | re.ASCII):
            found.setdefault(re.sub(edge(f), lambda _, a=a: a, query, flags=re.IGNORECASE | re.ASCII), []).append((2, -len(f), a))
    found.setdefault(query, []).append((0, 0, ""))
    return [q for q, _ in sorted(((q, min(o)) for q, o in found.items()), key=lambda x: (x[1], x[0]))][:limit]


def test_variants(spark):
    names = [("AI", "Artificial Intelligence"), ("R&D", "Research and  Development"), ("C++", "see plus"), ("x.y", "dot name"), ("QA", "Quality-Assurance"), ("A", "Artificial"), ("N$1", r"back\slash"), ("UK", "United Kingdom"), ("!!", "bang")]
    asked = ["What is AI?", "ai and AIs", "artificial intelligence in the UK", "Research and Development", "research AND  development, R&D", "C++ or C", "x.y xay", "quality-assurance", "A", "", "N$1 x", r"the back\slash", "stop!! now", "É AI É"]
    many = [(f"Z{i}", f"name {i} of many") for i in range(20_000)]
    queries = spark.createDataFrame(list(enumerate([*asked, "Z77 and name 500 OF many"])), "query_id long, query string")
    out = retrieval.variants(queries, spark.createDataFrame([*names, *many, ("", "blank"), (None, "x"), ("y", None)], "acronym string, full_name string")).collect()
    got = {}
    for r in sorted(out, key=lambda r: r.variant_no):
        got.setdefault(r.query_id, []).append(r.query)
    assert got == {i: brute_variants(q, [*names, many[77], many[500]]) for i, q in enumerate([*asked, "Z77 and name 500 OF many"])}
    plan = retrieval.variants(queries, spark.createDataFrame(names, "acronym string, full_name string"))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
