"""Hard negatives against all pairs."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label string, id int, q string, anchor_id long"


def brute(rows, positives=5, negatives=3, lowest=50, highest=95, scale=256, every=5):
    fine = [(i, [math.floor(scale * x) for x in v], l) for i, v, l in rows if i is not None and v is not None and l is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = Counter()
    for i, v, l in fine:
        if i % every:
            continue
        others = sorted((-dot(v, w), j, m) for j, w, m in fine if j != i)
        for s, p, _ in [x for x in others if x[2] == l][:positives]:
            within = [(n, j) for n, j, m in others if m != l and lowest * -s <= 100 * -n <= highest * -s]
            out.update((i, p, k + 1, j, -s, -n) for k, (n, j) in enumerate(within[:negatives]))
    return out


def frame(spark, rows, parts=3):
    np_rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l, 1, "x", 7) for i, v, l in rows]
    return spark.createDataFrame(np_rows, SCHEMA).repartition(parts), [(i, v, l) for i, v, l, *_ in np_rows]


def mine(df, every=5, **more):
    return Counter(tuple(r) for r in hard_negatives.mined(df, F.col("vec_id") % every == 0, **more).collect())


def clustered(n, dims, seed, spread=0.1, scale=1.0):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(6, dims))
    return [(i, (scale * (centres[i % 6] + spread * rnd.normal(size=dims))).tolist(), "ab"[int(rnd.integers(2))]) for i in range(n)]


@pytest.fixture
def small_groups(monkeypatch):
    for name, n in (("GROUP_ANCHORS", 6), ("BLOCK_ROWS", 40), ("SAMPLE", 24), ("BROADCAST_ROWS", 5)):
        monkeypatch.setattr(hard_negatives, name, n)


def test_same_as_all_pairs_over_many_groups(spark, small_groups):
    df, rows = frame(spark, clustered(240, 6, 1))
    want = brute(rows)
    assert len(want) > 300 and mine(df, pivots=8) == want


def test_odd_rows(spark, small_groups):
    rnd = random.Random(2)
    rows = [(i, [rnd.choice([-1, 0, 0.5, 1]) for _ in range(3)], rnd.choice("abc")) for i in range(90)]  # many ties
    rows += [rows[10]] * 4 + [(10, [1, 1, 1], "b"), (15, [], "a"), (20, [2.0], "a"), (25, [0.1] * 5, "c")]
    rows += [(30, None, "a"), (35, [1, None], "a"), (None, [1, 1, 1], "a"), (40, [1, 1, 1], None), (45, [float("nan"), 1, 1], "a"), (50, [float("inf"), 1, 1], "a"), (-5, [1, 1, 1], "a"), (200, [1, 1, 1], "alone")]
    df, rows = frame(spark, rows)
    assert mine(df, pivots=4) == brute(rows)
    assert mine(df, pivots=4, positives=2, negatives=9, lowest=-100, highest=100) == brute(rows, 2, 9, -100, 100)
    assert mine(df.limit(0)) == Counter() == mine(df.where("label is null"))


@pytest.mark.parametrize("scale", [1.0, 300.0, 5e5])
def test_exact_in_each_kind_of_number(spark, scale):
    df, rows = frame(spark, clustered(60, 4, 3, scale=scale))
    assert mine(df, pivots=3) == brute(rows)


def test_too_long_vectors(spark):
    df, _ = frame(spark, [(0, [1e9, 1.0], "a"), (1, [1.0, 1.0], "b")])
    with pytest.raises(ValueError):
        mine(df)


def test_bounds_hold_rows_back(spark, monkeypatch):
    """Of vectors in clusters, a row is copied to few of the groups."""
    monkeypatch.setattr(hard_negatives, "GROUP_ANCHORS", 8)
    unit = [(i, (np.array(v) / np.linalg.norm(v)).tolist(), l) for i, v, l in clustered(600, 8, 4, spread=0.02)]
    df, _ = frame(spark, unit)
    given = hard_negatives.whole_numbers(df, "vec_id", "embedding", "label", F.col("vec_id") % 5 == 0, 256)
    space = hard_negatives._space(given, 6)
    held = spark.sparkContext.broadcast(space)
    cells = hard_negatives.Scratch(spark, "t").table(hard_negatives._in_cells(given, held), "cells")
    anchors = hard_negatives.Scratch(spark, "t").table(hard_negatives._home(cells.where("anchor"), held, 5), "anchors")
    groups = anchors.join(hard_negatives._group_of(anchors, space.pivots), "home").withColumn("group", F.col("first") + F.pmod(F.xxhash64("row"), "parts").cast("int"))
    reach = hard_negatives._reach(groups, held)
    copies = cells.join(reach, "cell").where("r between low and high").count()
    n = groups.select("group").distinct().count()
    assert n >= 6 and copies < 0.4 * n * 600, copies / n / 600
