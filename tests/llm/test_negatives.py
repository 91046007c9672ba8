"""Strassen products, heaps and hard negatives against plain versions."""

import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from adspark.llm import negatives


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 70), st.integers(0, 70), st.integers(0, 70), st.integers(1, 9), st.integers(0, 2**32))
def test_product(n, k, m, leaf, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-2**27, 2**27, (n, k)), rng.integers(-2**27, 2**27, (k, m))
    assert (negatives.product(a, b, leaf) == a @ b).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(0, 30), st.integers(1, 6), st.integers(0, 2**32))
def test_best(rows, n, k, seed):
    rng = np.random.default_rng(seed)
    scores = rng.integers(-3, 4, (rows, n))
    scores[rng.random((rows, n)) < 0.4] = negatives.NOTHING
    ids = np.sort(rng.choice(1000, n, replace=False))
    got = list(zip(*(x.tolist() for x in negatives.best(scores, ids, k))))
    want = [(r, i, s) for r in range(rows)
            for s, i in sorted(((int(s), int(i)) for s, i in zip(scores[r], ids) if s != negatives.NOTHING), key=lambda x: (-x[0], x[1]))[:k]]
    assert got == want


def brute(rows, positives=5, negatives_=5):
    part = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        if sum(x * x for x in q) < 2**55:
            part[i] = min(part.get(i, (label, q)), (label, q))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, v) in part.items():
        if a % 100:
            continue
        ranked = sorted((-dot(v, q), i) for i, (_, q) in part.items() if i != a)
        for p, pid in [(-s, i) for s, i in ranked if part[i][0] == label][:positives]:
            near = [(i, -s) for s, i in ranked if part[i][0] != label and 80 * p <= 100 * -s <= 100 * p]
            out += [(a, pid, r, i, p, s) for r, (i, s) in enumerate(near[:negatives_], 1)]
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("vector", F.lit("clash")).withColumn("x", F.lit(1))
    return sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 100 == 0, **how).collect())


def test_equals_brute_force_in_many_blocks(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0.3, 1) for _ in range(11)], rng.randrange(4)) for i in range(-200, 900)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    want = brute(rows)
    assert len(want) > 150 and mined(spark, rows) == want
    assert mined(spark, rows, anchor_values=60, candidate_values=2000) == want


def test_ties_copies_and_odd_rows(spark):
    same = [0.5, 0.25, -0.125]
    rows = [(i, same, i % 3) for i in range(0, 400)]  # every score ties
    rows += rows[:50]
    rows += [(1000, None, 1), (1100, [0.1, None, 0.2], 1), (1200, [float("nan"), 0.0, 0.0], 1), (1300, [float("-inf"), 0.0, 0.0], 2), (None, same, 1),
             (1400, same, None), (1500, [], 1), (1600, [0.5], 1), (1700, same + [9.0], 2), (1800, [3e38, 3e38, 3e38], 1), (100, [0.75, 0.25, 0.0], 0)]
    want = brute(rows)
    assert want and mined(spark, rows) == want
    assert mined(spark, rows, candidate_values=90, anchor_values=9) == want


def test_nothing_to_mine(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []  # no anchor
    assert mined(spark, [(100, [1.0], 0), (200, [1.0], 0), (1, [1.0], 0)]) == []  # one label
    assert mined(spark, [(100, [1.0], 0), (1, [1.0], 1)]) == []  # no positive


def test_one_hot_label(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(0.2, 1, (1500, 6)).astype(np.float32)
    rows = [(i, [float(x) for x in v[i]], 0 if i % 10 else i % 3) for i in range(1500)]
    assert mined(spark, rows, candidate_values=1200) == brute(rows)
