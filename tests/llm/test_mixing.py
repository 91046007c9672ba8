"""Targets, exact quotas, and what the mix takes."""

import numpy as np
import pytest
from brute import words
from pyspark.sql import functions as F

from adspark.llm import mixing, queries

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, size int, shard string"


def rows(spark):
    r = [(i, f"w{i} " * (i % 40 + 1), ("a", "b", "é", None)[i % 4], 0, None) for i in range(300)]
    r += [(1000, None, "a", 1, ""), (None, "x y z", "b", 1, ""), (None, "x y z", "b", 1, ""), (1001, "", "only empty", 1, ""), (5, "w5 again", "b", 1, "")]
    r += [(1002, "long " * 40_000, "huge", 1, ""), (1003, "tiny", "\U0001F600", None, None)]
    return spark.createDataFrame(r, SCHEMA)


def test_targets():
    assert mixing.targets([10, 10], [1, 1], 20) == [10, 10]
    assert mixing.targets([1, 10, 100], [5, 2, 1], 111) == [3.0, 30.0, 78.0]
    assert mixing.targets([0, 5], [5, 2], 5) == [0.0, 5.0] and mixing.targets([], [], 0) == []
    got = mixing.targets([7, 100, 3, 55], [5, 2, 1, 5], 165)
    assert sum(got) == pytest.approx(165) and all(g <= 3 * s for g, s in zip(got, [7, 100, 3, 55]))


def brute_targets(sizes, weights=(5, 2, 1), times=3):
    """By bisection on the words that one unit of weight gets: the largest shares that use up all words."""
    w, total = [weights[i % len(weights)] for i in range(len(sizes))], sum(sizes)
    lo, hi = 0.0, float(total) + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(times * s, x * mid) for s, x in zip(sizes, w)) < total else (lo, mid)
    return [min(times * s, x * hi) for s, x in zip(sizes, w)]


def test_targets_equal_brute_force():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 30):
        for _ in range(20):
            sizes = [int(x) for x in rng.integers(0, 1000, n) ** rng.integers(1, 3, n)]
            weights = [mixing.WEIGHTS[i % 3] for i in range(n)]
            assert mixing.targets(sizes, weights, sum(sizes)) == pytest.approx(brute_targets(sizes), abs=1e-3)


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1001])
def test_epochs_are_permutations(spark, n):
    rows = spark.range(n).select(F.col("id"), *[mixing._permuted(F.col("id"), F.lit(n).cast("long"), F.lit(e)).alias(f"e{e}") for e in range(3)]).orderBy("id").toPandas()
    for e in range(3):
        assert sorted(rows[f"e{e}"]) == list(range(n))
    if n > 60:  # not one order turned round: neighbours part ways, and epochs differ
        for e in range(3):
            steps = np.diff(rows[f"e{e}"].to_numpy()) % n
            assert len(set(steps.tolist())) > n / 3
        assert (rows.e0 == rows.e1).mean() < 0.1 and (rows.e1 == rows.e2).mean() < 0.1


def test_words_left_at_the_cut_go_to_later_documents(spark):
    """One document too long for what is left must not end the epoch while short ones remain."""
    r = [(i, "w " * 50, "a") for i in range(5000)] + [(10_000 + i, "v " * 50_000, "a") for i in range(4)]
    r += [(20_000, "u " * 960_000, "b")]
    docs = spark.createDataFrame(r, "doc_id long, text string, source string")
    target = 5 / 7 * 1_410_000  # 450,000 words in a (weight 5), 960,000 in b (weight 2)
    plan = mixing.mix(docs)
    taken = plan.draws.where("source = 'a'").agg(F.sum("size")).first()[0]
    assert plan.sources.where("source = 'a'").first().target == pytest.approx(target) and target - 50 < taken <= target


def test_tail_fills_in_order_and_rounds(spark, monkeypatch):
    """Greedy over all units in order, however few a round looks at."""
    rng = np.random.default_rng(4)
    units = [(no, int(rng.integers(0, 9)), i, i * 7, int(rng.integers(1, 60))) for no in range(3) for i in range(200)] + [(1, 3, None, 5, 7)]
    left = {0: 500, 1: 41, 2: 0}
    df = spark.createDataFrame(units, "no int, rank long, doc_id long, text_hash long, size long")
    lefts = spark.createDataFrame(list(left.items()), "no int, left long")
    hashes = {(r.no, r.doc_id, r.text_hash): r.h for r in df.select("*", F.xxhash64("doc_id", "text_hash", F.lit(mixing.SEED)).alias("h")).collect()}
    want = set()
    for no, rest in left.items():
        for u in sorted((u for u in units if u[0] == no), key=lambda u: (u[1], hashes[no, u[2], u[3]])):
            if u[4] <= rest:
                rest -= u[4]
                want.add((no, u[2], u[3]))
    for n in (8, 1):
        monkeypatch.setattr(mixing, "TAIL_BLOCKS", n)
        assert {tuple(r) for r in mixing._fitting(df, lefts).collect()} == want


def test_tree_splits_exactly():
    quotas = [13, 0, 5, 100, 1]
    parts = [mixing.split_quota(quotas, 7, i) for i in range(7)]
    assert np.array_equal(sum(p for p, _ in parts), quotas)
    for i in range(6):
        assert np.array_equal(parts[i][1] + parts[i][0], parts[i + 1][1])
    assert max(p.sum() for p, _ in parts) - min(p.sum() for p, _ in parts) <= 1


@pytest.mark.parametrize("block_words", [50, 1 << 16])
def test_mix(spark, block_words):
    docs = rows(spark)
    plan = mixing.mix(docs, block_words=block_words, shard_blocks=4)
    sources = plan.sources.toPandas()
    assert list(sources.source)[:-1] == sorted(sources.source[:-1]) and sources.source.iloc[-1] is None
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    assert dict(zip(sources.source, sources.source_size)) == sizes
    want = mixing.targets(list(sources.source_size), [mixing.WEIGHTS[i % 3] for i in range(len(sources))], sum(sizes.values()))
    assert list(sources.target) == want
    draws = plan.draws.toPandas()
    taken = draws.assign(source=draws.source.fillna("none")).groupby("source")["size"].sum()
    assert want == pytest.approx(brute_targets(list(sources.source_size)))
    smallest = {"a": 1, "b": 2, "é": 3, None: 4, "huge": 40_000, "only empty": 0, "\U0001F600": 1}
    for s, t in zip(sources.source, want):
        # What is missing is less than the smallest document that could still be drawn; never more than the target.
        assert t - max(40, smallest[s]) <= taken.get(s or "none", 0) <= t + 1
    per = draws[draws.doc_id.notna()].groupby(["doc_id", "text_hash"]).epoch
    assert per.nunique().equals(per.count()) and draws.epoch.max() <= 2
    again = mixing.mix(docs.repartition(5), block_words=block_words, shard_blocks=4).draws.toPandas()
    key = ["doc_id", "text_hash", "epoch", "shard", "place"]
    assert draws[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))


def test_blocks_are_disjoint(spark):
    """A block of a source goes to one shard per epoch, and shards have near equal numbers of blocks."""
    docs = rows(spark).where("source in ('a', 'b')")
    draws = mixing.mix(docs, block_words=50, block_docs=5, shard_blocks=4).draws.toPandas()
    assert draws.shard.nunique() > 5


def test_documents_of_the_mix(spark):
    docs = rows(spark)
    plan = mixing.mix(docs)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    total = plan.draws.agg({"size": "sum"}).first()[0]
    got = out.collect()
    assert sum(len(words(r.text)) for r in got) == total and len(got) == plan.draws.count()
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_query(spark):
    got = queries.QUERIES["op1_mix_sources"](spark, DIR).toPandas()
    assert len(got) == 200 and (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
