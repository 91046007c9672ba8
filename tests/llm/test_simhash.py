"""SimHash classes against all pairs."""

import random

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

from adspark.llm import graph, queries, simhash

DIR = "/root/testdata/sf0.001"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def expected(docs):
    fps = [brute.simhash(t) for _, t in docs]
    root = brute.classes(fps)
    low = {}
    for (d, _), r in zip(docs, root):
        if d is not None:
            low[r] = min(low.get(r, d), d)
    return [(d, f"{f:016x}", low.get(r)) for (d, _), f, r in zip(docs, fps, root)]


def test_query_equals_all_pairs(spark):
    docs = duckdb.sql(f"select doc_id, text from '{DIR}/documents.parquet'").fetchall()
    got = sorted(tuple(r) for r in queries.QUERIES["op8_simhash"](spark, DIR).collect())
    assert got == sorted(expected(docs))
    assert any(d != c for d, _, c in got)


def test_edges(spark):
    rng = random.Random(3)
    base = [rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(400)]
    near = [" ".join(base[:i] + ["x"] + base[i + 1:]) for i in range(0, 400, 25)]
    docs = [(i + 10, t) for i, t in enumerate(near)] + [(1, None), (2, ""), (3, " \t"), (4, "one"), (5, "ONE two"), (6, "One  two"), (None, "one two"),
                                                       (None, None), (None, "solo null"), (7, "x " * 50_000), (7, "same id, other text"), (7, "x " * 50_000)]
    df = spark.createDataFrame([(*d, 1, None) for d in docs], "doc_id long, text string, fp int, component string")
    found = simhash.classes(df).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()
    assert sorted(map(tuple, found), key=str) == sorted(expected(docs), key=str)
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    rows, n_classes = kept.collect(), len(set(brute.classes([brute.simhash(t) for _, t in docs])))
    assert len(rows) == n_classes
    assert {r.doc_id for r in rows} >= {1, 4, 5, 7, 10}
    assert simhash.classes(df.limit(0)).count() == 0 and simhash.keep_first(df.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [3, 2048])
def test_links_connect_exactly(spark, chunk):
    """Clusters of close fingerprints, with chunks small enough that keys are split."""
    rng = random.Random(5)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    edges = simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), chunk=chunk).collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 64 for r in edges)
    at = {signed(x): i for i, x in enumerate(fps)}
    groups = graph.components(spark.createDataFrame([(at[r.a], at[r.b]) for r in edges], "a long, b long")).collect()
    root = {r.node: r.root for r in groups}
    assert [root.get(i, i) for i in range(len(fps))] == brute.classes(fps)


def test_components(spark):
    path = [(i, i + 1) for i in range(200)] + [(500, 500), (1000, 999), (1001, 999), (1001, 1000)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 999: 999, 1000: 999, 1001: 999}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sub_blocks_cover_the_other_bits():
    """Two fingerprints within the distance that share a choice of blocks agree on one of its sub-blocks."""
    masks = simhash._block_masks(3)
    assert len(masks) == 20
    rng = random.Random(2)
    for mask, rest in masks:
        parts = [m % (1 << 64) for m in (mask, *rest)]
        assert len(rest) == 4 and sum(parts) == 2**64 - 1 and all(a & b == 0 for i, a in enumerate(parts) for b in parts[:i])
        free = [b for b in range(64) if not parts[0] >> b & 1]
        for _ in range(50):
            flip = sum(1 << b for b in rng.sample(free, 3))
            assert any(flip & m == 0 for m in parts[1:])


def test_a_key_with_very_many_fingerprints(spark):
    """200,000 fingerprints that share three blocks: links equal brute force on a sample of them."""
    import numpy as np
    rng = np.random.default_rng(1)
    shared = simhash._block_masks(3)[0][0] % (1 << 64)
    fps = np.unique(rng.integers(0, 2**64, 200_000, dtype=np.uint64) & np.uint64(2**64 - 1 - shared) | np.uint64(0x5A5A5A5A5A5A5A5A & shared))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64).tolist()], "fp long").repartition(8)
    edges = simhash.links(df).collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 64 for r in edges)
    root = {r.node: r.root for r in graph.components(spark.createDataFrame([(r.a, r.b) for r in edges], "a long, b long")).collect()}
    of = lambda x: root.get(x, x)
    seen = 0
    for x in rng.choice(fps, 150):
        near = fps[np.bitwise_count(fps ^ x) <= 3].view(np.int64).tolist()
        assert {of(y) for y in near} == {of(int(np.int64(x.view(np.int64))))}
        seen += len(near) > 1
    assert seen > 20
