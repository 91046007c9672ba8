"""Substring dedup against a plain index of all windows."""

import random

import brute
import duckdb
import numpy as np

from adspark.llm import queries, substring
from adspark.llm.text import WordHashes, stored
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.01"


def run(spark, docs, **how):
    df = spark.createDataFrame([(*d, 1, "") for d in docs], "doc_id long, text string, start int, spans string")
    return sorted((tuple(r) for r in substring.dedup(df, **how).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def test_query_equals_brute_force(spark):
    docs = duckdb.sql(f"select doc_id, text from '{DIR}/documents.parquet'").fetchall()
    got = sorted(tuple(r) for r in queries.QUERIES["op4_substring_dedup"](spark, DIR).collect())
    assert got == sorted(brute.substring(docs))
    assert any(r[2] for r in got)


def test_random_overlaps(spark):
    """Few different words, so that paths fork, repeat and overlap in many ways."""
    rng = random.Random(11)
    passages = [[rng.choice("abcdefg") for _ in range(rng.randint(8, 40))] for _ in range(8)]
    docs = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(0, 6)):
            w += rng.choice(passages) if rng.random() < 0.7 else [rng.choice("abxyz") for _ in range(rng.randint(1, 30))]
        docs.append((rng.randint(0, 50) - 10, (" " if i % 2 else "\n").join(w)))
    for window, anchor in ((12, 4), (20, 10), (5, 5)):
        assert run(spark, docs, window=window, anchor=anchor) == sorted(brute.substring(docs, window), key=str)


def test_edges(spark):
    body = [f"w{i}" for i in range(120)]
    docs = [(1, " ".join(body)), (2, " ".join(body)), (2, " ".join(body)), (3, "x " + "\t".join(body[10:60])), (4, " ".join(body[10:59])), (5, None), (6, ""),
            (None, " ".join(body)), (None, None), (7, "a " * 9000), (8, "a " * 70 + "b"), (9, "b " + "a " * 49), (10, " ".join(body[:70]) + " é " + " ".join(body[50:])),
            (0, "W0 " + " ".join(body[1:60]))]
    assert run(spark, docs) == sorted(brute.substring(docs), key=str)
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring.dedup(df).count() == 0
    kept = substring.dedup(spark.createDataFrame([(1, " a \n b ")], "doc_id long, text string")).first()
    assert kept.kept == "a b"


def test_paths_cover_every_window():
    rng = random.Random(2)
    lists = [[rng.choice("ab").encode() for _ in range(n)] for n in (0, 5, 49, 50, 51, 300)]
    d, start, n, _, _ = substring.paths_of(lists, WordHashes(), 50, 10)
    got = sorted((int(a), int(b) + i) for a, b, k in zip(d, start, n) for i in range(k))
    assert got == [(i, p) for i, w in enumerate(lists) for p in range(len(w) - 49)]
    assert int(np.max(n)) <= 41


def test_a_passage_in_many_documents(spark):
    """One passage in every document, each with its own surroundings: one anchor, many different paths."""
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(i, f"a{i} b{i} c{i} {passage} " + " ".join(f"z{i}_{k}" for k in range(i % 45))) for i in range(300)]
    got = run(spark, docs)
    assert got == sorted(brute.substring(docs), key=str)
    assert sum(r[2] for r in got) == 299 * 60


def test_repeated_rows_do_not_multiply_spans(spark):
    """Two texts that branch within a shared passage, each in many identical rows."""
    words = [f"w{i}" for i in range(100)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:70] + ["other"] * 60 + words[30:]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("text_hash", F.xxhash64("text"))
    once = {r.doc_id: sorted(map(tuple, r.spans)) for r in substring.repeated(df).collect()}
    many = df.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(2500)))).drop("k").repartition(8)
    rows = substring.repeated(many).collect()
    assert {r.doc_id: sorted(map(tuple, r.spans)) for r in rows} == once and len(rows) == len(once) == 1
    out = substring.dedup(many, with_text=False).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted(map(tuple, out)) == [(1, 100, 0, 2500), (2, 200, brute.substring(docs)[1][2], 2500)]


def test_a_shared_passage_is_compacted_to_one_path(spark):
    """Edges that always occur together become one path; a place where texts part ends it."""
    def edge(i):
        return dict(anchor=i, said=100 + i)
    place = [dict(doc_id=d, text_hash=7 * d, start=10 * i + d, n=10, **edge(i)) for d in (1, 2, 3) for i in range(37)]
    place += [dict(doc_id=4, text_hash=28, start=10 * i, n=10, **edge(i + 20)) for i in range(5)]  # a part of it, inside another text
    places = stored(spark.createDataFrame(place), "places")
    edges = stored(places.groupBy("anchor", "said").agg(F.min(F.struct("doc_id", "text_hash", "start")).alias("rep"), F.first("n").alias("n")), "edges-of-it")
    got = sorted((r.anchor, r.n, r.rep.doc_id, r.rep.start) for r in substring.compacted(places, edges).collect())
    assert got == [(0, 200, 1, 1), (20, 50, 1, 201), (25, 120, 1, 251)]


def test_spans_with_other_words_stay(spark):
    """A span goes only where its words have the digest of its source."""
    assert substring.digest([b"a", b"b"]) != substring.digest([b"ab"])
    body = " ".join(f"w{i}" for i in range(400))
    df = spark.createDataFrame([(1, body), (2, "x " + body)], "doc_id long, text string").withColumn("text_hash", F.xxhash64("text"))
    (row,) = substring.repeated(df).collect()
    assert row.doc_id == 2 and any(s.digest == substring.digest(f"x {body}".encode().split()[s.start:s.end]) for s in row.spans if s.digest)
