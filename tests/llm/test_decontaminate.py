"""Winnowing against a plain scan of all windows."""

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

from adspark.llm import decontaminate, queries

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, found string, spans int"
ITEMS = "item_id long, text string"


def rows(found):
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    got = found.select("row.doc_id", "n_words", decontaminate.n_hit(), F.size("items"), F.sha2(ids, 256), F.size("spans") > 0)
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_query_equals_brute_force(spark):
    con = duckdb.connect()
    docs = con.sql(f"select doc_id, text from '{DIR}/documents.parquet'").fetchall()
    items = con.sql(f"select item_id, text from '{DIR}/benchmark.parquet'").fetchall()
    got = sorted((tuple(r) for r in queries.QUERIES["op7_decontaminate"](spark, DIR).collect()), key=str)
    assert got == sorted(brute.overlaps(docs, items), key=str)
    assert any(r[5] for r in got)


@pytest.mark.parametrize("block_chars", [40, 1_000_000])
def test_edges(spark, block_chars):
    """Short items, nulls, repeated rows, a long text, clashing names, several blocks."""
    long_text = "x y " * 30_000 + "alpha beta gamma delta one two three four five six seven " + "z " * 1000
    docs = [(1, "Alpha, BETA; gamma", None, 1), (1, "Alpha, BETA; gamma", None, 1), (2, None, "a", None), (3, "", "b", 2),
            (4, long_text, None, 3), (None, "one two three four five six seven eight nine ten eleven", None, 0), (5, "!!! ...", None, 0),
            (6, "a a a a a a a a a a a a a a a a", None, 0)]
    items = [(7, "alpha beta gamma delta"), (8, "beta"), (9, "gamma delta ONE two three four five six seven z z z"), (10, None), (11, "  "),
             (12, "one two three four five six seven eight nine ten"), (None, "y x y"), (13, "a " * 12), (13, "beta gamma")]
    found = decontaminate.find_overlaps(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), block_chars=block_chars)
    assert rows(found) == sorted(brute.overlaps([d[:2] for d in docs], items), key=str)


def test_empty_tables(spark):
    none, docs = spark.createDataFrame([], ITEMS), spark.createDataFrame([(1, "a b", "", 0)], DOCS)
    assert rows(decontaminate.find_overlaps(docs, none)) == [(1, 2, 0, 0, brute.sha(""), False)]
    assert rows(decontaminate.find_overlaps(docs.limit(0), none)) == []


def test_a_large_benchmark_with_a_repeated_item(spark, monkeypatch):
    """Many items and very many copies of one: blocks stay bounded, one index is alive at a time, results are whole."""
    items = [(i, f"item{i} " + " ".join(f"w{i}_{k % 7}" for k in range(30))) for i in range(300)] + [(1000 + i, "copied item of a few words that every one has") for i in range(5000)]
    docs = [(i, f"before {t} after") for i, (_, t) in enumerate(items[:300:40])] + [(900, items[-1][1] + " " + items[5][1]), (901, "nothing here")]
    benchmark = spark.createDataFrame(items, ITEMS)
    entries = decontaminate.benchmark_entries(benchmark, 10_000)
    sizes = entries.groupBy("block").agg(F.sum(F.length("text") + 8 * F.size("item_ids")).alias("s"), F.count("*").alias("n")).collect()
    assert len(sizes) > 5 and all(r.s < 21_000 or r.s >= 40_000 for r in sizes) and sum(r.n for r in sizes) == 301
    made, live = decontaminate._block_index, []

    def counted(*how):
        if live:  # the pass before has released its own
            assert live[-1].released
        shared = made(*how)
        shared.released, drop = False, shared.unpersist
        shared.unpersist = lambda *a, **b: (setattr(shared, "released", True), drop(*a, **b))
        live.append(shared)
        return shared
    monkeypatch.setattr(decontaminate, "_block_index", counted)
    found = decontaminate.find_overlaps(spark.createDataFrame([(*d, "", 0) for d in docs], DOCS), benchmark, block_chars=10_000)
    assert rows(found) == sorted(brute.overlaps(docs, items), key=str) and len(live) > 5
