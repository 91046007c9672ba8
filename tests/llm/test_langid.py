"""Held-out accuracy of the byte network, and edge cases."""

import zlib

import duckdb
import numpy as np

from pyspark.sql import functions as F

from adspark.llm import langid, queries

DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    want = dict(duckdb.sql(f"select doc_id, lang from '{DIR}/documents.parquet'").fetchall())
    got = queries.QUERIES["op9_language_id"](spark, DIR).collect()
    assert len(got) == len(want) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r.lang_pred == want[r.doc_id] for r in got if r.held_out]
    assert sum(held) / len(held) >= 0.97


def test_edges(spark):
    texts = [None, "", " \n", "12 34 !!", "é", "the and of the house and of the", "x" * 700_000, "der die das und ich nicht"]
    rows = [(i if i != 3 else None, t, ("en", "de", None)[i % 3], "src", 1) for i, t in enumerate(texts)] + [(5, texts[5], "en", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, held_out int")
    got = langid.predict(df, langid.train(df)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (0, 1, 2, None))
    assert all(by[i].lang_pred in ("en", "de") for i in (4, 5, 6, 7))
    assert langid.train(df.where("lang is null")) is None
    assert {r.lang_pred for r in langid.predict(df, None).collect()} == {"und"}
    assert langid.predict(df.limit(0), None).count() == 0


def test_pair_tables_equal_convolution():
    rng = np.random.default_rng(1)
    net = langid.fit([b"the house of the" * 4, b"der die das und " * 4] * 4, ["en", "de"] * 4, steps=5)
    text = bytes(rng.integers(97, 122, 600, dtype=np.uint8))
    _, scores = langid.predict_batch(net, net.pair_tables(), [text])
    rows, used = langid._windows([text])
    emb = net.embed[rows]
    n = langid.WINDOW - langid.TAPS + 1
    z = np.concatenate([emb[:, j:j + n] for j in range(langid.TAPS)], axis=2) @ net.filters + net.bias
    prob = langid._softmax(np.maximum(z.max(axis=1), 0) @ net.out + net.out_bias)
    best = (np.log(prob) * used[:, None]).sum(0).argmax()
    assert abs((prob[:, best] * used).sum() / used.sum() - scores[0]) < 1e-4


def test_never_reads_language_or_source(spark):
    df = spark.read.parquet(f"{DIR}/documents.parquet")
    net = langid.train(df)
    a = langid.predict(df, net).collect()
    b = langid.predict(df.drop("lang", "source"), net).collect()
    assert sorted(a) == sorted(b)


def test_repeated_rows_neither_crowd_out_nor_swell_the_sample(spark):
    """50,000 copies of one English row beside three French ones: both languages are learned, whatever the ids."""
    english, french = "the same english sentence is here once more", ["le chat est sur la table", "une phrase avec des mots", "encore une autre phrase"]
    for base in (0, 100_000, 777_777):
        copies = spark.range(base, base + 50_000).select(F.col("id").alias("doc_id"), F.lit(english).alias("text"), F.lit("en").alias("lang"))
        docs = copies.unionByName(spark.createDataFrame([(base + 60_000 + i, t, "fr") for i, t in enumerate(french * 4)], "doc_id long, text string, lang string"))
        got = langid.sample(docs)
        assert len(got) <= 2 * (1 + len(french)) and {x for x, _ in got} == {"en", "fr"}
    assert langid.train(docs).langs == ["en", "fr"]


def test_the_sample_is_bounded_by_language(spark):
    rows = [(i, f"words number {i} of a text", f"l{i % 7}") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.sample(docs, docs_per_lang=5, windows_per_doc=3, max_langs=4)
    assert len(got) == 4 * 5 * 3 and len({x for x, _ in got}) == 4
    assert got == langid.sample(docs.repartition(9), docs_per_lang=5, windows_per_doc=3, max_langs=4)
    assert langid.sample(docs.limit(0)) == [] and langid.train(docs.limit(0)) is None
