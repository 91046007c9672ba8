"""Held-out quality of the multiple-instance model, located sentences, edge cases."""

import math
import random
import zlib

import duckdb

from adspark.llm import queries, toxicity

DIR = "/root/testdata/sf0.1"
SMALL = "/root/testdata/sf0.001"


def corpus(n=400):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("aeioubdgklmnprst") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    rows = []
    for i in range(n):
        sents = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(4, 12))) for _ in range(rng.randint(1, 20))]
        toxic = i % 4 == 0
        if toxic:
            k = rng.randrange(len(sents))
            sents[k] += rng.choice([" Zwackel", " grobnix", " zwackelig"])
        rows.append((i, ". ".join(sents) + ".", int(toxic)))
    return rows


def test_held_out(spark):
    labels = dict(duckdb.sql(f"select doc_id, toxic from '{DIR}/labels.parquet'").fetchall())
    got = queries.QUERIES["op2_toxicity"](spark, DIR).collect()
    assert len(got) == 10_000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    toxic, clean = [p for y, p in held if y], [p for y, p in held if not y]
    assert sum(toxic) / len(toxic) >= 0.8 and sum(clean) / len(clean) <= 0.01


def test_locates_the_sentence(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0) for i, t, _ in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, labels), keep=["doc_id", "text", "score"])
    for r in out.collect():
        toxic = r.row.doc_id % 4 == 0
        assert (r.score >= 0.5) == toxic
        found = [r.row.text[s.start:s.end] for s in r.sentences]
        assert bool(found) == toxic and all("zwackel" in f.lower() or "grobnix" in f for f in found)


def test_long_clean_texts_stay_clean(spark):
    rows = corpus()
    model = toxicity.fit([t for _, t, _ in rows], [y for _, _, y in rows])
    weights = toxicity.WordWeights(model)
    clean = " ".join(t for _, t, y in rows if not y)
    assert toxicity.noisy_or(z for _, _, z in toxicity.sentence_scores(model, weights, clean)) < 0.5
    assert toxicity.noisy_or(z for _, _, z in toxicity.sentence_scores(model, weights, clean + " zwackel grobnix. ")) >= 0.5


def test_the_sample_is_whole_documents(spark):
    """Within both bounds, each class by itself; never a part of a text; repeated rows once."""
    rows = [(i, f"text {i}. " * (1 + i % 50), i % 2) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(i, t) for i, t, _ in rows[:40]] + [(1, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    for n, chars in ((30, 10**9), (10**6, 4000), (10**6, 1), (10**6, 10**9)):
        got = toxicity.sample(docs, labels, n, chars).collect()
        assert len({r.doc_id for r in got}) == len(got) and not held & {r.doc_id for r in got}
        assert all(r.text == rows[r.doc_id][1] and r.toxic == rows[r.doc_id][2] for r in got)
        for y in (0, 1):
            mine = [r for r in got if r.toxic == y]
            assert 1 <= len(mine) <= n and (len(mine) == 1 or sum(len(r.text) for r in mine) <= chars)
    assert len(got) == 400 - len(held)


def brute_noisy_or(model, text):
    """A document's score, sentence by sentence and feature by feature, without the code's memo and batches."""
    import re
    rest = 1.0
    for s in re.findall(r"[^.!?\n]+[.!?\n]*|[.!?\n]+", text or ""):
        z = model.bias
        for w in s.lower().split():
            w = f"^{w.strip(toxicity._EDGE)}$".encode()
            grams = {w} | {w[i:i + n] for n in (4, 5) for i in range(len(w) - n + 1)} if len(w) >= 3 else set()
            z += sum(model.weights.get(f, 0.0) for f in {zlib.crc32(g) % toxicity.DIMENSIONS for g in grams})
        rest *= 1 - 1 / (1 + math.exp(-z))
    return 1 - rest


def test_scores_equal_brute_force(spark):
    model = toxicity.train(spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert model.weights
    for r in toxicity.score(docs, model, keep=["doc_id", "text"]).collect():
        assert abs(r.score - brute_noisy_or(model, r.row.text)) < 1e-9


def test_learns_where_one_class_is_long_or_labels_lack_documents(spark):
    rows = corpus()
    rows = [(i, ". ".join([t] * 12) if y else t, y) for i, t, y in rows]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(10_000 + i, 1) for i in range(3000)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, labels, docs_per_class=150), keep=["doc_id"]).collect()
    right = sum((r.score >= 0.5) == (r.row.doc_id % 4 == 0) for r in out)
    assert right >= 0.95 * len(out)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (None, "x y"), (4, "a" * 500_000), (4, "a" * 500_000), (5, "\n\n!")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(1, None), (2, 1), (2, 0), (None, 1), (3, 0), (4, 1)], "doc_id long, toxic int")
    for labels in (none, odd):
        got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
        assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
        assert [r.score for r in got if not r.row.text] == [0.0, 0.0]
    assert toxicity.score(docs.limit(0), toxicity.Model({}, -20.0)).count() == 0
    assert queries.QUERIES["op2_toxicity"](spark, SMALL).count() == 200
