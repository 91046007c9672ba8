"""The discriminant against a plain Gaussian version, held-out accuracy, edge cases."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from adspark.llm import classifier, queries

DIR = "/root/testdata/sf0.1"


def test_held_out(spark):
    labels = dict(duckdb.sql(f"select doc_id, quality from '{DIR}/labels.parquet'").fetchall())
    got = queries.QUERIES["op13_quality_classifier"](spark, DIR).collect()
    assert len(got) == 10_000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    good, bad = [p for y, p in held if y], [p for y, p in held if not y]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.03


def moments(x, y):
    return {k: (int((y == k).sum()), [int(v) for v in x[y == k].sum(0)], [int((x[y == k][:, i] * x[y == k][:, j]).sum()) for i, j in classifier.pairs(x.shape[1])])
            for k in sorted(set(y.tolist()))}


def test_scores_are_log_density_differences():
    rng = np.random.default_rng(2)
    y = (rng.random(400) < 0.7).astype(int)
    x = np.rint((rng.normal(0, 1, (400, 3)) * np.where(y, 1, 3)[:, None] + y[:, None]) * classifier.UNIT).astype(np.int64)
    model = classifier.discriminant(moments(x, y), pooled=0.2, ridge=0.1)
    z = x / classifier.UNIT
    spread = {k: np.cov(z[y == k].T, bias=True) for k in (0, 1)}
    both = sum((y == k).mean() * spread[k] for k in (0, 1))
    density = {}
    for k in (0, 1):
        cov = 0.8 * spread[k] + 0.2 * both
        cov = 0.9 * cov + 0.1 * np.trace(cov) / 3 * np.eye(3)
        d = z - z[y == k].mean(0)
        density[k] = np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d)
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(density[0] - density[1])), abs=1e-9)


def test_spark_sums_equal_plain_sums(spark):
    texts = [f"Word {i} and {'!! ' * (i % 7)} more words, {'LOUD ' * (i % 3)}here.\nLine {i % 5}." for i in range(60)]
    y = np.array([i % 3 == 0 for i in range(60)]).astype(int)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int")
    learned = np.array([zlib.crc32(str(i).encode()) % 5 != 0 for i in range(60)])
    x = classifier.statistics_of([t.encode() for t in texts])
    want = classifier.discriminant(moments(x[learned], y[learned]))
    got = classifier.train(classifier.statistics(docs), labels)
    assert (got.score(x) == want.score(x)).all() and 0 < learned.sum() < 60


def test_statistics():
    names = dict(zip(classifier.NAMES, classifier.statistics_of([b"Ab ab ab 12!,\n\xc3\xa9\n", b""]).T / classifier.UNIT))
    assert names["words"].tolist() == pytest.approx([np.log(6), 0], abs=1e-3)
    assert names["longest_word"].tolist() == pytest.approx([np.log(5), 0], abs=1e-3)
    assert names["repetition"][0] == pytest.approx(np.log(6 / 5), abs=1e-3) and names["neighbours"][0] == pytest.approx(np.sqrt(1 / 25), abs=1e-3)
    assert names["upper"][0] == pytest.approx(np.sqrt(1 / 26), abs=1e-3) and names["other"][0] == pytest.approx(np.sqrt(1 / 37), abs=1e-3)
    assert not any(v[1] for v in names.values())


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "...", 1), (None, "x y", 1), (4, "a" * 500_000, 1), (4, "a" * 500_000, 1), (5, "\n\n!", 1)],
                                 "doc_id long, text string, score int").withColumn("stats", F.lit("clash"))
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    for labels, only in ((make([]), 1.0), (make([(1, 1), (3, 1)]), 1.0), (make([(1, 0), (2, None), (3, 0)]), 0.0),
                         (make([(1, 1), (2, 1), (2, 0), (None, 1), (3, 0), (4, 1), (5, 7)]), None)):
        got = classifier.classify(docs, labels).collect()
        assert len(got) == 7 and all(0 <= r.score <= 1 for r in got) and got[0].row.stats == "clash"
        assert only is None or {r.score for r in got} == {only}
    assert classifier.classify(docs.limit(0), make([(1, 1), (2, 0)])).count() == 0
