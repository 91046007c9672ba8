"""Each stage against a plain version of its decision, and the chain as a whole."""

import brute
import duckdb
import public_tokenizers
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from adspark.llm import mixing, toxicity  # noqa: E402
from adspark.llm.text import stored, table  # noqa: E402

DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = table(spark, DIR, "documents")
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_id_output"]

    a = stored(stage["toxicity"](spark, docs, DIR), "a")
    model = toxicity.train(docs, table(spark, DIR, "labels"))
    weights = toxicity.WordWeights(model)
    clean = lambda t: toxicity.noisy_or(z for _, _, z in toxicity.sentence_scores(model, weights, t or "")) < 0.5
    assert rows(a) == [r for r in rows(docs) if clean(r[1])]

    b = stored(stage["simhash_near_dedup"](spark, a, DIR), "b")
    have = sorted(rows(a))
    group = brute.classes([brute.simhash(r[1]) for r in have])
    assert rows(b) == sorted((r for i, r in enumerate(have) if group[i] == i), key=str) and len(rows(b)) < len(have)

    c = stored(stage["benchmark_decontamination"](spark, b, DIR), "c")
    items = duckdb.sql(f"select item_id, text from '{DIR}/benchmark.parquet'").fetchall()
    hit = {r[0] for r in brute.overlaps([r[:2] for r in rows(b)], items) if r[5]}
    assert rows(c) == [r for r in rows(b) if r[0] not in hit] and hit

    d = stored(stage["source_mixing"](spark, c, DIR), "d")
    assert set(rows(d)) <= set(rows(c)) and d.columns == COLUMNS
    want = {r.source: r.words for r in mixing.mix(c).draws.groupBy("source").agg({"size": "sum"}).withColumnRenamed("sum(size)", "words").collect()}
    taken: dict = {}
    for r in rows(d):
        taken[r[3]] = taken.get(r[3], 0) + len(brute.words(r[1]))
    assert taken == want

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n = {r[0]: len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows(d)}
    out = sorted(stage["token_id_output"](spark, d, DIR).collect(), key=lambda r: r.start)
    start = 0
    for r, doc in zip(out, sorted(x[0] for x in rows(d)), strict=True):
        assert (r.doc_id, r.start, r.n_tokens) == (doc, start, n[doc])
        start += r.n_tokens


def test_run_equals_the_stages(spark):
    got = corpus_pipeline.run(spark, DIR)
    assert got.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 0


def test_edges(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, an extra column, and no rows at all."""
    data = [(1, None, None, None, None, 1), (None, "no id", "en", "s", 5, 1), (2, "", "en", None, 0, None), (3, "same text here", "en", "s", 1, 1),
            (3, "same text here", "en", "s", 1, 1), (4, "same text here", None, "t", 1, 1), (5, "long words " * 30_000, "en", "t", 1, 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, score int")
    spark.createDataFrame([(3, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, docs, str(tmp_path)), name)
            if stage is not corpus_pipeline.STAGES[-1][1]:
                assert out.columns == docs.columns
            if name == "simhash_near_dedup":
                assert out.where("text = 'same text here'").count() <= 1
            docs = out
        assert docs.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
