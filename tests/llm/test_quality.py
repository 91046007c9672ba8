"""The rule ledger against plain counts, and its bit arithmetic."""

import brute
import pytest

from adspark.llm import quality

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
TEXTS = [None, "", " \n\t ", "a", "a b c", "a a a a", "a b c a b c", "x\ny\nx\n \n\nx", "# *$%&|<> é Ünï code \U0001F600", "a b c d a b c e b c d",
         "p q r s " * 20_000, " ".join(f"w{i}" for i in range(5000)), "LOUD WORDS HERE " * 30, "line one\n" * 60, "a\x0bb\x0cc\rd"]


def test_measures(spark):
    df = spark.createDataFrame([(i, t, i, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, _words int, failed int")
    got = {r.doc_id: tuple(r[c] for c in COUNTS) for r in quality.ledger(df).collect()}
    assert got == {i: brute.quality(t) for i, t in enumerate(TEXTS)}


def test_rows_and_policies(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    rows = quality.verdicts(quality.ledger(df))
    assert sorted(str(r.doc_id) for r in rows.collect()) == ["1", "1", "None"]
    assert not any(r.kept_base for r in rows.collect())
    assert quality.ledger(df.limit(0)).count() == 0
    assert [quality.mask(p) for p in quality.POLICIES] == [3, 15, 63]


@pytest.mark.parametrize("policy", list(quality.POLICIES))
def test_ablations(spark, policy):
    bits = [0, 0, 1, 2, 3, 4, 12, 16, 63]
    rows = spark.createDataFrame([(b,) for b in bits], "failed long")
    m = quality.mask(policy)
    for r in quality.ablations(rows, policy).collect():
        b = quality.bit(r.rule)
        assert r.n_failed == sum(bool(x & b) for x in bits)
        assert r.n_failed_alone == sum(x & m == b for x in bits)
        assert r.n_kept_without == sum(x & m & ~b == 0 for x in bits)


def test_stays_in_jvm(spark):
    plan = quality.ledger(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
