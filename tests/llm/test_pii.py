"""Base rules against the plain patterns; bootstrapping on planted contexts."""

import random

import brute
import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from adspark.llm import pii, queries

DIR = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, base int, seen string"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0149a.@+-_% ()é\n", max_size=60))
def test_rules(text):
    assert pii.entities(text) == brute.entities(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (988) 555-2485", "a.b@x.y", "@", "10.0.0.255", "256.1.1.1", "1.2.3.4.5.6.7.8", "007.0000000300.1.2",
                                 "5500005555555559", " ", ".", "é", "+", "x", "9", "a@b.c@d.e", "_x@d.com"]), max_size=8))
def test_rules_on_parts(parts):
    text = "".join(parts)
    assert pii.entities(text) == brute.entities(text)
    known = pii.entities(text)
    for a, b in pii.identifiers(text, known):
        assert all(y <= a or x >= b for _, x, y in known)


def test_query_equals_brute_force(spark):
    docs = duckdb.sql(f"select doc_id, text from '{DIR}/documents.parquet'").fetchall()
    got = {r.doc_id: r for r in queries.QUERIES["op6_pii"](spark, DIR).collect()}
    assert len(got) == len(docs)
    for d, t in docs:
        base = brute.entities(t)
        said = [f"{k}:{a}:{b}" for k, a, b in base]
        assert got[d].base_sha256 == brute.sha(",".join(said)) and set(said) <= set(got[d].spans.split(",") if got[d].spans else [])
        assert [got[d][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]


def test_bootstrap_finds_unseen_identifiers(spark):
    rng = random.Random(9)
    phone = lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    rows = [(i, f"Intro {i % 7}. Please call me at {phone()} today. Order {10_000 + i} shipped.", 1, "") for i in range(40)]
    rows += [(100, "Please call me at 0151/2345-678 today.", 1, ""), (101, "You may also ring me at 0151/2345-678 now", 1, ""), (102, "order 99887 shipped", 1, "")]
    rows += [(103 + i, f"ring me at {phone()} now", 1, "") for i in range(10)]
    got = {r.doc_id: r for r in pii.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    text = rows[40][1]
    assert [(s.kind, text[s.start:s.end]) for s in got[100].added] == [("phone", "0151/2345-678")]
    assert len(got[101].added) == 1 and not got[102].added and not any(got[i].added for i in range(40))


def test_identifiers_beside_other_marked_words():
    found = lambda t: [t[a:b] for a, b in pii.identifiers(t, pii.entities(t))]
    assert found("ref 48213-77 a@b.cd") == ["48213-77"] and found("10.0.0.1 48213-77 9") == ["48213-77 9", "48213-77"]
    assert found("no 48213-77 55124-09.") == ["48213-77 55124-09", "48213-77", "55124-09"]
    assert found("x 12 a@b.cd 1 a@b.cd") == [] and found("a@b.cd;id=12345") == ["id=12345"]


def test_contexts_take_whole_words():
    long = "q" * 150
    one, two = (pii.Contexts(t, []).of(t.index("12345"), t.index("12345") + 5) for t in (f"a{long} w 12345 b{long}", f"b{long} w 12345 c{long}"))
    assert one[0] != two[0] and one[1] != two[1]
    text = "a@b.cd," * 30_000  # in time that grows with the text
    assert len(pii._sights(text, pii.entities(text))) == 30_000
    assert pii.Contexts("Call me at (a@b.cd), now", []).of(12, 18) == ["at  _", " _ "]


def test_bootstrap_beside_other_marked_words(spark):
    rng = random.Random(9)
    phone = lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    rows = [(i, f"Please call me at {phone()} today.", 1, "") for i in range(40)] + [(50 + i, f"ring me at {phone()} now", 1, "") for i in range(10)]
    rows += [(100, "Please call me at 0151/2345-678 a@b.cd", 1, ""), (101, "ring me at 0151/2345-678 now", 1, ""), (102, "Please call me at 0151/2345-678 8831 today", 1, "")]
    got = {r.doc_id: r for r in pii.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    text = {i: t for i, t, _, _ in rows}
    said = {i: [(s.kind, text[i][s.start:s.end]) for s in got[i].added] for i in got}
    assert said[100] == said[101] == [("phone", "0151/2345-678")] and len(said[102]) == 1
    assert not any(said[i] for i in range(60) if i in said)


def test_edges(spark):
    rows = [(1, None, 1, None), (2, "", 1, None), (None, "a@b.cd", 1, None), (3, "a@b.cd x", 1, None), (3, "a@b.cd x", 1, None), (4, "1" * 100_000, 0, ""), (5, "a" * 200_000 + "@", 0, ""),
            (6, "@" * 50_000, 0, ""), (7, "1 " * 50_000, 0, ""), (8, "1." * 50_000, 0, "")]
    got = pii.extract(spark.createDataFrame(rows, SCHEMA))
    rows_out = got.collect()
    assert len(rows_out) == len(rows)
    assert sorted(len(r.base) for r in rows_out if r.doc_id is None or r.doc_id < 8) == [0, 0, 0, 0, 0, 0, 1, 1, 1]
    assert pii.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_secrets_of_the_table_are_found(spark):
    """Every quoted token of the documents comes through the patterns; documents without one stay as they are."""
    import re
    docs = duckdb.sql(f"select doc_id, text from '{DIR}/documents.parquet'").fetchall()
    got = {r.doc_id: r for r in queries.QUERIES["op6_pii"](spark, DIR).collect()}
    tokens = 0
    for d, t in docs:
        said = [x.split(":") for x in got[d].spans.split(",") if x.startswith("secret")]
        want = [m.span(1) for m in re.finditer(r"(?i)token = \"([0-9a-f]{40})\"", t or "")]
        assert [(int(a), int(b)) for _, a, b in said] == want
        assert got[d].n_private == len([x for x in got[d].spans.split(",") if x]) and got[d].n_added >= len(want)
        tokens += len(want)
    assert tokens >= 10


def test_patterns_of_secrets_reach_unquoted_ones_and_need_confirmation(spark):
    rng = random.Random(5)
    key = lambda n=32: "".join(rng.choice("abcdef0123456789") for _ in range(n))
    rows = [(i, f'conf api_key = "{key()}" end', 1, "") for i in range(20)] + [(100, f"see api_key = {key()} or so", 1, ""), (101, f"commit {key(40)} is fine", 1, "")]
    got = {r.doc_id: r for r in pii.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    text = {i: t for i, t, _, _ in rows}
    said = {i: [(s.kind, text[i][s.start:s.end]) for s in got[i].added] for i in got}
    assert all(said[i] == [("secret", text[i].split('"')[1])] for i in range(20))
    assert said[100] == [("secret", text[100].split()[3])] and said[101] == []
    alone = pii.extract(spark.createDataFrame([(1, f'id: "{key()}"', 1, ""), (2, "nothing", 1, "")], SCHEMA)).collect()
    assert not any(r.added for r in alone)  # one sight confirms no pattern


def test_secret_seeds():
    whole = lambda t, v: pii.secret_seed(t, t.index(v), t.index(v) + len(v))
    v = "a8F3kd92LmQ0xz71bVn4"
    assert whole(f'k = "{v}"', v) and whole(f"k:'{v}'", v)
    assert not whole(f"k = {v}", v) and not whole(f'said "{v}"', v) and not whole(f'k = "{v}\'', v)
    assert not whole('k = "' + "a1" * 20 + '"', "a1" * 20) and not whole('k = "12345678901234567890"', "12345678901234567890")
    assert pii.shape("0" * 16) == "9/8" and pii.shape("a0" * 20) == "hex/11" and pii.shape(v).startswith("mix/") and pii.shape("a b").startswith("other/")
