"""Fenwick tree, cuts and whole outputs against plain versions."""

import hashlib
import re
import string

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from adspark.llm import infill

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
TEXT = st.text(alphabet=string.ascii_letters + " \n.<>PSM@[`{éß漢😀", max_size=120)


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 20:
        return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9)), min_size=1, max_size=40))
def test_tree_descent(blocks):
    tree = infill.BlockTree([u for u, _ in blocks], [p for _, p in blocks])
    owners = [(i, sum(u for u, _ in blocks[:i]), sum(p for _, p in blocks[:i])) for i, (u, _) in enumerate(blocks) for _ in range(u)]
    assert [tree.find(k) for k in range(len(owners))] == owners


@settings(max_examples=80, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5), st.integers(1, 9))
def test_places(texts, block):
    raw = [t.encode() for t in texts]
    unit, point = infill.starts(raw)
    at = 0
    for t, b in zip(texts, raw):
        cuts = infill.Cuts(unit[at:at + len(b)], point[at:at + len(b)], block)
        at += len(b)
        units = UNIT.findall(t)
        assert cuts.n == len(units) and cuts.n_points == len(t)
        for k in range(len(units) + 1):
            left = "".join(units[:k])
            assert cuts.place(k) == (len(left.encode()), len(left))


@settings(max_examples=80, deadline=None)
@given(TEXT, st.integers(0, 120), st.integers(0, 120), st.sampled_from(["psm", "spm"]))
def test_round_trip(text, a, b, form):
    if not any(m in text for m in ("<P>", "<S>", "<M>")):
        a, b = sorted((a, b))
        cut = [len(text[:x].encode()) for x in (a, b)]
        assert infill.restore(infill.arrange(text.encode(), form, *cut), form).decode() == text


def test_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    letters = list("abcXYZ  \n.,é漢😀<>")
    rows = [(int(i), "".join(rng.choice(letters, int(rng.integers(0, 300))))) for i in range(-20, 300)]
    rows += [(None, "no id here"), (7, None), (8, ""), (9, "has <S> inside"), (10, "<P><M>"), (11, "a" * 300_000), (12, "é" * 100_000 + " b" * 90_000), (12, "again"), (12, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("output", F.lit("clash")).withColumn("form", F.lit(3))
    got = infill.restored(infill.transform(docs, block=64)).collect()
    assert sorted((str(r.doc_id), r.n, r.form, str(r.prefix_chars), str(r.middle_chars), r.output) for r in got) == sorted(
        (str(i), n, f, str(p), str(m), o) for i, t in rows for n, f, p, m, o in [brute(i, t)])
    assert sorted(r.restored for r in got) == sorted(t or "" for _, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert infill.restored(infill.transform(docs.limit(0))).count() == 0
