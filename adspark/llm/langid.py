"""Language identification with a small byte convolutional network.

Bytes are embedded, filters of several widths run over fixed-length windows,
each filter keeps its maximum over the window, and a softmax layer turns the
maxima into language probabilities. Training is numpy on a bounded sample of
windows of labelled texts. Prediction covers whole texts: every text is cut
into windows, and a text's log-probabilities are its windows' averaged by their
number of bytes.

A filter's output depends on at most four bytes, so for prediction the layer
below the pooling is tabulated by byte pairs: two look-ups per position.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adspark.llm.text import below, held_out, map_texts, slices, stored

WINDOW = 256
EMBED = 8
FILTERS = {2: 8, 3: 12, 4: 12}
TAPS = max(FILTERS)
#: Bounds of the training sample: languages (those with the most texts), texts of each and windows of a text.
MAX_LANGS = 200
DOCS_PER_LANG = 700
WINDOWS_PER_DOC = 2
STEPS = 500
BATCH = 64
UNDETERMINED = "und"


@dataclass
class ByteNet:
    """langs, byte embedding, filters (taps x embed, filters), softmax layer."""

    langs: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pair_tables(self) -> tuple[np.ndarray, np.ndarray]:
        taps = [self.embed @ self.filters[j * EMBED:(j + 1) * EMBED] for j in range(TAPS)]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1).astype(np.float32)
        return pair(taps[0] + self.bias, taps[1]), pair(taps[2], taps[3])


def _windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts cut into zero-padded windows (rows), and the number of bytes in each."""
    counts = [max(1, -(-len(t) // WINDOW)) for t in texts]
    rows = np.frombuffer(b"".join(t.ljust(n * WINDOW, b"\0") for t, n in zip(texts, counts)), np.uint8).reshape(-1, WINDOW)
    used = np.full(len(rows), WINDOW)
    used[np.cumsum(counts) - 1] = [len(t) - (n - 1) * WINDOW for t, n in zip(texts, counts)]
    return rows, used


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(windows: list[bytes], labels: list[str], steps: int = STEPS, seed: int = 7) -> ByteNet:
    """Train by Adam on windows and their languages; deterministic for a given input."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    n_f, widths = sum(FILTERS.values()), np.repeat(list(FILTERS), list(FILTERS.values()))
    live = (np.arange(TAPS)[:, None] < widths[None, :]).repeat(EMBED, axis=0).astype(np.float32)
    p = {"embed": rng.normal(0, 0.5, (256, EMBED)), "filters": rng.normal(0, 0.3, (TAPS * EMBED, n_f)) * live, "bias": np.zeros(n_f),
         "out": rng.normal(0, 0.3, (n_f, len(langs))), "out_bias": np.zeros(len(langs))}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    x_all, _ = _windows([w.lower()[:WINDOW] for w in windows])
    y_all = np.array([langs.index(x) for x in labels])
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    n_at = WINDOW - TAPS + 1
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(x_all), BATCH)
        x, y = x_all[pick], y_all[pick]
        emb = p["embed"][x]
        cols = np.concatenate([emb[:, j:j + n_at] for j in range(TAPS)], axis=2)
        z = cols @ p["filters"]
        at = z.argmax(axis=1)
        pooled = np.take_along_axis(z, at[:, None, :], axis=1)[:, 0] + p["bias"]
        h = np.maximum(pooled, 0)
        d = _softmax(h @ p["out"] + p["out_bias"])
        d[np.arange(BATCH), y] -= 1
        d /= BATCH
        dh = (d @ p["out"].T) * (pooled > 0)
        seen = cols[np.arange(BATCH)[:, None], at]
        g = {"out": h.T @ d, "out_bias": d.sum(0), "bias": dh.sum(0), "filters": np.einsum("bf,bfk->kf", dh, seen) * live,
             "embed": np.zeros_like(p["embed"])}
        back = (dh[:, :, None] * (p["filters"] * live).T[None]).reshape(BATCH, n_f, TAPS, EMBED)
        for j in range(TAPS):
            np.add.at(g["embed"], x[np.arange(BATCH)[:, None], at + j].ravel(), back[:, :, j].reshape(-1, EMBED))
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
            p[k] = (p[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return ByteNet(langs, **p)


def sample(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, windows_per_doc: int = WINDOWS_PER_DOC, max_langs: int = MAX_LANGS) -> list[tuple[str, str]]:
    """(lang, window) of the training sample, sorted.

    Of each language the ``docs_per_lang`` different texts with the smallest
    hashes, ``windows_per_doc`` windows of each at places its hash names; all
    of them where there are fewer. Repeated rows count once, so they neither
    crowd others out nor swell the sample. At most ``max_langs`` languages: the
    ones with the most different texts, ties by name.
    """
    rows = docs.select("text", "lang").where(F.col("lang").isNotNull() & ~held_out() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("text", "lang", F.xxhash64("text").alias("h"))
    texts = stored(rows.groupBy("lang", "h").agg(F.count("*").alias("copies")).select("lang", "h"), "language-texts")
    langs = texts.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs)
    first = Window.partitionBy("lang").orderBy("h")
    # The smallest hashes of many are looked for among those that are small at all: some eight times as many as asked for.
    likely = texts.join(F.broadcast(langs), "lang").where(below(F.col("h"), 8 * (docs_per_lang + 32) / F.col("count")))
    chosen = likely.withColumn("n", F.row_number().over(first)).where(F.col("n") <= docs_per_lang).select("lang", "h")
    place = lambda k: 1 + F.pmod(F.xxhash64("h", F.lit(k)), F.greatest(F.length("text") - WINDOW, F.lit(1)))
    cuts = F.array(*[F.substr("text", place(k).cast("int"), F.lit(WINDOW)) for k in range(windows_per_doc)])
    # At most max_langs * docs_per_lang rows are looked for; their copies are one row before they are gathered.
    found = rows.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "h", cuts.alias("cuts")).groupBy("lang", "h").agg(F.min("cuts").alias("cuts"))
    return sorted((r.lang, w) for r in found.collect() for w in r.cuts)


def train(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, windows_per_doc: int = WINDOWS_PER_DOC) -> ByteNet | None:
    """Fit on a bounded sample (see ``sample``) of the rows with a non-null lang that are not held out and have a letter.

    None when there is no such row.
    """
    got = sample(docs, docs_per_lang, windows_per_doc)
    return fit([w.encode() for _, w in got], [x for x, _ in got]) if got else None


_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def _has_letter(t: bytes) -> bool:
    return bool(_ASCII_LETTER.search(t)) or any(c.isalpha() for c in t.decode())


def predict_batch(net: ByteNet, tables: tuple[np.ndarray, np.ndarray], texts: list[bytes | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    known = [i for i, t in enumerate(texts) if t and _has_letter(t)]
    langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if not known:
        return langs, scores
    rows, used = _windows([texts[i].lower() for i in known])
    pooled = np.empty((len(rows), len(net.bias)), np.float32)
    for a in range(0, len(rows), 64):
        pair = rows[a:a + 64, :-1].astype(np.int32) << 8
        pair |= rows[a:a + 64, 1:]
        pooled[a:a + 64] = (tables[0][pair[:, :-2]] + tables[1][pair[:, 2:]]).max(axis=1)
    prob = _softmax(np.maximum(pooled, 0) @ net.out + net.out_bias)
    counts = [max(1, -(-len(texts[i]) // WINDOW)) for i in known]
    start = np.r_[0, np.cumsum(counts)[:-1]]
    total = np.add.reduceat(used, start)[:, None]
    logs = np.add.reduceat(np.log(prob + 1e-9) * used[:, None], start) / total
    mean = np.add.reduceat(prob * used[:, None], start) / total
    best = logs.argmax(axis=1)
    for i, b, s in zip(known, best, mean[np.arange(len(best)), best]):
        langs[i], scores[i] = net.langs[b], float(min(max(s, 0.0), 1.0))
    return langs, scores


def predict(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """doc_id, lang_pred and score of every whole text.

    A null text, one without a letter, or any text when nothing was learned
    (``net`` None) is ``und`` with score 0. Repeated rows each get a row, null
    doc_ids stay, other columns are ignored, an empty table gives no rows.
    """
    d = docs.select(F.col("text").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    if net is None:
        return d.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches):
        tables = net.pair_tables()
        for batch, texts in slices(batches):
            langs, scores = predict_batch(net, tables, texts)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    return map_texts(d, run, "doc_id long, lang_pred string, score double")
