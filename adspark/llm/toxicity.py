"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic
function of the weights of its words' features (the word and its character
4- and 5-grams), a document's is the noisy-or of its sentences:
``1 - prod(1 - p)``. Only documents are labelled; the gradient of the noisy-or
shares each label among the sentences, so the trained model also tells which
sentences offend.

Training is numpy on a bounded sample of labelled documents; scoring covers
every sentence of every text.
"""

from __future__ import annotations

import math
import re
from array import array
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adspark.llm.text import below, held_out, map_texts, slices, stored

#: Bounds of the training sample: documents per class, and their characters together.
DOCS_PER_CLASS = 1500
CLASS_CHARS = 6_000_000
MIN_DOCS = 4
DIMENSIONS = 1 << 21
MIN_Z = 2.5
LASSO = 1e-5
STEPS = 80
MEMO_WORDS = 200_000

_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*|[.!?\n]+")
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def features(word: str) -> set[int]:
    """Hashes of a lower-cased word's features: itself and its 4- and 5-grams of bytes, its ends marked."""
    w = f"^{word.strip(_EDGE)}$".encode()
    if len(w) < 3:
        return set()
    return {crc32(w) % DIMENSIONS, *(crc32(w[i:i + n]) % DIMENSIONS for n in (4, 5) for i in range(len(w) - n + 1))}


@dataclass
class Model:
    weights: dict[int, float]
    bias: float


class WordWeights(dict):
    """Memo of the weight of a word; emptied when full."""

    def __init__(self, model: Model):
        super().__init__()
        self.weights = model.weights

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMO_WORDS:
            self.clear()
        get = self.weights.get
        value = self[word] = sum(get(f, 0.0) for f in features(word))
        return value


def fit(texts: list[str], labels: list[int], steps: int = STEPS, min_docs: int = MIN_DOCS) -> Model:
    """Maximise the noisy-or likelihood of the document labels by projected Adam (weights at least 0)."""
    words: dict[str, int] = {}
    token_word, token_sentence, sentence_doc = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        for m in _SENTENCE.finditer(text):
            for w in m[0].lower().split():
                token_word.append(words.setdefault(w, len(words)))
                token_sentence.append(len(sentence_doc))
            sentence_doc.append(d)
    y, n_docs, n_sent = np.array(labels, float), len(texts), len(sentence_doc)
    tw, ts, sd = (np.array(x, np.int32) for x in (token_word, token_sentence, sentence_doc))
    if not len(tw) or y.min() == y.max():
        return Model({}, 20.0 if n_docs and y.min() else -20.0)
    f_at, per_word = array("i"), array("i")
    for w in words:
        own = sorted(features(w))
        f_at.extend(own)
        per_word.append(len(own))
    f_at, per_word = np.array(f_at, np.int32), np.array(per_word, np.int64)
    w_at, first = np.repeat(np.arange(len(words), dtype=np.int32), per_word), np.cumsum(per_word) - per_word
    # Documents of either class with each feature, some documents at a time. Only features that
    # toxic documents have significantly more often can raise a sentence; nothing lowers one.
    df, clean, names = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), np.int64(DIMENSIONS)
    upto = np.searchsorted(sd[ts], np.arange(0, n_docs + 100, 100))
    for a, b in zip(upto, upto[1:]):
        pairs = np.unique(sd[ts[a:b]].astype(np.int64) * len(words) + tw[a:b])
        doc, word = np.divmod(pairs, len(words))
        per = per_word[word]
        at = np.repeat(first[word] - (np.cumsum(per) - per), per) + np.arange(per.sum())
        doc, feature = np.divmod(np.unique(np.repeat(doc, per) * names + f_at[at]), names)
        df += np.bincount(feature, y[doc], DIMENSIONS)
        clean += np.bincount(feature, 1 - y[doc], DIMENSIONS)
    clean *= y.sum() / (1 - y).sum()
    keep = (df >= min_docs) & (df - clean >= MIN_Z * np.sqrt(df + clean))
    ids = np.flatnonzero(keep)
    f_at, w_at = np.searchsorted(ids, f_at[keep[f_at]]), w_at[keep[f_at]]
    share = 1.0 / n_docs
    theta, bias, m, v = np.ones(len(ids)), -6.0, np.zeros(len(ids) + 1), np.zeros(len(ids) + 1)
    for step in range(1, steps + 1):
        weight = np.bincount(w_at, theta[f_at], len(words))
        z = np.clip(np.bincount(ts, weight[tw], n_sent) + bias, -30, 30)
        none = np.bincount(sd, np.log1p(np.exp(z)), n_docs)
        # d(-log likelihood)/dz = p for a clean document, -p (1 - P) / P for a toxic one.
        pull = np.where(y == 1, -np.exp(-none) / np.maximum(-np.expm1(-none), 1e-12), 1.0) * share
        g = pull[sd] / (1 + np.exp(-z))
        gw = np.bincount(tw, g[ts], len(words))
        grad = np.r_[np.bincount(f_at, gw[w_at], len(ids)) + LASSO, g.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        theta = np.maximum(theta - move[:-1], 0)
        bias -= float(move[-1])
    return Model({int(i): float(x) for i, x in zip(ids, theta) if x > 1e-3}, float(bias))


def sample(docs: DataFrame, labels: DataFrame, docs_per_class: int = DOCS_PER_CLASS, chars: int = CLASS_CHARS) -> DataFrame:
    """(doc_id, text, toxic) of the training sample: whole documents, of each class the first in hashed order.

    A class gives at most ``docs_per_class`` documents, and stops before one
    that would bring it over ``chars`` characters together; its first document
    always counts. Documents without a text are not drawn. Rows that repeat id
    and text count once. A doc_id labelled both ways counts as toxic.
    """
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")))
    known = stored(known, "toxicity-labels")
    rows = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h")).where(F.col("text").isNotNull())
    sizes = rows.select("doc_id", "h", F.length("text").alias("size")).join(known, "doc_id").groupBy("doc_id", "h").agg(F.max("size").alias("size"), F.max("toxic").alias("toxic"))
    sizes = stored(sizes.withColumn("draw", F.xxhash64("doc_id", "h")), "toxicity-sizes")
    by_class = Window.partitionBy("toxic").orderBy("draw", "doc_id", "h")
    # The first of many are looked for among those with small hashes: some eight times as many as asked for.
    likely = sizes.join(F.broadcast(sizes.groupBy("toxic").count()), "toxic").where(below(F.col("draw"), 8 * (docs_per_class + 32) / F.col("count")))
    first = stored(likely.withColumn("n", F.row_number().over(by_class)).where(F.col("n") <= docs_per_class), "toxicity-candidates")
    before = F.coalesce(F.sum("size").over(by_class.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    chosen = first.withColumn("upto", before).where((F.col("n") == 1) | (F.col("upto") <= chars)).select("doc_id", "h", "toxic")
    found = rows.join(F.broadcast(stored(chosen, "toxicity-chosen")), ["doc_id", "h"])  # at most 2 * docs_per_class rows
    return found.groupBy("doc_id", "h").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")).select("doc_id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame, docs_per_class: int = DOCS_PER_CLASS, chars: int = CLASS_CHARS) -> Model:
    """Fit on a bounded sample (see ``sample``) of the labelled rows that are not held out.

    Without labels of both classes every document scores like the only class
    there is (no labels: not toxic).
    """
    rows = sorted((crc32(f"{r.doc_id}".encode()), r.doc_id, r.text, int(r.toxic)) for r in sample(docs, labels, docs_per_class, chars).collect())
    if not rows:
        return Model({}, -20.0)
    return fit([r[2] for r in rows], [r[3] for r in rows])


def sentence_scores(model: Model, weights: WordWeights, text: str) -> list[tuple[int, int, float]]:
    """(start, end, logit) of each sentence; code points, end exclusive."""
    bias, get = model.bias, weights.__getitem__
    return [(*m.span(), bias + sum(map(get, m[0].lower().split()))) for m in _SENTENCE.finditer(text)]


def noisy_or(logits) -> float:
    return -math.expm1(-sum(math.log1p(math.exp(z)) if z < 30 else z for z in logits))


_FOUND = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("sentences", T.ArrayType(T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])))])
_ARROW = pa.struct([("score", pa.float64()), ("sentences", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))])


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Score every whole text and locate its offending sentences.

    Returns a struct ``row`` (the ``keep`` columns, by default all), ``score``
    (0 to 1) and ``sentences``: those with a probability of 0.5 or more, or the
    likeliest one where only the noisy-or reaches it.

    A null or empty text scores 0. Repeated rows each get a row, null doc_ids
    stay, other columns travel inside ``row`` whatever their names, an empty
    table gives no rows.
    """
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.select(F.col("text").alias("text"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))

    def run(batches):
        known = shared.value
        weights = WordWeights(known)
        for batch, texts in slices(batches):
            found = []
            for t in texts:
                each = sentence_scores(known, weights, t.decode()) if t else []
                total = noisy_or(z for _, _, z in each)
                bad = [x for x in each if x[2] >= 0] if total >= 0.5 else []
                if total >= 0.5 and not bad:
                    bad = [max(each, key=lambda x: x[2])]
                found.append({"score": total, "sentences": [{"start": a, "end": b, "score": 1 / (1 + math.exp(-min(z, 30.0)))} for a, b, z in bad]})
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, _ARROW)], names=["row", "found"])

    out = map_texts(d, run, T.StructType([d.schema["row"], T.StructField("found", _FOUND)]))
    return out.select("row", "found.score", "found.sentences")


def predicted(score_col="score") -> Column:
    return (F.col(score_col) >= 0.5).cast("int")
