"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text gives a vector of transformed statistics (lengths, repetition, shares
of character classes). Each class of the labels is a Gaussian over them: its
mean, and its covariance shrunk towards the covariance of both classes and
towards a diagonal. A text's score is the class odds, the difference of the
log densities, each a Mahalanobis distance by the class's cached Cholesky
factor.

Statistics are rounded to 1/1024, so the sums that make up means and
covariances are integers: Spark adds them over all labelled rows, and they come
out alike however the rows are dealt out. The driver gets one row per class.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adspark.llm.text import held_out, map_texts, slices, stored

UNIT = 1024
#: Share of the pooled covariance in each class's, and of the diagonal's mean in that.
POOLED, RIDGE = 0.1, 0.02
THRESHOLD = 0.3

#: Added to the total that a share is of, so that a few words say little.
PRIOR = 20

#: Classes of bytes that are counted; a byte that starts a code point above ASCII is ``other``.
BYTE_CLASSES = ["upper", "lower", "digit", "stop", "comma", "symbol", "mark", "line", "other"]
NAMES = ["words", "word_length", "longest_word", "repetition", "neighbours", "repeated_lines",
         "symbols", "marks", "digits", "upper", "stops", "commas", "lines", "other"]


def _byte_classes() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    members = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "stop": b".!?", "comma": b",;:",
               "symbol": b"#*$%&|<>@^~{}[]\\/_=+", "mark": b"\"'()-`", "line": b"\n", "other": range(0xC0, 0x100)}
    for at, name in enumerate(BYTE_CLASSES, 1):
        kind[list(members[name])] = at
    return kind


_KIND = _byte_classes()


def class_counts(texts: list[bytes]) -> np.ndarray:
    """How many bytes of each class every text has (rows: texts)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    kind = _KIND[np.frombuffer(b"".join(texts), np.uint8)]
    doc = np.repeat(np.arange(len(texts)), sizes)
    width = len(BYTE_CLASSES) + 1
    return np.bincount(doc * width + kind, minlength=len(texts) * width).reshape(-1, width)[:, 1:]


def statistics_of(texts: list[bytes]) -> np.ndarray:
    """Transformed statistics of each text, in units of 1/``UNIT`` (integers)."""
    counts = dict(zip(BYTE_CLASSES, class_counts(texts).T.astype(float)))
    size = np.array([len(t) for t in texts], float)
    raw = np.zeros((len(texts), 6))
    for i, t in enumerate(texts):
        words = t.split()
        if not words:
            continue
        lines = [x for x in t.split(b"\n") if x]
        raw[i] = (len(words), sum(map(len, words)), max(map(len, words)), len(set(words)), sum(map(eq, words, words[1:])), len(lines) - len(set(lines)))
    n, held, longest, distinct, neighbours, repeated = raw.T
    per = lambda x, total: np.sqrt(x / (total + PRIOR))
    letters = counts["upper"] + counts["lower"]
    found = {"words": np.log1p(n), "word_length": np.log1p(held / np.maximum(n, 1)), "longest_word": np.log1p(longest),
             "repetition": np.log1p(n) - np.log1p(distinct), "neighbours": per(neighbours, n), "repeated_lines": per(repeated, counts["line"] + 1),
             "symbols": per(counts["symbol"], size), "marks": per(counts["mark"], size), "digits": per(counts["digit"], size),
             "upper": per(counts["upper"], letters), "stops": per(counts["stop"], n), "commas": per(counts["comma"], n),
             "lines": per(counts["line"], n), "other": per(counts["other"], size)}
    return np.rint(np.column_stack([found[k] for k in NAMES]) * UNIT).astype(np.int64)


def statistics(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``row`` (a struct of the ``keep`` columns, by default all), ``doc_id`` and ``stats`` of every whole text.

    ``stats`` are integers in units of 1/1024, in the order of ``NAMES``. A null
    or empty text has zeros. Repeated rows each get a row, null doc_ids stay,
    other columns travel inside ``row`` whatever their names, an empty table
    gives no rows.
    """
    keep = docs.columns if keep is None else keep
    d = docs.select(F.col("text").alias("text"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))

    def run(batches):
        for batch, texts in slices(batches):
            found = statistics_of([t or b"" for t in texts])
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * len(NAMES), pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), values], names=["row", "doc_id", "stats"])

    return map_texts(d, run, T.StructType([*d.schema.fields[1:], T.StructField("stats", T.ArrayType(T.LongType()))]))


@dataclass
class Gaussian:
    """Logarithm of the prior, mean, inverse of the covariance's Cholesky factor, logarithm of that factor's determinant."""

    prior: float
    mean: np.ndarray
    whiten: np.ndarray
    log_det: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        return self.prior - self.log_det - 0.5 * np.square((x - self.mean) @ self.whiten.T).sum(axis=1)


@dataclass
class Model:
    """Gaussians of the classes 0 and 1; without both, every score is ``constant``."""

    bad: Gaussian | None = None
    good: Gaussian | None = None
    constant: float = 1.0

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.bad is None or self.good is None:
            return np.full(len(stats), self.constant)
        x = stats / UNIT
        odds = np.clip(self.good.log_density(x) - self.bad.log_density(x), -700, 700)
        return 1 / (1 + np.exp(-odds))


def discriminant(moments: dict[int, tuple[int, list[int], list[int]]], pooled: float = POOLED, ridge: float = RIDGE) -> Model:
    """Fit from the classes' (rows, sums, sums of products of pairs i <= j), all integers."""
    if len(moments) < 2:
        return Model(constant=float(next(iter(moments), 1)))
    total = sum(n for n, _, _ in moments.values())
    found = {}
    for label, (n, first, second) in moments.items():
        d = len(first)
        # Centred in integers, so nothing cancels.
        spread = np.zeros((d, d))
        for (i, j), s in zip(pairs(d), second):
            spread[i, j] = spread[j, i] = (n * s - first[i] * first[j]) / (n * n) / UNIT**2
        found[label] = (n, np.array([x / n for x in first]) / UNIT, spread)
    both = sum(n * s for n, _, s in found.values()) / total

    def gaussian(label: int) -> Gaussian:
        n, mean, own = found[label]
        cov = (1 - pooled) * own + pooled * both
        cov = (1 - ridge) * cov + ridge * np.eye(len(mean)) * max(np.trace(cov) / len(mean), 1e-6)
        factor = np.linalg.cholesky(cov)
        return Gaussian(float(np.log(n / total)), mean, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()))

    return Model(gaussian(0), gaussian(1))


def pairs(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i, d)]


def train(stats: DataFrame, labels: DataFrame, pooled: float = POOLED, ridge: float = RIDGE) -> Model:
    """Fit on all labelled rows of ``statistics`` that are not held out.

    ``labels`` has doc_id and ``quality`` (0 or 1; other values and nulls do
    not count). A doc_id labelled both ways counts as 0; rows that share a
    doc_id all take its label. Without labels of both classes every document
    scores like the only class there is (no labels: 1).
    """
    known = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality")))
    d = len(NAMES)
    # Written before the join: Spark splits the rows of a hot doc_id only where both sides are plain shuffles.
    known = stored(known, "quality-labels")
    rows = stats.select("doc_id", *[F.col("stats")[i].alias(f"x{i}") for i in range(d)]).join(known, "doc_id")
    sums = rows.groupBy("quality").agg(F.count("*"), *[F.sum(f"x{i}") for i in range(d)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs(d)])
    moments = {r[0]: (r[1], list(r[2:2 + d]), list(r[2 + d:])) for r in sums.collect()}  # two rows at most
    return discriminant(moments, pooled, ridge)


def score(stats: DataFrame, model: Model) -> DataFrame:
    """``row``, ``doc_id`` and ``score`` (0 to 1, higher: label 1 likelier) of every row of ``statistics``."""
    d = stats.select("stats", "row", "doc_id")

    def run(batches):
        for batch in batches:
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(model.score(values))], names=["row", "doc_id", "score"])

    return d.mapInArrow(run, T.StructType([*d.schema.fields[1:], T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``row``, ``doc_id`` and ``score`` of every document, by a model learned from ``labels``.

    The statistics (integers, no texts unless ``keep`` names them) are written
    once and read for the fit and for the scores.
    """
    found = stored(statistics(docs, keep), "quality-statistics")
    return score(found, train(found, labels))


def predicted(score_col="score", threshold: float = THRESHOLD) -> Column:
    return (F.col(score_col) >= threshold).cast("int")
