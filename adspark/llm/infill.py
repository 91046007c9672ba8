"""Fill-in-the-middle: every text is cut in three and its parts are reordered.

A text is a run of units (``[A-Za-z]+|[^A-Za-z]``), and two drawn unit numbers
are where it is cut. A Fenwick tree over fixed blocks of the text's bytes holds
how many units and how many code points start in each block. Descending it by
binary lifting finds the block that holds the cut unit, and its code points so
far; only that block is then looked into. So a text's cuts cost one pass of
byte flags and two look-ups, however long the text is.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adspark.llm.text import map_texts, slices

BLOCK = 1024
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 texts, those that stay plain, and of 100 others those that give the suffix first.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
SEED = 1


class BlockTree:
    """Fenwick tree over the (units, code points) that start in each block."""

    def __init__(self, units: list[int], points: list[int]):
        self.n = len(units)
        self.units, self.points = [0, *units], [0, *points]
        for tree in (self.units, self.points):
            for i in range(1, self.n + 1):
                up = i + (i & -i)
                if up <= self.n:
                    tree[up] += tree[i]

    def find(self, unit: int) -> tuple[int, int, int]:
        """(block, units before it, code points before it) of the block where unit number ``unit`` (from 0) starts."""
        at, units, points, step = 0, 0, 0, 1 << self.n.bit_length() - 1
        while step:
            to = at + step
            if to <= self.n and units + self.units[to] <= unit:
                at, units, points = to, units + self.units[to], points + self.points[to]
            step >>= 1
        return at, units, points


def starts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the bytes of all texts, joined: a unit starts here; a code point starts here."""
    b = np.frombuffer(b"".join(texts), np.uint8)
    point = (b & 0xC0) != 0x80
    letter = ((b | 0x20) - np.uint8(97)) < 26
    inside = np.zeros(len(b), bool)
    inside[1:] = letter[1:] & letter[:-1]
    first = np.cumsum([0] + [len(t) for t in texts[:-1]])
    inside[first[first < len(b)]] = False
    return point & ~inside, point


class Cuts:
    """Where units of one text start: ``unit`` and ``point`` are the flags of its bytes."""

    def __init__(self, unit: np.ndarray, point: np.ndarray, block: int = BLOCK):
        self.unit, self.point, self.block = unit, point, block
        edges = np.arange(0, len(unit), block)
        sums = lambda a: np.add.reduceat(a, edges, dtype=np.int64).tolist() if len(a) else []
        units, points = sums(unit), sums(point)
        self.n, self.n_points, self.tree = sum(units), sum(points), BlockTree(units, points)

    def place(self, k: int) -> tuple[int, int]:
        """(byte, code point) where unit ``k`` starts; the text's end for the number of units."""
        if k >= self.n:
            return len(self.unit), self.n_points
        at, units, points = self.tree.find(k)
        lo = at * self.block
        own = int(np.flatnonzero(self.unit[lo:lo + self.block])[k - units])
        return lo + own, points + int(np.count_nonzero(self.point[lo:lo + own]))


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, ...]:
    """Four numbers below 2**32, from the document's id alone."""
    text = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(text[8 * i:8 * i + 8], 16) for i in range(4))


def arrange(text: bytes, form: str, a: int, b: int) -> bytes:
    """The text cut at bytes ``a`` and ``b``, in the order of the form."""
    if form == "psm":
        return b"".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))
    if form == "spm":
        return b"".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))
    return text


def restore(output: bytes, form: str) -> bytes:
    """The text that ``arrange`` was given; no text with a mark in it is ever cut, so the first marks are the marks."""
    if form == "plain":
        return output
    left, right = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    first, _, rest = output.removeprefix(left).partition(right)
    second, _, middle = rest.partition(MIDDLE)
    return first + middle + second if form == "psm" else second + middle + first


_FIELDS = [("n", T.LongType(), pa.int64()), ("form", T.StringType(), pa.string()), ("prefix_chars", T.LongType(), pa.int64()),
           ("middle_chars", T.LongType(), pa.int64()), ("output", T.StringType(), pa.string())]


def transform(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars and ``output`` of every text.

    Of four numbers drawn from the doc_id, the first two modulo n + 1 are the
    units at which the text is cut, the third says whether it stays plain, the
    fourth in what order the parts go. An empty text and one that holds a mark
    stay plain, and the lengths of a plain text's parts are null.

    A null text is an empty one. Repeated rows each get a row; rows with the
    same doc_id draw the same numbers, a null doc_id draws those of an empty
    id. Other columns are ignored, an empty table gives no rows.
    """
    d = docs.select(F.col("text").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))

    def run(batches):
        for batch, texts in slices(batches):
            texts = [t or b"" for t in texts]
            unit, point = starts(texts)
            out, at = [], 0
            for t, doc_id in zip(texts, batch.column(1).to_pylist()):
                cuts = Cuts(unit[at:at + len(t)], point[at:at + len(t)], block)
                at += len(t)
                h1, h2, h3, h4 = draws(doc_id, seed)
                if not t or h3 % 100 >= 100 - PLAIN_PERCENT or any(m in t for m in (PREFIX, SUFFIX, MIDDLE)):
                    out.append((cuts.n, "plain", None, None, t.decode()))
                    continue
                form = "spm" if h4 % 100 < SPM_PERCENT else "psm"
                (a, a_points), (b, b_points) = map(cuts.place, sorted((h1 % (cuts.n + 1), h2 % (cuts.n + 1))))
                out.append((cuts.n, form, a_points, b_points - a_points, arrange(t, form, a, b).decode()))
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array([r[i] for r in out], kind) for i, (_, _, kind) in enumerate(_FIELDS))],
                                             names=["doc_id", *(name for name, _, _ in _FIELDS)])

    return map_texts(d, run, T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(n, k) for n, k, _ in _FIELDS)]))


def restored(rows: DataFrame) -> DataFrame:
    """``rows`` of ``transform`` with ``restored``: the text rebuilt from ``output`` and ``form`` alone."""
    keep = [c for c in rows.columns if c != "output"]

    def run(batches):
        for batch, outputs in slices(batches):
            forms = batch.column(1).to_pylist()
            back = pa.array([restore(o, f).decode() for o, f in zip(outputs, forms)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[1:], back], names=[*batch.schema.names, "restored"])

    d = rows.select("output", "form", *[c for c in keep if c != "form"])
    return map_texts(d, run, T.StructType([*d.schema.fields, T.StructField("restored", T.StringType())]))
