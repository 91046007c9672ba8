"""Benchmark decontamination by winnowing.

A window of L words is represented by the smallest hash among its k-grams,
k = (L + 1) // 2. Two equal windows have equal smallest k-grams, so every
shared window of L words shares a fingerprint: nothing is missed. Documents and
items are joined on fingerprints, and each hit is extended to its whole window,
compared word by word.

Items of one text are one entry with a list of ids, and the entries are cut
into blocks of about ``block_chars`` characters. One block's fingerprints and
windows are on the driver and broadcast at a time. The documents pass through
the blocks in turn; what a block finds is written, by text, before the next is
built, and the last pass puts it beside its own. A benchmark of one block, the
usual case, needs no shuffle of documents.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adspark.llm.text import WordHashes, as_bytes, gram_hashes, map_texts, slices, sliding_min, stored
from adspark.operators.ordering import running_sum_ranged

WINDOW = 10
BLOCK_CHARS = 2_000_000

#: Lower-cases A-Z, keeps 0-9, a-z and every byte from 0x80 on, and blanks the rest.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
                    for c in range(256))


def item_words(text: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    return text.translate(_WORD_BYTES).split()


def winnow(h: np.ndarray, length: int) -> np.ndarray:
    """Smallest k-gram hash of each window of ``length`` words."""
    k = (length + 1) // 2
    return sliding_min(gram_hashes(h, k), length - k + 1)


class BlockIndex:
    """Fingerprints and windows of one benchmark block, by window length."""

    def __init__(self, items: list[tuple[list[int | None], bytes]], window: int):
        memo = WordHashes()
        prints: dict[int, set[int]] = {}
        self.windows: dict[int, dict[bytes, list[int | None]]] = {}
        for item_ids, text in items:
            words = item_words(text)
            if not words:
                continue
            length = min(window, len(words))
            prints.setdefault(length, set()).update(winnow(memo.of(words), length).tolist())
            known = self.windows.setdefault(length, {})
            for i in range(len(words) - length + 1):
                # A window of one entry shares its list; only a window of several has a list of its own.
                at = b" ".join(words[i:i + length])
                have = known.setdefault(at, item_ids)
                if have is not item_ids:
                    known[at] = list({*have, *item_ids})
        self.prints = {n: np.array(sorted(p), np.uint64) for n, p in prints.items()}

    def hits(self, words: list[bytes], h: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, list]]:
        """(start, end, item ids) of every window occurrence; ``starts`` bounds the documents."""
        found = []
        for length, prints in self.prints.items():
            low = winnow(h, length)
            if not len(low):
                continue
            # Neighbouring windows mostly share their fingerprint: look it up once per run.
            run = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
            at = np.searchsorted(prints, low[run])
            at[at == len(prints)] = 0
            ends = np.r_[run[1:], len(low)]
            known = self.windows[length]
            for r in np.flatnonzero(prints[at] == low[run]):
                for p in range(run[r], ends[r]):
                    ids = known.get(b" ".join(words[p:p + length]))
                    if ids is not None:
                        doc = np.searchsorted(starts, p, "right") - 1
                        if p + length <= starts[doc + 1]:
                            found.append((p, p + length, ids))
        return found


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(_SPAN)),
                       T.StructField("items", T.ArrayType(T.LongType()))])
_ARROW_FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                          ("items", pa.list_(pa.int64()))])


def _scan_block(block):
    """Map over (text, row[, found]) batches: adds this block's hits to ``found``."""

    def run(batches):
        index, memo = block.value, WordHashes()
        for batch, texts in slices(batches):
            lists = [item_words(t) if t else [] for t in texts]
            starts = np.cumsum([0] + [len(x) for x in lists])
            words = [w for x in lists for w in x]
            before = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * len(lists)
            spans = [[(s["start"], s["end"]) for s in b["spans"]] if b else [] for b in before]
            items = [set(b["items"]) if b else set() for b in before]
            for a, b, ids in index.hits(words, memo.of(words), starts):
                d = int(np.searchsorted(starts, a, "right")) - 1
                spans[d].append((a - int(starts[d]), b - int(starts[d])))
                items[d].update(i for i in ids if i is not None)
            found = [{"n_words": len(x), "spans": [{"start": a, "end": b} for a, b in _union(s)], "items": sorted(i)}
                     for x, s, i in zip(lists, spans, items)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, _ARROW_FOUND)],
                                             names=["text", "row", "found"])

    return run


def find_overlaps(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None,
                  window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Words of each document that lie in a window of a benchmark item.

    Returns a struct ``row`` (the ``keep`` columns of ``docs``, by default all),
    ``n_words``, ``spans`` (sorted, disjoint word ranges, end exclusive) and
    ``items`` (sorted distinct item_ids with an occurring window). An item of
    fewer than ``window`` words, but not none, is one window.

    Null or wordless texts have no words and no hits; null or wordless items
    never hit; items with a null id mark words but are not listed; repeated
    rows each get their own result; a null doc_id is kept as it is; an empty
    benchmark hits nothing. Other columns may have any name: they travel inside
    ``row``.
    """
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    out = docs.select(F.col("text").alias("text"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))
    entries = benchmark_entries(benchmark, block_chars)
    blocks = 1 + entries.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0]
    key = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.length("text").alias("chars")]
    passes = []
    for b in range(blocks - 1):
        # Found by the text alone, and only where something is found: a few rows.
        shared = _block_index(entries, b, window)
        texts = out.select("text", F.struct(*key).alias("row"))
        hits = map_texts(texts, _scan_block(shared), _scanned(texts)).where(F.size("found.spans") > 0)
        passes.append(stored(hits.select("row.*", "found").distinct(), "benchmark-hits"))
        shared.unpersist()
    if passes:
        names = ["h1", "h2", "chars"]
        every = reduce(DataFrame.unionByName, passes).groupBy(*names).agg(F.first("found.n_words").alias("n_words"),
            F.flatten(F.collect_list("found.spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("found.items"))).alias("items"))
        before = stored(every.select(*names, F.struct("n_words", "spans", "items").alias("found")), "benchmark-hits")
        out = out.select("*", *key).join(before, names, "left").select("text", "row", "found")
    out = map_texts(out, _scan_block(_block_index(entries, blocks - 1, window)), _scanned(out))
    return out.select("row", "found.n_words", "found.spans", "found.items")


def benchmark_entries(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(text, item_ids, block): a row per distinct text, packed into blocks of about ``block_chars`` characters.

    An id counts as eight characters; an entry longer than a block has one of its own.
    """
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    rows = items.groupBy("text").agg(F.collect_set("item_id").alias("item_ids"), F.max(F.col("item_id").isNull()).alias("unnamed"))
    rows = stored(rows.select("text", F.when(F.col("unnamed"), F.concat("item_ids", F.array(F.lit(None).cast("long")))).otherwise(F.col("item_ids")).alias("item_ids"),
                              F.xxhash64("text").alias("h"), (F.length("text") + 8 * F.size("item_ids")).cast("double").alias("size")), "benchmark-entries")
    upto = running_sum_ranged(rows, ["h", "text"], "size", out_col="upto")
    return stored(upto.select("text", "item_ids", F.floor((F.col("upto") - F.col("size")) / block_chars).cast("int").alias("block")), "benchmark-blocks")


def _block_index(entries: DataFrame, block: int, window: int):
    """One block's index, broadcast."""
    got = entries.where(F.col("block") == block).select("item_ids", "text").toArrow()
    index = BlockIndex(list(zip(got.column(0).to_pylist(), as_bytes(got.column(1)))), window)
    return entries.sparkSession.sparkContext.broadcast(index)


def _scanned(rows: DataFrame) -> T.StructType:
    return T.StructType([rows.schema["text"], rows.schema["row"], T.StructField("found", _FOUND)])


def n_hit(spans="spans"):
    """Number of words in the spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]).cast("long"))
