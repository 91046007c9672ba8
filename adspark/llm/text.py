"""Shared helpers: reading tables, shared-folder tables, word and hash arrays.

Text passes run as ``mapInArrow`` over the document scan: a task sees its own
rows only, streams batches, and works on slices of about ``SLICE_BYTES`` of
text, so its memory does not depend on the size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adspark.session import shared_path

SPACE = r"[\x20\x09-\x0D]"
BATCH_BYTES = 8 << 20
SLICE_BYTES = 2 << 20
MEMO_WORDS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back (cuts lineage)."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_words(text="text") -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text (null: 0)."""
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACE + "+"), "")), F.lit(0)).cast("long")


def held_out(doc_id="doc_id") -> Column:
    """Rows never learned from: crc32 of the doc_id as text is divisible by 5 (null ids: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def below(hashed: Column, rate: Column) -> Column:
    """Whether a 64-bit hash lies in the lowest ``rate`` of all values."""
    return hashed.cast("double") / F.lit(float(1 << 64)) + F.lit(0.5) < rate


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def slices(batches, text_at: int = 0, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Parts of the batches with about ``limit`` bytes of text each, and their texts."""
    for batch in batches:
        column = batch.column(text_at)
        held = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64) + 64)
        first = 0
        while first < len(column):
            done = held[first - 1] if first else 0
            last = min(int(np.searchsorted(held, done + limit)) + 1, len(column))
            yield batch.slice(first, last - first), as_bytes(column.slice(first, last - first))
            first = last


def map_texts(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` for rows with texts: batches are bounded by bytes, not only by a number of rows.

    The bound is a setting of the session (Spark has no other place for it); it
    changes the size of batches, never a result.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


class WordHashes(dict):
    """Memo of XXH64 by word; emptied when full, so its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` word hashes; empty when there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    c = 0x9E3779B97F4A7C15
    for j in range(k):
        out += h[j:j + n] * np.uint64(c)
        c = (c * 0xD1342543DE82EF95 + 2) % 2**64 | 1
    return mix64(out)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` neighbours; empty when there are fewer."""
    if len(a) < w:
        return a[:0]
    span = 1
    while 2 * span <= w:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    return np.minimum(a[:len(a) - (w - span)], a[w - span:]) if span < w else a
