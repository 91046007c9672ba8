"""A blocked Bloom filter as a table: which rows can match a set of keys at all.

The filter is an aggregate over the keys. A key hashes to one block of
``BLOCK_BITS`` bits and to a few bits in it; a row per block holds the block's
words. It is far smaller than the keys (``BITS_PER_KEY`` bits each) and is
joined by its block number, broadcast once its size is known to fit. A row
whose bits are not all set has no match for certain; about one in a hundred
others passes without having one, and the join that follows drops it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 12
BLOCK_BITS = 1 << 14
HASHES = 5
MAX_FILTER_BYTES = 256 << 20
_WORDS = BLOCK_BITS // 64


def n_blocks(n_keys: int, bits_per_key: int = BITS_PER_KEY) -> int:
    return max(1, -(-n_keys * bits_per_key // BLOCK_BITS))


def filter_bytes(n_keys: int, bits_per_key: int = BITS_PER_KEY) -> int:
    """Size of the filter of so many keys."""
    return n_blocks(n_keys, bits_per_key) * BLOCK_BITS // 8


def _block(keys: list[Column], blocks: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int")


def _bits(keys: list[Column]) -> list[Column]:
    """Bit numbers of a key: 14 bits of a second hash each, one more hash for the fifth."""
    span = BLOCK_BITS.bit_length() - 1
    first, second = F.xxhash64(F.lit(1), *keys), F.xxhash64(F.lit(2), *keys)
    per = 64 // span
    return [F.shiftrightunsigned(first if i < per else second, span * (i % per)).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int") for i in range(HASHES)]


def build(keys: DataFrame, cols: list[str], n_keys: int) -> DataFrame:
    """(block, words) of the keys in ``cols``; a block without a key has no row. Null keys match nothing and are left out.

    ``n_keys`` sets the size (an upper bound of the distinct keys, such as the rows).
    """
    on = [F.col(c) for c in cols]
    known = keys.where(reduce(Column.__and__, (c.isNotNull() for c in on)))
    bits = known.select(_block(on, n_blocks(n_keys)).alias("block"), F.explode(F.array(*_bits(on))).alias("bit"))
    words = bits.groupBy("block", F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)))).alias("bits"))
    held = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("held"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(_WORDS - 1)), lambda w: F.coalesce(F.col("held")[w], F.lit(0).cast("long")))
    return held.select("block", dense.alias("words"))


def may_match(df: DataFrame, cols: list[str], table: DataFrame, n_keys: int, out: str = "_may_match") -> DataFrame:
    """``df`` with a boolean: whether the key in ``cols`` may be one of the filter's (false: it is not, null keys included).

    The columns must have the types that the filter was built with, for hashes
    depend on them. The filter is broadcast; ``filter_bytes`` tells its size.
    """
    if filter_bytes(n_keys) > MAX_FILTER_BYTES:
        raise ValueError(f"a filter of {n_keys} keys is larger than {MAX_FILTER_BYTES} bytes: join without it")
    on = [F.col(c) for c in cols]
    d = df.withColumn("_block", F.when(reduce(Column.__and__, (c.isNotNull() for c in on)), _block(on, n_blocks(n_keys))))
    d = d.join(F.broadcast(table.select(F.col("block").alias("_block"), F.col("words").alias("_words"))), "_block", "left")
    word = lambda b: F.get("_words", F.shiftright(b, 6))
    test = [F.call_function("shiftrightunsigned", word(b), b.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) == 1 for b in _bits(on)]
    return d.withColumn(out, F.coalesce(reduce(Column.__and__, test), F.lit(False))).drop("_block", "_words")
