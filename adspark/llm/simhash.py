"""Near-duplicates by SimHash and pivot distance tables.

A fingerprint has a bit for each of 64 places; two texts are linked when their
fingerprints differ in at most ``max_bits``. Candidates are found exactly: cut
into ``max_bits + 3`` blocks, two such fingerprints agree on at least three
whole blocks, so every choice of three blocks is a key. Within a key, a table
of Hamming distances to reference fingerprints (pivots) discards a pair when
any of its coordinates differs by more than ``max_bits`` (the triangle
inequality), and the survivors are verified bit by bit.

Only distinct fingerprints are compared, and a key gives a spanning forest and
not its pairs. Of a key with many fingerprints the other bits are cut into
``max_bits + 1`` sub-blocks: two linked fingerprints agree on at least one, so
key and sub-block together are an exact key again, with far fewer fingerprints.
One that still has many is cut into chunks whose pairs of chunks are separate
groups; only there the work grows with the square of its fingerprints.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adspark.llm.graph import components
from adspark.llm.text import map_texts, mix64, slices, stored

SHINGLE = 3
MAX_BITS = 3
SEED = 42
CHUNK = 2048
#: Reference fingerprints.
PIVOTS = mix64(np.arange(1, 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """Majority of the bits of the shingles' XXH64 (seed 42); zero without words."""
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[i:i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """A struct ``row`` (the ``keep`` columns, by default all) and ``fp`` (a signed long) per document.

    A-Z are lowered, words are ``[^\\x20\\x09-\\x0D]+``, a text of fewer words
    than a shingle is one shingle, and a null or wordless text has fingerprint
    zero. Repeated rows each get a row; an empty table gives none.
    """
    keep = docs.columns if keep is None else keep
    d = docs.select(F.col("text").alias("text"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))

    def run(batches):
        for batch, texts in slices(batches):
            fps = [fingerprint(t.lower().split() if t else [], shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["row", "fp"])

    return map_texts(d, run, T.StructType([d.schema["row"], T.StructField("fp", T.LongType())]))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _block_masks(max_bits: int) -> list[tuple[int, list[int]]]:
    """Of each choice of three blocks the mask, and the masks of the ``max_bits + 1`` sub-blocks of the other bits."""
    n = max_bits + 3
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    out = []
    for chosen in combinations(blocks, 3):
        mask = sum(chosen)
        rest = [bit for bit in range(64) if not mask >> bit & 1]
        edges = [len(rest) * i // (max_bits + 1) for i in range(max_bits + 2)]
        out.append((_signed(mask), [_signed(sum(1 << bit for bit in rest[a:b])) for a, b in zip(edges, edges[1:])]))
    return out


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index each of ``n`` nodes reaches over the pairs (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        while (jump := root[root]).tobytes() != root.tobytes():
            root = jump
        if (root[a] == root[b]).all():
            return root


def link_group(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the linked fingerprints within each run of equal keys."""
    table = np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    at, step = np.arange(len(keys)), 1
    while True:
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        near = at[np.abs(table[at] - table[at + step]).max(axis=1) <= max_bits]
        near = near[np.bitwise_count(fps[near] ^ fps[near + step]) <= max_bits]
        left.append(near)
        right.append(near + step)
        step += 1
    a, b = np.concatenate(left), np.concatenate(right)
    if not len(a):
        return fps[:0], fps[:0]
    root = _forest(len(fps), a, b)
    own = np.flatnonzero(root != np.arange(len(fps)))
    return fps[own], fps[root[own]]


def links(distinct: DataFrame, max_bits: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct ``fp`` values within ``max_bits`` of each other."""
    masks = _block_masks(max_bits)
    masked = lambda m: F.col("fp").bitwiseAND(F.lit(m).cast("long"))
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.xxhash64(F.lit(i), masked(m)).alias("key")) for i, (m, _) in enumerate(masks)]))
    keyed = distinct.select("fp", keys.alias("k")).select("fp", "k.*")
    hot = stored(keyed.groupBy("key").count().where(F.col("count") > 2 * chunk).select("key", F.lit(True).alias("hot")), "hot-keys")
    keyed = keyed.join(hot, "key", "left")
    cold = keyed.where("hot IS NULL").select("key", "fp")
    subs = F.array(*[F.array(*[masked(m) for m in rest]) for _, rest in masks])
    sub = keyed.where("hot").select("key", "fp", F.posexplode(F.get(subs, F.col("choice"))).alias("place", "bits")).select(F.xxhash64("key", "place", "bits").alias("key"), "fp")

    crowded = sub.groupBy("key").count().where(F.col("count") > 2 * chunk)
    crowded = stored(crowded.select("key", F.ceil(F.col("count") / chunk).alias("parts")), "crowded-keys")
    sub = sub.join(crowded, "key", "left").withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("parts")))
    sub = (sub.withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long")))
                                             .otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))))
           .select(F.when(F.col("parts").isNull(), F.col("key")).otherwise(
               F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))).alias("key"), "fp"))
    keyed = cold.unionByName(sub)

    def run(batches):
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            keys, fps = np.concatenate([keys, k]), np.concatenate([fps, f])
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            yield from out(*link_group(keys[:whole], fps[:whole], max_bits))
            keys, fps = keys[whole:], fps[whole:]
        yield from out(*link_group(keys, fps, max_bits))

    def out(a, b):
        if len(a):
            pairs = np.unique(np.stack([a.view(np.int64), b.view(np.int64)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def classes(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, text_hash, fp, component (a fingerprint) and component_id of every document.

    component_id is the smallest doc_id reachable over links (null when the
    class has only null ids); ``component`` names the class itself. Repeated
    rows each get a row; see ``fingerprints`` for empty texts.
    """
    keyed = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    fps = stored(fingerprints(keyed, shingle, ["doc_id", "text_hash"]).select("row.*", "fp"), "fingerprints")
    each = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(each.select("fp"), max_bits))
    each = each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("root", "fp"))
    each = stored(each.select("fp", "component", "low"), "classes")
    ids = each.groupBy("component").agg(F.min("low").alias("component_id"))
    return fps.join(each.select("fp", "component").join(ids, "component"), "fp")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each class: the smallest doc_id (nulls last), then the smallest text hash.

    Returns the columns of ``docs``; identical rows count once.
    """
    found = classes(docs, shingle, max_bits)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = found.groupBy("component").agg(F.min(order).alias("first")).select("first.doc_id", "first.text_hash")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64("text").alias("text_hash"))
    first = first.select(F.col("doc_id").alias("f_doc"), F.col("text_hash").alias("f_hash"))
    kept = rows.join(first, F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("text_hash") == F.col("f_hash")), "left_semi")
    return kept.dropDuplicates(["doc_id", "text_hash"]).select("row.*")
