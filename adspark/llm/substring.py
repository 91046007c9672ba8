"""Exact substring dedup by compaction of a de Bruijn graph of tokens, in sparse form.

The graph's edges are k-mers of words. A window of 50 words holds 41 runs of 10
words; the one with the smallest hash is the window's anchor, and neighbouring
windows with the same anchor are one edge of the sparse graph (a run of k-mers
kept together by its minimizer): its words, and where it starts. The anchor
follows from the window's words alone, so equal windows have equal anchors, and
only edges whose anchor occurs in several documents matter.

Where the edges of an anchor differ, the graph branches: the text at the source
coordinates of each distinct edge is read again and its single windows are
compared. The other repeated edges are linked to the edge that follows them in
their documents. A link that all occurrences of both its edges share does not
branch; such links are compacted into paths by joins that double the reach of a
pointer each round, so a passage that many documents share ends as one row,
whatever its length. A path is read again at the coordinates of its first
occurrence, and a span is removed only if its own words have the same digest.

Joins carry hashes and coordinates; whole texts are shuffled for the second
reading of sources and for the removal, in proportion to the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adspark.llm.text import WordHashes, gram_hashes, map_texts, slices, sliding_min, stored

WINDOW = 50
ANCHOR = 10
_PLACE = (1 << 30) - 1


def paths_of(lists: list[list[bytes]], memo: WordHashes, window: int, anchor: int):
    """Paths of some documents: document, first window, windows, anchor, hash of the words (arrays)."""
    starts = np.cumsum([0] + [len(x) for x in lists])
    words = [w for x in lists for w in x]
    grams = gram_hashes(memo.of(words), anchor)
    # The place breaks ties to the left and tells where the smallest is.
    low = sliding_min((grams & ~np.uint64(_PLACE)) | (np.arange(len(grams), dtype=np.uint64) & np.uint64(_PLACE)), window - anchor + 1)
    doc = np.repeat(np.arange(len(lists)), np.diff(starts))[:len(low)]
    first = np.flatnonzero(np.arange(len(low)) + window <= starts[doc + 1])
    if not len(first):
        return tuple(np.empty(0, np.int64) for _ in range(5))
    at = (low[first] & np.uint64(_PLACE)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (first[1:] != first[:-1] + 1)])
    p, n = first[new], np.diff(np.r_[new, len(first)])
    said = [xxhash.xxh3_64_intdigest(b" ".join(words[a:b])) for a, b in zip(p.tolist(), (p + n + window - 1).tolist())]
    return doc[p], p - starts[doc[p]], n, grams[at[new]].view(np.int64), np.array(said, np.uint64).view(np.int64)


def _paths(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(doc_id, text_hash, start, n, anchor, said) of every path."""

    def run(batches):
        memo = WordHashes()
        for batch, texts in slices(batches):
            d, start, n, a, said = paths_of([t.split() if t else [] for t in texts], memo, window, anchor)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(pa.array(d)), batch.column(2).take(pa.array(d)), pa.array(start.astype(np.int32)),
                 pa.array(n.astype(np.int32)), pa.array(a), pa.array(said)], names=["doc_id", "text_hash", "start", "n", "anchor", "said"])

    return map_texts(docs, run, "doc_id long, text_hash long, start int, n int, anchor long, said long")


def digest(words: list[bytes]) -> str:
    """128 bits of the words, joined by spaces."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).hexdigest()


def _read_again(docs: DataFrame, branching: DataFrame, paths: DataFrame, window: int) -> DataFrame:
    """What stands at the sources ``rep`` of edges and paths, from one pass over their texts.

    (anchor, said, i, win, digest): a row per single window of the branching
    edges, and a row with the digest of each path (i null). Rows that repeat a
    source's id and text are read once.
    """
    place = F.struct("anchor", "said", F.col("rep.start").alias("start"), "n", "single")
    wanted = branching.withColumn("single", F.lit(True)).unionByName(paths.withColumn("single", F.lit(False)), allowMissingColumns=True)
    lists = wanted.groupBy("rep.doc_id", "rep.text_hash").agg(F.collect_list(place).alias("places"))
    keys = ["doc_id", "text_hash"]
    rows = docs.join(lists.hint("shuffle_hash"), keys).groupBy(*keys).agg(F.first("text").alias("text"), F.first("places").alias("places"))

    def run(batches):
        for batch, texts in slices(batches):
            out: tuple[list, ...] = ([], [], [], [], [])
            for t, places in zip(texts, batch.column(1).to_pylist()):
                words = t.split()
                for x in places:
                    p = x["start"]
                    found = [(i, xxhash.xxh3_64_intdigest(b" ".join(words[p + i:p + i + window])), None) for i in range(x["n"])] if x["single"] \
                        else [(None, 0, digest(words[p:p + x["n"] + window - 1]))]
                    for f in found:
                        for o, v in zip(out, (x["anchor"], x["said"], *f)):
                            o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()),
                                              pa.array(np.array(out[3], np.uint64).view(np.int64)), pa.array(out[4], pa.string())],
                                             names=["anchor", "said", "i", "win", "digest"])

    return map_texts(rows.select("text", "places"), run, "anchor long, said long, i int, win long, digest string")


def compacted(occurrences: DataFrame, edges: DataFrame) -> DataFrame:
    """Repeated non-branching paths: the edges at their heads, with ``n`` the windows of the whole path.

    ``edges`` has anchor, said, n and ``rep`` (the first occurrence);
    ``occurrences`` all places (doc_id, text_hash, start, n) of those edges. An
    edge is linked to the next if every occurrence of the one is followed by
    the other and every occurrence of the other follows the one. Such links
    form chains (a cycle would need an endless text). Each round an edge that
    is not at a chain's end takes over its partner's reach, so the rounds grow
    with the logarithm of the longest chain.
    """
    left = occurrences.select("doc_id", "text_hash", (F.col("start") + F.col("n")).alias("at"), F.struct("anchor", "said").alias("a"))
    right = occurrences.select("doc_id", "text_hash", F.col("start").alias("at"), F.struct("anchor", "said").alias("b"))
    links = left.join(right, ["doc_id", "text_hash", "at"]).groupBy("a", "b").agg(F.count("*").alias("together"))
    often = stored(occurrences.groupBy(F.struct("anchor", "said").alias("e")).agg(F.count("*").alias("times")), "edge-counts")
    links = stored(links, "links")
    unary = (links.join(often.select(F.col("e").alias("a"), "times"), "a").where("times = together").drop("times")
             .join(often.select(F.col("e").alias("b"), "times"), "b").where("times = together").select("a", "b"))
    # For each edge: the edge that its reach ends before (null: the chain ends), and the windows within its reach.
    reach = edges.select(F.struct("anchor", "said").alias("e"), F.col("n").cast("long").alias("n")).join(unary.select(F.col("a").alias("e"), F.col("b").alias("to")), "e", "left")
    reach = stored(reach, "reach")
    heads = stored(reach.join(reach.select(F.col("to").alias("e")).where("to IS NOT NULL"), "e", "left_anti").select("e"), "heads")
    open_ends = reach.where("to IS NOT NULL").count()
    while open_ends:
        ahead = reach.select(F.col("e").alias("to"), F.col("to").alias("far"), F.col("n").alias("more"))
        moved = reach.join(ahead, "to").select("e", F.col("far").alias("to"), (F.col("n") + F.col("more")).alias("n"))
        reach = stored(moved.unionByName(reach.where("to IS NULL")), "reach")
        open_ends = reach.where("to IS NOT NULL").count()
    paths = heads.join(reach, "e").select(F.col("e.anchor").alias("anchor"), F.col("e.said").alias("said"), F.col("n").cast("int").alias("n"))
    return edges.drop("n").join(paths, ["anchor", "said"])


def repeated(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, text_hash, spans): words covered by windows that a smaller doc_id also holds.

    ``docs`` has text, doc_id and text_hash, without null ids. A span has
    start, end and the digest that its words must have (null: windows that were
    compared one by one). Rows that repeat id and text have one list.
    """
    docs = docs.select("text", "doc_id", "text_hash")
    found = stored(_paths(docs, window, anchor), "edges")
    # Written before they are joined: Spark splits a hot key of a join only where both sides are plain shuffles.
    shared = stored(found.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor"), "shared-anchors")
    found = found.join(shared, "anchor").groupBy("doc_id", "text_hash", "start").agg(*[F.first(c).alias(c) for c in ("n", "anchor", "said")])
    found = stored(found, "shared-edges")
    each = stored(found.groupBy("anchor", "said").agg(F.min(F.struct("doc_id", "text_hash", "start")).alias("rep"), F.max("doc_id").alias("last"), F.first("n").alias("n")), "distinct-edges")
    forks = stored(each.groupBy("anchor").agg(F.count("*").alias("ways")).where("ways > 1").select("anchor"), "forks")

    # Where the graph does not branch, repeated edges are compacted into paths.
    straight = stored(each.where("rep.doc_id < last").join(forks, "anchor", "left_anti"), "straight")
    lone = stored(found.join(straight.select("anchor", "said"), ["anchor", "said"], "left_semi"), "straight-places")
    paths = stored(compacted(lone, straight).select("anchor", "said", "rep", "n"), "paths")
    branching = stored(each.join(forks, "anchor", "left_semi"), "branching")
    read = stored(_read_again(docs, branching, paths, window), "sources")
    digests = read.where("i IS NULL").select("anchor", "said", "digest")
    paths = stored(paths.join(digests, ["anchor", "said"]).select("anchor", "said", F.col("rep.doc_id").alias("first"), F.col("n").alias("windows"), "digest"), "paths")

    # Elsewhere single windows decide.
    wins = read.where("i IS NOT NULL").select("anchor", "said", "i", "win").join(branching.select("anchor", "said", F.col("rep.doc_id").alias("first"), "last"), ["anchor", "said"])
    wins = stored(wins, "windows")
    low = stored(wins.groupBy("anchor", "win").agg(F.min("first").alias("low")), "first-windows")
    branched = (wins.join(low, ["anchor", "win"]).where("low < last").groupBy("anchor", "said")
                .agg(F.collect_list(F.struct("i", F.col("low").alias("first"))).alias("windows")))

    span = lambda a, b, d: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), d.alias("digest"))
    none = F.lit(None).cast("string")
    whole = lone.select("doc_id", "text_hash", "start", "anchor", "said").join(paths, ["anchor", "said"]).where("first < doc_id").select(
        "doc_id", "text_hash", F.array(span(F.col("start"), F.col("start") + F.col("windows") + (window - 1), F.col("digest"))).alias("spans"))
    some = F.transform(F.filter("windows", lambda w: w["first"] < F.col("doc_id")), lambda w: span(F.col("start") + w["i"], F.col("start") + w["i"] + window, none))
    parts = found.join(stored(branched, "branched"), ["anchor", "said"]).select("doc_id", "text_hash", some.alias("spans")).where(F.size("spans") > 0)
    return whole.unionByName(parts).groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("spans")).alias("spans"))


_DONE = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                      T.StructField("kept", T.StringType()), T.StructField("kept_sha256", T.StringType())])


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, ``kept`` (the words left, joined by a space; null if not ``with_text``) and its SHA-256.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes if a window of
    ``window`` words that covers it also starts in a document with a smaller
    doc_id; windows are judged on the input.

    A null text has no words. A null doc_id is smaller than none and no id is
    smaller than it: such rows keep all words and remove none. Rows that share
    a doc_id do not remove each other's words. Other columns are ignored; an
    empty table gives no rows.
    """
    rows = docs.select(F.col("text").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    known = rows.where("doc_id IS NOT NULL")
    spans = repeated(known, window, anchor)
    joined = known.join(spans.hint("shuffle_hash"), ["doc_id", "text_hash"], "left").select("text", "doc_id", "spans")
    nulls = rows.where("doc_id IS NULL").select("text", "doc_id", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))

    def run(batches):
        for batch, texts in slices(batches):
            out = []
            for t, cuts in zip(texts, batch.column(2).to_pylist()):
                words = t.split() if t else []
                kept, upto = words, 0
                if cuts:
                    kept = []
                    same = ((c["start"], c["end"]) for c in cuts if c["digest"] is None or digest(words[c["start"]:c["end"]]) == c["digest"])
                    for a, b in sorted(same):
                        kept += words[upto:a]
                        upto = max(upto, b)
                    kept += words[upto:]
                left = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), left.decode() if with_text else None, hashlib.sha256(left).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))],
                                             names=["doc_id", *_DONE.names])

    return map_texts(joined.unionByName(nulls), run, T.StructType([T.StructField("doc_id", T.LongType()), *_DONE.fields]))
