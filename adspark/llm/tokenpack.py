"""Token ids in binary shards of patched frame-of-reference blocks.

Documents are range-partitioned by doc_id; each task encodes its range and
streams one shard to the shared folder:

    header   magic "TPF1", block length (u32)
    blocks   n ids (u32), base (u32), width (u8), exceptions (u16),
             residuals ``id - base`` packed ``width`` bits each, low bit first,
             exception positions (u16 each) and their high parts (u32 each)
    index    start of each block (u64), doc_id (i64), null flag (u8) and
             number of ids (u64) of each document
    footer   blocks (u64), documents (u64), ids (u64), index start (u64), "TPF1"

The width is the one that a percentile of the block's residuals fits; the bits
above it go to the exception list. A task names its shard uniquely and reports
it when it is complete, so a lost task is simply run again and a half-written
shard is never read. The shards' entries and their places are a table, the
manifest; identical rows cannot be cut by range and go through one task.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adspark.llm.text import map_texts, slices, stored
from adspark.operators.ordering import running_sum_ranged
from adspark.session import shared_path

MAGIC = b"TPF1"
BLOCK_IDS = 4096
PERCENTILE = 98.0
END_ID = 1
#: Documents per range of doc_ids, and ids after which a range goes on in a further shard.
RANGE_DOCS = 1 << 13
SHARD_IDS = 1 << 23
MEMO_WORDS = 600_000

_END = object()
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: What a byte is to a word: 1 a letter a-z, 2 ASCII punctuation, 3 the line end after it, 0 another.
_SHAPE = np.zeros(256, np.uint8)
_SHAPE[97:123] = 1
_SHAPE[list(_PUNCTUATION.encode())] = 2
_SHAPE[10] = 3


def _shapes(joined: np.ndarray) -> tuple[np.ndarray, ...]:
    """Letters a-z, punctuation and bytes of each word of a text with a line end after each, and whether a letter follows punctuation."""
    kind = _SHAPE[joined]
    ends = np.flatnonzero(kind == 3)
    per = lambda flags: np.diff(np.cumsum(flags, dtype=np.int64)[ends], prepend=0)
    after = np.zeros(len(kind), bool)
    after[1:] = (kind[1:] == 1) & (kind[:-1] == 2)
    return per(kind == 1), per(kind == 2), np.diff(ends, prepend=-1) - 1, per(after) > 0


class _Codes(dict):
    """Number of each word, given on first sight; ``new`` lists the words not yet encoded."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, word) -> int:
        code = self[word] = len(self)
        self.new.append(word)
        return code


class WordEncoder:
    """Ids of texts by the tokenizers library, with a bounded memo of words.

    White space always separates pre-tokens of the vocabulary used, so a text's
    ids are those of its words in turn. ASCII capitals are lowered first (the
    tokenizer does so itself) unless the text may hold a special token's
    string, which is matched as it is written.

    A run of letters is one pre-token, and so is the punctuation after it, so
    the memo holds stems and punctuation. New ones are encoded many at a time,
    as one text: each ends with the one id that ends a word, which gives the
    words back. Those of ASCII go through a copy of the tokenizer without the
    steps that leave them as they are. Any other word is encoded on its own.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.full, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = WhitespaceSplit()
        self.ends = np.zeros(self.full.get_vocab_size(), bool)
        for token, i in self.full.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.codes = _Codes()
        self.codes[_END] = 0
        self.flat, self.used = np.full(1 << 16, end_id, np.uint32), 1
        self.offset, self.length, self.hits = (np.zeros(1 << 16, np.int64) for _ in range(3))
        self.length[0] = 1

    def _put(self, codes: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        while len(self.codes) > len(self.offset):
            self.offset, self.length, self.hits = (np.r_[x, np.zeros_like(x)] for x in (self.offset, self.length, self.hits))
        self.flat[self.used:self.used + len(ids)] = ids
        self.offset[codes] = self.used + np.cumsum(lens) - lens
        self.length[codes] = lens
        self.used += len(ids)

    def _together(self, tokenizer, text: str, n: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of the text of ``n`` words, and the number per word; None if they are not one pre-token each."""
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == n and ends[-1] == len(ids) else None

    def _learn(self, new: list[bytes]) -> None:
        """Encode new words, whose codes follow one another; one with final punctuation is its stem, encoded once, and that punctuation."""
        known, first = self.codes, self.codes[new[0]]
        joined = np.frombuffer(b"\n".join(new) + b"\n", np.uint8)
        letters, signs, size, mixed = _shapes(joined)
        plain = (letters == size) | (signs == size)
        paired = ~plain & (letters + signs == size) & ~mixed
        alone, lettered, pairs = ([], []), ([], []), ([], [], [])
        if plain.any():
            codes = first + np.flatnonzero(plain)
            text = joined[np.repeat(plain, size + 1)].tobytes().decode()
            if got := self._together(self.plain, text, len(codes)):
                self._put(codes, *got)
            else:
                alone[0].extend(codes.tolist())
                alone[1].extend(text.split())
        at = np.flatnonzero(paired)
        cuts = list(zip(map(new.__getitem__, at.tolist()), letters[at].tolist()))
        pairs[0].extend((first + at).tolist())
        pairs[1].extend([known[w[:k]] for w, k in cuts])
        pairs[2].extend([known[w[k:]] for w, k in cuts])
        for i in np.flatnonzero(~plain & ~paired).tolist():
            w = new[i]
            text = w.decode()
            stem = text.rstrip(_PUNCTUATION)
            if not (stem.isalpha() and stem.lower().isalpha()):
                alone[0].append(first + i)
                alone[1].append(text)
            elif len(stem) < len(text):
                cut = len(w) - (len(text) - len(stem))
                pairs[0].append(first + i)
                pairs[1].append(known[w[:cut]])
                pairs[2].append(known[w[cut:]])
            else:
                lettered[0].append(first + i)
                lettered[1].append(text)
        if lettered[0]:
            if got := self._together(self.full, " ".join(lettered[1]), len(lettered[0])):
                self._put(np.array(lettered[0]), *got)
            else:
                alone[0].extend(lettered[0])
                alone[1].extend(lettered[1])
        if alone[0]:
            each = [e.ids for e in self.full.encode_batch_fast(alone[1], add_special_tokens=False)]
            self._put(np.array(alone[0]), np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each]))
        if pairs[0]:
            if known.new:  # stems and punctuation met, which are no pairs themselves
                more, known.new = known.new, []
                self._learn(more)
            ids, lens = self._gather(np.array(pairs[1:]).T.ravel())
            self._put(np.array(pairs[0]), ids, lens.reshape(-1, 2).sum(axis=1))

    def _gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lens = self.length[codes]
        shift = np.repeat(self.offset[codes] - (np.cumsum(lens) - lens), lens)
        shift += np.arange(len(shift))
        return self.flat[shift], lens

    def _forget(self) -> None:
        """Keep the words seen more than once, while they are under half the bound; else none."""
        kept = [w for w, c in self.codes.items() if self.hits[c] > 1 or w is _END]
        kept = kept if len(kept) < MEMO_WORDS // 2 else [_END]
        ids, lens = self._gather(np.array([self.codes[w] for w in kept]))
        self.codes = _Codes()
        self.codes.update({w: i for i, w in enumerate(kept)})
        self.used = 0
        self.hits[:] = 0
        self._put(np.arange(len(kept)), ids, lens)

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each followed by the end id, and the number per text."""
        if not texts:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        if len(self.codes) > MEMO_WORDS:
            self._forget()
        words, starts = [], []
        for t in texts:
            starts.append(len(words))
            if t:
                words += (t if b"<|" in t else t.lower()).split()
            words.append(_END)
        codes = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        if self.codes.new:
            new, self.codes.new = self.codes.new, []
            self._learn(new)
        seen = np.bincount(codes)
        self.hits[:len(seen)] += seen
        ids, lens = self._gather(codes)
        return ids, np.add.reduceat(lens, starts)


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block: base, percentile-chosen width, packed residuals, exceptions."""
    base = int(ids.min())
    rest = (ids - np.uint32(base)).astype("<u4")
    cut = int(np.partition(rest, k := min(len(rest) - 1, int(len(rest) * percentile / 100)))[k])
    width = cut.bit_length()
    over = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    size = 2 if width <= 16 else 4
    bits = np.unpackbits(rest.astype(f"<u{size}").view(np.uint8).reshape(-1, size), axis=1, count=width, bitorder="little") if width else np.empty(0, np.uint8)
    return (struct.pack("<IIBH", len(ids), base, width, len(over)) + np.packbits(bits.ravel(), bitorder="little").tobytes()
            + over.astype("<u2").tobytes() + (rest[over] >> np.uint32(width)).astype("<u4").tobytes())


def unpack_block(data, at: int) -> np.ndarray:
    """The ids of the block at a byte offset."""
    n, base, width, n_over = struct.unpack_from("<IIBH", data, at)
    at += 11
    size = -(-n * width // 8)
    rest = np.zeros(n, "<u4")
    if width:
        wide = np.zeros((n, 16 if width <= 16 else 32), np.uint8)
        wide[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
        rest = np.packbits(wide.ravel(), bitorder="little").view("<u2" if width <= 16 else "<u4").astype("<u4")
    at += size
    over = np.frombuffer(data, "<u2", n_over, at)
    rest[over] |= np.frombuffer(data, "<u4", n_over, at + 2 * n_over) << np.uint32(width)
    return rest + np.uint32(base)


class ShardWriter:
    """Streams ids into blocks; keeps one unfinished block and the index in memory."""

    def __init__(self, out, block_ids: int, percentile: float):
        self.out, self.block_ids, self.percentile = out, block_ids, percentile
        self.at, self.blocks, self.held, self.n_ids = 0, [], np.empty(0, np.uint32), 0
        self.doc_ids, self.lens = [], []
        self._write(MAGIC + struct.pack("<I", block_ids))

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _block(self, ids: np.ndarray) -> None:
        self.blocks.append(self.at)
        self._write(pack_block(ids, self.percentile))

    def add(self, doc_ids: list[int | None], ids: np.ndarray, lens: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.lens.append(lens)
        self.n_ids += len(ids)
        ids = np.concatenate([self.held, ids]) if len(self.held) else ids
        full = len(ids) // self.block_ids * self.block_ids
        for i in range(0, full, self.block_ids):
            self._block(ids[i:i + self.block_ids])
        self.held = ids[full:].copy()

    def close(self, number: int = 0, part: int = 0, path: str = "") -> pa.RecordBatch:
        """Write the rest, the index and the footer; returns the shard's entry."""
        if len(self.held):
            self._block(self.held)
        index = self.at
        self._write(np.array(self.blocks, "<u8").tobytes())
        self._write(np.array([d or 0 for d in self.doc_ids], "<i8").tobytes())
        self._write(np.array([d is None for d in self.doc_ids], np.uint8).tobytes())
        self._write(np.concatenate([np.empty(0), *self.lens]).astype("<u8").tobytes())
        self._write(struct.pack("<QQQQ", len(self.blocks), len(self.doc_ids), self.n_ids, index) + MAGIC)
        self.out.close()
        return pa.RecordBatch.from_pydict({"number": [number], "part": [part], "path": [path], "n_docs": [len(self.doc_ids)], "n_ids": [self.n_ids]})


class Shard:
    """A shard's bytes: documents' ids are found through the block index."""

    def __init__(self, data):
        if data[:4] != MAGIC or data[-4:] != MAGIC:
            raise ValueError("not a complete shard")
        self.data = data
        self.block_ids = struct.unpack_from("<I", data, 4)[0]
        n_blocks, n_docs, self.n_ids, at = struct.unpack_from("<QQQQ", data, len(data) - 36)
        self.blocks = np.frombuffer(data, "<u8", n_blocks, at)
        at += 8 * n_blocks
        ids = np.frombuffer(data, "<i8", n_docs, at).tolist()
        null = np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs)
        self.doc_ids = [None if x else d for d, x in zip(ids, null)]
        self.lens = np.frombuffer(data, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
        self.starts = np.cumsum(np.r_[0, self.lens])

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from position ``start``, decoding only the blocks that hold them."""
        first, last = start // self.block_ids, -(-(start + n) // self.block_ids)
        parts = [unpack_block(self.data, int(self.blocks[b])) for b in range(first, last)]
        return np.concatenate([np.empty(0, np.uint32), *parts])[start - first * self.block_ids:][:n].astype("<u4")

    def documents(self):
        """(doc_id, start, ids) of each document, decoding each block once."""
        held, base, b = np.empty(0, np.uint32), 0, 0
        for doc_id, start, n in zip(self.doc_ids, self.starts.tolist(), self.lens.tolist()):
            held, base = held[start - base:], start
            more = []
            have = len(held)
            while have < n:
                more.append(unpack_block(self.data, int(self.blocks[b])))
                have += len(more[-1])
                b += 1
            if more:
                held = np.concatenate([held, *more])
            yield doc_id, start, held[:n].astype("<u4")


def _local(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", re.sub(r"^file:/+", "/", uri)))


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, folder: str | None = None,
                 block_ids: int = BLOCK_IDS, percentile: float = PERCENTILE, range_docs: int = RANGE_DOCS,
                 shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode whole texts and write them in ascending doc_id order.

    Returns the manifest, a stored table with a row per shard: number, part
    (their order), path, n_docs, n_ids, first (the number of ids in the shards
    before it). Files that the manifest does not name come from failed
    attempts. ``folder`` defaults to a new one under the shared folder; it must
    be open to every executor.

    A null text is empty: it has the end id alone. A null doc_id sorts first;
    rows that share a doc_id are ordered by a hash of their text, repeated rows
    are all written. A shard ends with the document that brings it to
    ``shard_ids``. An empty table has no shards. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "token-shards")
    fs, path = _local(folder)
    fs.create_dir(path, recursive=True)
    docs = docs.select(F.col("text").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = docs.repartitionByRange(max(1, -(-docs.count() // range_docs)), *order).sortWithinPartitions(*order)

    def run(batches):
        encoder, writer, part = WordEncoder(tokenizer_path, end_id), None, 0
        number = TaskContext.get().partitionId()
        to, _ = _local(folder)
        for batch, texts in slices(batches):
            if writer is None:
                name = f"shard-{number:06d}-{part:03d}-{uuid.uuid4().hex}.tpf"
                writer = ShardWriter(to.open_output_stream(_local(f"{folder}/{name}")[1]), block_ids, percentile)
            writer.add(batch.column(1).to_pylist(), *encoder.encode(texts))
            if writer.n_ids >= shard_ids:
                yield writer.close(number, part, f"{folder}/{name}")
                writer, part = None, part + 1
        if writer is not None:
            yield writer.close(number, part, f"{folder}/{name}")

    shards = stored(map_texts(ordered, run, "number long, part long, path string, n_docs long, n_ids long"), "shards")
    upto = running_sum_ranged(shards, ["number", "part"], "n_ids", out_col="upto")
    return stored(upto.withColumn("first", (F.col("upto") - F.col("n_ids")).cast("long")).drop("upto"), "manifest")


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Decode shards: doc_id, start, n_tokens, ids_crc32 and ``ids`` of each document.

    ``start`` counts the ids of all documents before it. A manifest without
    rows gives an empty table.
    """
    return _read(spark, manifest, with_ids=True)


def read_digests(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """As ``read_shards``, without the ids themselves."""
    return _read(spark, manifest, with_ids=False)


def _read(spark: SparkSession, manifest: DataFrame, with_ids: bool) -> DataFrame:
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    # A task per shard: a manifest is small, its shards are not.
    shards = manifest.select("path", "first").repartition(max(1, manifest.count()))

    def run(batches):
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, at = _local(path)
                with fs.open_input_file(at) as f:
                    shard, rows = Shard(f.read()), []
                for doc_id, start, ids in shard.documents():
                    rows.append((doc_id, first + start, len(ids), zlib.crc32(ids)) + ((ids.tolist(),) if with_ids else ()))
                    if len(rows) == 2000:
                        yield _table(rows, with_ids)
                        rows = []
                yield _table(rows, with_ids)

    return map_texts(shards, run, schema)


def _table(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(kinds)]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
