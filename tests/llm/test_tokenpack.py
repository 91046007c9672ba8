"""Shards against the library's own encoding of whole texts."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from adspark.llm import queries, tokenpack

DIR = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(docs):
    from tokenizers import Tokenizer

    t, out, start = Tokenizer.from_file(PATH), [], 0
    for d, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_whole_text_encoding(spark):
    docs = duckdb.sql(f"select doc_id, text from '{DIR}/documents.parquet' order by doc_id").fetchall()
    assert sorted(tuple(r) for r in queries.QUERIES["op10_token_ids"](spark, DIR).collect()) == expected(docs)


def test_edges(spark):
    """Nulls, special strings, odd spaces, a long text, equal ids, extra columns, several shards."""
    docs = [(3, "A<|endoftext|>b <|ENDOFTEXT|> it's. ÉÀ!! é ́x Ⅷ İi ΟΣ ος ½ 123,45 ... a\x0bb\x0cc d e", 1), (None, "null id", 0),
            (1, None, 2), (2, "", 3), (7, "word, " * 60_000 + "end", None), (5, "same", 1), (5, "same", 1), (-4, "\U0001F600 ﬁ Å K a'll's 'S", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, ids int")
    shards = tokenpack.write_shards(df, PATH, range_docs=3, shard_ids=50, block_ids=100)
    assert shards.count() > 1
    got = tokenpack.read_shards(spark, shards).orderBy("start").collect()
    order = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [tuple(r)[:4] for r in got] == expected([r[:2] for r in order])
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    assert tokenpack.read_digests(spark, tokenpack.write_shards(df.limit(0), PATH)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50), st.integers(0, 2**32 - 1)), min_size=1, max_size=300), st.sampled_from([0.0, 50.0, 98.0, 100.0]))
def test_block_round_trip(ids, percentile):
    data = tokenpack.pack_block(np.array(ids, np.uint32), percentile)
    assert tokenpack.unpack_block(data, 0).tolist() == ids


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5))
def test_word_encoding_equals_whole_text(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    texts = [x.encode("utf-8", "ignore").decode() for x in texts]
    ids, lens = tokenpack.WordEncoder(PATH, 1).encode([x.encode() for x in texts])
    want = [[*t.encode(x, add_special_tokens=False).ids, 1] for x in texts]
    assert ids.tolist() == [i for w in want for i in w] and lens.tolist() == [len(w) for w in want]


def test_random_access():
    class Out(bytearray):
        write = bytearray.extend

        def close(self):
            pass

    out = Out()
    w = tokenpack.ShardWriter(out, 16, 90.0)
    ids = np.arange(1000, dtype=np.uint32) * 37 % 5000
    w.add([1, None, 3], ids, np.array([10, 0, 990]))
    w.close()
    s = tokenpack.Shard(bytes(out))
    assert s.ids(123, 400).tolist() == ids[123:523].tolist() and s.doc_ids == [1, None, 3]
    with pytest.raises(ValueError):
        tokenpack.Shard(bytes(out[:-1]))
