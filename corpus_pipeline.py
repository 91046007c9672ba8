"""The corpus pipeline: documents in, token ids out.

``STAGES`` are (name, function) pairs; each function takes (spark, docs,
sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's ``docs``. All stages but the last keep the columns of
``documents``. ``run`` applies them to the documents of a folder.

Every stage takes nulls in any column, empty and very long texts, repeated rows
and empty tables; what becomes of them is said in each operator's docstring.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adspark.llm import decontaminate, mixing, simhash, tokenpack, toxicity
from adspark.llm.text import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on these rows' labels, does not reject."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(toxicity.predicted() == 0).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicate fingerprints: the smallest doc_id."""
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    found = decontaminate.find_overlaps(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("spans") == 0).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, a row per copy, shuffled within shards."""
    return mixing.mixed(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written to binary shards, read back: doc_id, start, n_tokens, ids_crc32 of each row."""
    return tokenpack.read_digests(spark, tokenpack.write_shards(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_duplicates), ("benchmark_decontamination", drop_contaminated),
          ("source_mixing", mix_sources), ("token_id_output", write_token_ids)]

#: No SQL expresses a trained model or the tokenizer: tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
