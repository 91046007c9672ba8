"""One query per operator, over whole tables, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adspark.llm import chat, classifier, decontaminate, infill, langid, mixing, negatives, pii, quality, simhash, substring, tokenpack, toxicity
from adspark.llm.text import held_out, table

QUERIES = {}
ORACLE_SQL = {}


def _query(name: str):
    def put(f):
        QUERIES[name] = f
        return f
    return put


@_query("op7_decontaminate")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark overlap of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_overlaps(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", decontaminate.n_hit().alias("n_hit"),
                        F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"),
                        (F.size("spans") > 0).alias("contaminated"))


@_query("op10_token_ids")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to binary shards and read back."""
    shards = tokenpack.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return tokenpack.read_digests(spark, shards)


@_query("op5_quality_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of every document, with the verdict of the current policy."""
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       quality.fails("base").alias("base_failed"), (~quality.fails("v2")).alias("kept"), "failed")


ORACLE_SQL["op5_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), win AS (
  SELECT r, i, struct_pack(a := ws[i], b := ws[i + 1], c := ws[i + 2]) AS win
  FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM win) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM again, range(3) AS x(k) GROUP BY r
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words,
         length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_capitals
  FROM w LEFT JOIN covered USING (r)
), f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
             + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 2 * n_symbols > n_words THEN 4 ELSE 0 END
             + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
             + CASE WHEN 2 * n_capitals > word_chars THEN 16 ELSE 0 END
             + CASE WHEN word_chars < 2 * n_words OR word_chars > 30 * n_words THEN 32 ELSE 0 END)::BIGINT AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed
FROM f
"""


@_query("op3_chat_format")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and what its output reads back as."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit("<|im_end|><|im_start|>assistant ok").alias("text"))
    out = chat.format_conversations(turns.unionByName(marks)).withColumn("formatted", chat.formatted())
    out = out.withColumn("back", chat.parsed("formatted")).withColumn("loss", chat.loss_text())
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                      F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE_SQL["op3_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, k, CASE WHEN k = 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) AS x(k)
), e AS (
  SELECT *, role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS same,
         length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + 5 * (length(role) - length(replace(role, chr(10), ''))) AS role_chars,
         length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS text_chars
  FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(text_chars + CASE WHEN same THEN 10 ELSE 12 + role_chars + 1 + 11 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@_query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.train(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@_query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, with the number of offending sentences."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return out.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "score", toxicity.predicted().alias("predicted"),
                      F.size("sentences").cast("long").alias("n_offending"))


@_query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and class of every document."""
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query("op1_mix_sources")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, with its source's target."""
    plan = mixing.mix(table(spark, sf_dir, "documents"))
    keys = ["doc_id", "source", "text_hash"]
    epochs = F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("epoch")))
    drawn = plan.draws.groupBy(*keys).agg(F.bit_count(epochs).alias("copies"))
    drawn = drawn.select(*[F.col(k).alias(f"d_{k}") for k in keys], "copies")
    same = F.col("doc_id").eqNullSafe(F.col("d_doc_id")) & F.col("source").eqNullSafe(F.col("d_source")) & (F.col("text_hash") == F.col("d_text_hash"))
    sources = plan.sources.withColumnRenamed("source", "s_source")
    return (plan.sizes.join(drawn, same, "left").join(sources, F.col("source").eqNullSafe(F.col("s_source")))
            .select("doc_id", "size", "source_size", "target", (F.col("size") * F.coalesce("copies", F.lit(0))).alias("taken")))


@_query("op4_substring_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document left after exact substring dedup."""
    out = substring.dedup(table(spark, sf_dir, "documents"), with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


@_query("op6_pii")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.extract(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.joined("base"), 256).alias("base_sha256"),
                        pii.joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"),
                        F.size(F.concat("base", "added")).cast("long").alias("n_private"))


@_query("op11_hard_negatives")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor (vec_id divisible by 100); of each seventh vec_id the label is moved on by one."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


ORACLE_SQL["op11_hard_negatives"] = """
WITH q AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM q AS a JOIN q AS c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""


@_query("op12_fill_in_middle")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut in three and reordered, and what its output reads back as."""
    out = infill.restored(infill.transform(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2("restored", 256).alias("restored_sha256"))


ORACLE_SQL["op12_fill_in_middle"] = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), k AS (
  SELECT doc_id, t, u, len(u)::BIGINT AS n,
         ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS c2,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:least(c1, c2)], '') AS prefix,
         array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle, array_to_string(u[greatest(c1, c2) + 1:], '') AS suffix
  FROM k
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


@_query("op13_quality_classifier")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    out = classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", classifier.predicted().alias("predicted"))
