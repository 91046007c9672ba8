"""Quality rules as a bitmask ledger, with Spark expressions only.

Each rule is evaluated once per document; its failure sets one bit, and the
measurements are kept beside the bits. A policy is a set of rules under a
version name, so its verdict is one bitwise AND, and what each rule
contributes to a policy (its ablation) is one aggregation over the bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adspark.llm.text import SPACE

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

#: Rule -> condition under which a document fails it. The position is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "2 * n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "capitals": "2 * n_capitals > word_chars",
    "word_length": "word_chars < 2 * n_words OR word_chars > 30 * n_words",
}
BASE = ("few_words", "repeated_windows")
#: Version -> the rules it applies.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "duplicate_lines"),
    "v2": (*BASE, "symbols", "duplicate_lines", "capitals", "word_length"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    """The bits of a policy's rules."""
    return reduce(int.__or__, map(bit, POLICIES[policy]), 0)


def _without(chars: str) -> Column:
    return F.length(F.translate("_text", chars, ""))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of each whole text (see ``ledger``)."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    d = d.withColumn("_words", F.array_remove(F.split("_text", SPACE + "+"), ""))
    d = d.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.translate(x, SPACES, "") != ""))
    # Hash of the 3-word window that starts at each word.
    d = d.withColumn("_win", F.slice(F.transform("_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2))),
                                     1, F.greatest(F.size("_words") - 2, F.lit(0))))
    # Sorted by hash, equal windows are neighbours; most texts without a repeat skip the sort.
    pairs = F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_sorted", F.when(F.size(F.array_distinct("_win")) < F.size("_win"), pairs))
    same = lambda x, j: x["h"] == F.get("_sorted", j)["h"]
    again = F.filter("_sorted", lambda x, j: F.coalesce(same(x, j + 1), F.lit(False)) | F.coalesce((j > 0) & same(x, F.greatest(j - 1, F.lit(0))), F.lit(False)))
    d = d.withColumn("_at", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.transform("_at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("_at", j + 1) - p, F.lit(3))))
    long = lambda c: c.cast("long")
    return d.select(
        "doc_id", long(F.size("_words")).alias("n_words"), long(_without(SPACES)).alias("word_chars"),
        long(F.length("_text") - _without(SYMBOLS)).alias("n_symbols"), long(F.size("_lines")).alias("n_lines"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")).alias("n_repeat_words"),
        long(F.length("_text") - F.length(F.regexp_replace("_text", r"\p{Lu}", ""))).alias("n_capitals"))


def ledger(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the measurements, and ``failed`` (a bit per rule).

    Words are ``[^\\x20\\x09-\\x0D]+``. n_symbols counts ``[#*$%&|<>]``, n_lines
    the lines with a word, n_dup_lines those equal to an earlier one,
    n_repeat_words the words in 3-word windows that occur twice or more.
    A null or wordless text measures zero everywhere and fails few_words.
    Repeated rows each get a row, null doc_ids stay, other columns are ignored,
    an empty table gives an empty ledger.
    """
    m = measured(docs)
    failed = reduce(Column.__add__, (F.when(F.expr(cond), F.lit(bit(r)).cast("long")).otherwise(F.lit(0).cast("long")) for r, cond in RULES.items()))
    return m.withColumn("failed", failed)


def fails(policy: str) -> Column:
    """Whether a ledger row fails a policy."""
    return F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("long")) != 0


def verdicts(rows: DataFrame) -> DataFrame:
    """A ledger with one boolean ``kept_<version>`` per policy."""
    return rows.select("*", *[(~fails(p)).alias(f"kept_{p}") for p in POLICIES])


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that stay without it.

    The ledger is first reduced to one row per combination of bits.
    """
    m = mask(policy)
    counts = rows.groupBy(F.col("failed").bitwiseAND(F.lit(m).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("bit")) for r in POLICIES[policy]]))
    each = counts.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("bits") == F.col("bit")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(total(hit).alias("n_failed"), total(alone).alias("n_failed_alone"),
                                    total(alone | (F.col("bits") == 0)).alias("n_kept_without"),
                                    F.bit_or(F.when(hit, F.col("bits"))).alias("fails_with"))
