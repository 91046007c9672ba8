"""Chat formatting with Spark expressions only.

Turns are collected per conversation and sorted; neighbours of the same role
form one block, their texts separated by a mark, so nothing is lost:

    <|im_start|>ROLE\\nTEXT[<|im_sep|>TEXT ...]<|im_end|>\\n

A text cannot contain a mark: in ``<|`` with any number of backslashes between
the two characters, one backslash is added (and taken away on reading).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END, NEWLINE = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n", "<|nl|>"
LOSS_ROLE = "assistant"


def escaped(text) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id and ``segments``: the formatted text in pieces, each under the loss mask or not.

    ``segments`` is an array of (text, loss); joined, its texts are the
    formatted conversation (``formatted``). Loss lies on the texts of assistant
    turns alone.

    Turns are ordered by ``turn`` (nulls first), ties by role and text.
    A null text or role is empty; null conv_ids form one conversation; repeated
    rows are repeated turns; other columns are ignored; no rows give no
    conversations. A conversation's turns meet in one row, as its text does.
    """
    t = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    c = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(t)).alias("_said"))
    # Escaped after the sort: ties go by what was said, not by how it is written.
    c = c.withColumn("_turns", F.transform("_said", lambda x: F.struct(
        F.replace(escaped(x["role"]), F.lit("\n"), F.lit(NEWLINE)).alias("role"), escaped(x["text"]).alias("text"))))
    role = lambda i: F.get("_turns", i)["role"]
    first = F.filter(F.sequence(F.lit(0), F.size("_turns") - 1), lambda i: (i == 0) | (role(i) != role(F.greatest(i - 1, F.lit(0)))))
    c = c.withColumn("_first", first).withColumn("_texts", F.col("_turns.text"))
    c = c.withColumn("_blocks", F.transform("_first", lambda i, k: F.struct(
        role(i).alias("role"), F.slice("_texts", i + 1, F.coalesce(F.get("_first", k + 1), F.size("_turns")) - i).alias("texts"))))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    mark = lambda *s: F.array(piece(F.concat(*s), F.lit(False)))

    def block(b):
        loss = b["role"] == LOSS_ROLE
        body = F.transform(b["texts"], lambda x, k: F.when(k == 0, F.array(piece(x, loss))).otherwise(
            F.array(piece(F.lit(SEP), F.lit(False)), piece(x, loss))))
        return F.concat(mark(F.lit(START), b["role"], F.lit("\n")), F.flatten(body), mark(F.lit(END)))

    return c.select("conv_id", F.flatten(F.transform("_blocks", block)).alias("segments"))


def formatted(segments="segments") -> Column:
    """The formatted text."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments="segments") -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def parsed(text) -> Column:
    """The turns (role, text) of a formatted conversation, as they were."""
    blocks = F.split(text, r"\Q" + END + r"\E")

    def block(b):
        head = F.substring_index(b, "\n", 1)
        role = unescaped(F.replace(F.substr(head, F.lit(len(START) + 1)), F.lit(NEWLINE), F.lit("\n")))
        body = F.substr(b, F.length(head) + 2)
        return F.transform(F.split(body, r"\Q" + SEP + r"\E"), lambda x: F.struct(role.alias("role"), unescaped(x).alias("text")))

    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), block))
