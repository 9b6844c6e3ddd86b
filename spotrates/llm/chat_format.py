"""Prefix-target expansion of conversations.

Every assistant turn becomes one example: all preceding turns are its context
and only that reply is trainable. A conversation whose last turn is not an
assistant turn also gives one example without a target, so that the formatted
output holds every turn.

Template, per turn::

    ### <role>: <text> </turn>\\n

Control strings inside roles and texts are escaped with two-character codes
that start with a backslash; since every backslash of the source becomes
``\\b`` first, the codes are undone one after another without ambiguity.

Defined cases: a null role or text counts as empty; a null turn sorts first;
turns that share a number are ordered by role, then text; repeated rows are
repeated turns; a null ``conv_id`` is a conversation of its own; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_START, ROLE_END, TURN_END = "### ", ": ", " </turn>\n"
TARGET_ROLE = "assistant"

# source string -> code, applied in this order; undone in reverse order
TEXT_CODES = (("\\", "\\b"), ("#", "\\h"), ("</turn>", "<\\s/turn>"))
ROLE_CODES = (*TEXT_CODES, (":", "\\c"))


def escape(text: Column, codes=TEXT_CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, codes=TEXT_CODES) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _render(turn: Column) -> Column:
    return F.concat(F.lit(TURN_START), escape(turn["role"], ROLE_CODES), F.lit(ROLE_END),
                    escape(turn["text"]), F.lit(TURN_END))


def format_examples(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` -> one row per example.

    Columns: conv_id, example (position of its last turn), is_target, is_last
    (holds the whole conversation), formatted, loss_start, loss_end (code
    points of ``formatted``, end exclusive; equal when nothing is trainable).
    """
    grouped = (
        conversations
        .select("conv_id", F.struct(
            F.col("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
        .groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
        .select("conv_id", F.transform("turns", lambda t: t["role"] == TARGET_ROLE).alias("target"),
                F.transform("turns", lambda t: F.char_length(escape(t["text"]))).alias("length"),
                F.transform("turns", _render).alias("rendered"))
    )
    last = F.size("rendered") - 1
    ends = F.filter(F.sequence(F.lit(0), last),
                    lambda i: (i == last) | F.get("target", i))
    one = grouped.select("*", F.explode(ends).alias("example"))
    is_target = F.get("target", F.col("example"))
    reply = F.when(is_target, F.get("length", F.col("example"))).otherwise(F.lit(0))
    out = one.select(
        "conv_id", "example", is_target.alias("is_target"),
        (F.col("example") == last).alias("is_last"),
        F.array_join(F.slice("rendered", F.lit(1), F.col("example") + 1), "").alias("formatted"),
        reply.alias("reply"))
    end = F.char_length("formatted") - len(TURN_END)
    return out.select("conv_id", "example", "is_target", "is_last", "formatted",
                      (end - F.col("reply")).alias("loss_start"), end.alias("loss_end"))


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) that a formatted example holds."""
    parts = F.split(formatted, TURN_END, -1)

    def turn(part: Column) -> Column:
        at = F.locate(ROLE_END, part)
        return F.struct(
            unescape(F.substring(part, F.lit(len(TURN_START) + 1), at - len(TURN_START) - 1), ROLE_CODES).alias("role"),
            unescape(F.substring(part, at + len(ROLE_END), F.char_length(part))).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def loss_text(formatted: Column, start: Column, end: Column) -> Column:
    """The trainable text of an example, unescaped."""
    return unescape(F.substring(formatted, start + 1, end - start))


def conversation_digest(examples: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted examples alone."""
    turns = F.when(F.col("is_last"), read_turns(F.col("formatted")))
    read = examples.select(
        "conv_id", "example", "is_target", turns.alias("turns"),
        loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"),
        F.char_length("formatted").cast("long").alias("chars"))
    digest = F.sha2(F.array_join(F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    replies = F.sort_array(F.collect_list(F.when(F.col("is_target"), F.struct("example", "loss"))))
    return (
        read.select("*", F.size("turns").cast("long").alias("n"),
                    F.when(F.col("turns").isNotNull(), digest).alias("sha"))
        .groupBy("conv_id").agg(
            F.max(F.when(F.col("turns").isNotNull(), F.col("n"))).alias("n_turns"),
            F.max("sha").alias("turns_sha256"),
            F.sum(F.when(F.col("is_target"), F.char_length("loss")).otherwise(0)).cast("long").alias("loss_chars"),
            F.sha2(F.array_join(F.transform(replies, lambda r: r["loss"]), ""), 256).alias("loss_sha256"),
            F.sum("chars").cast("long").alias("formatted_chars"))
    )


def op2_prefix_target_chat(spark, sf_dir: str) -> DataFrame:
    from .common import table

    text = "\\### Assistant: </turn> ok"
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(text).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_digest(format_examples(rows.unionByName(planted)))


OP2_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (
  SELECT *,
    length('### ') + length(replace(replace(replace(replace(role, '\', '\b'), '#', '\h'), '</turn>', '<\s/turn>'), ':', '\c'))
      + 2 + length(replace(replace(replace(text, '\', '\b'), '#', '\h'), '</turn>', '<\s/turn>')) + 9 AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM rows_
), s AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (WHERE role = 'assistant' OR k = n))::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
