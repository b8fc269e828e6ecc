"""Operator 2: conversations as training text, by Spark expressions alone.

Turns are collected by conversation and sorted; adjacent turns of one role are merged by an array aggregate into one
block, which keeps the bounds of its turns; blocks are concatenated:

    <|role:ROLE|>text<|next|>text of the same role<|end|>

Control strings inside roles and texts are escaped: "&" is written "&0;", and the k-th of CONTROLS "&k;". Escapes are
the only places of "&", so that undoing the others first and "&0;" last gives back every text. Heads begin with a mark
of their own, so that a role of any name, "end" or "next" too, is no other mark. The loss mask lists the ranges of the
assistant's texts, in code points of the formatted text; where each text starts is a running sum of lengths, so that
long conversations take time in proportion to their turns.

Defined cases: a null text or role is empty; turns that share a number are sorted by role and text, repeated rows are
turns of their own, a null turn number comes first; a null conversation is one of its own, with a null id; an empty
table gives only the rows that are added; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import load

#: Strings that a chat template may give a meaning to.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ASSISTANT = "assistant"
ROLE, NEXT, END = "<|role:", "<|next|>", "<|end|>"


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("&"), F.lit("&0;"))
    for k, control in enumerate(CONTROLS, 1):
        text = F.replace(text, F.lit(control), F.lit(f"&{k};"))
    return text


def unescaped(text: Column) -> Column:
    for k, control in enumerate(CONTROLS, 1):
        text = F.replace(text, F.lit(f"&{k};"), F.lit(control))
    return F.replace(text, F.lit("&0;"), F.lit("&"))


def formatted(rows: DataFrame, assistant: str = ASSISTANT) -> DataFrame:
    """(conv_id, formatted, loss_mask) of rows (conv_id, turn, role, text).

    loss_mask: array<struct<start, length>>, code points from 0, of the assistant's escaped texts.
    """
    turns = rows.select("conv_id", "turn", escaped(F.coalesce("role", F.lit(""))).alias("role"), escaped(F.coalesce("text", F.lit(""))).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    joins = F.coalesce(F.lag("role").over(order) == F.col("role"), F.lit(False))
    goes_on = F.coalesce(F.lead("role").over(order) == F.col("role"), F.lit(False))
    head = F.when(F.col("joins"), F.lit("")).otherwise(F.concat(F.lit(ROLE), "role", F.lit("|>")))
    tail = F.when(F.col("goes_on"), F.lit(NEXT)).otherwise(F.lit(END))
    length = F.char_length("text").cast("long")
    whole = F.char_length("head") + length + F.char_length("tail")
    placed = (
        turns.withColumns({"place": F.row_number().over(order), "joins": joins, "goes_on": goes_on})
        .withColumns({"head": head, "tail": tail})
        .withColumn("start", F.sum(whole).over(order.rowsBetween(Window.unboundedPreceding, 0)) - length - F.char_length("tail"))
    )
    piece = F.struct("place", "head", "text", "tail", (F.col("role") == assistant).alias("learnt"), "start", length.alias("length"))
    chats = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    mask = F.transform(F.filter("pieces", lambda p: p["learnt"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length")))
    joined = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["text"], p["tail"])), "")
    return chats.select("conv_id", joined.alias("formatted"), mask.alias("loss_mask"))


def read_back(chats: DataFrame) -> DataFrame:
    """chats and the column turns, array<struct<role, text>>: what formatted() was given, out of its text alone."""
    blocks = F.filter(F.split("formatted", r"<\|end\|>"), lambda b: b != "")
    turns = F.transform(
        blocks,
        lambda b: F.transform(
            F.split(F.regexp_replace(b, r"(?s)^<\|role:.*?\|>", ""), r"<\|next\|>"),
            lambda t: F.struct(unescaped(F.regexp_extract(b, r"(?s)^<\|role:(.*?)\|>", 1)).alias("role"), unescaped(t).alias("text")),
        ),
    )
    return chats.withColumn("turns", F.flatten(turns))


def learnt_text(chat: str = "formatted", mask: str = "loss_mask") -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda m: unescaped(F.substring(F.col(chat), (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(said).alias("text"))
    chats = read_back(formatted(rows.unionByName(added))).withColumn("learnt", learnt_text())
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escaped(column: str) -> str:
    out = f"replace({column}, '&', '&0;')"
    for k, control in enumerate(CONTROLS, 1):
        out = f"replace({out}, '{control}', '&{k};')"
    return out


ORACLE = f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), numbered AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), pieces AS (
  SELECT *, length({_sql_escaped("text")})
    + CASE WHEN before = role THEN 8 ELSE length({_sql_escaped("role")}) + 16 END AS chars FROM numbered
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM pieces GROUP BY conv_id
"""
