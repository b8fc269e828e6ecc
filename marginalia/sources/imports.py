"""Files of any readable kind to block rows and titles, each kind by its own reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sections import paragraphs
from .latex import latex_blocks
from .markdown import RUN, markdown_blocks

#: What endings of names mean, and how long a title may be.
KINDS = {"txt": "text", "text": "text", "md": "markdown", "markdown": "markdown", "mdown": "markdown", "tex": "latex", "latex": "latex"}
TITLE = 300
UNNAMED = "未命名文件"


def extension(filename: Column) -> Column:
    """A name's ending, in lower case, "" without one."""
    return F.lower(F.regexp_extract(filename, r"[^/.]\.([^./]*)$", 1))


def stem(filename: Column) -> Column:
    return F.regexp_extract(filename, r"([^/]+?)(?:\.[^./]*)?$", 1)


def kind_of(filename: Column) -> Column:
    """The reader of a file; null where there is none."""
    kind = F.lit(None).cast("string")
    for ending, name in KINDS.items():
        kind = F.when(extension(filename) == ending, name).otherwise(kind)
    return kind


def text_blocks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Plain texts as block rows of paragraphs."""
    clean = F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\r\n?", "\n")
    rows = paragraphs(texts.select(F.col(f"`{key}`").alias("_key"), clean.alias("_text")), "_key", "_text")
    none = {"level": "int", "ordered": "boolean", "cells": "array<string>", "src": "string"}
    return rows.select(F.col("_key").alias(key), F.col("place").alias("top"), F.lit(0).alias("part"), F.lit(0).alias("depth"), F.lit("paragraph").alias("kind"), "text", F.array(F.struct(F.col("text"), F.array().cast("array<string>").alias("marks"))).cast(f"array<{RUN}>").alias("runs"), *(F.lit(None).cast(t).alias(c) for c, t in none.items()))


BLOCK = ("top", "place", "part", "depth", "kind", "level", "ordered", "text", "runs", "cells", "src")


def imported(files: DataFrame, key: str, filename: str, text: str) -> tuple[DataFrame, DataFrame]:
    """((key, title, kind), blocks) of files; one that no reader knows has a null kind, and no blocks.

    Blocks are in the order of top, place and part. A title is that of the text, or the file's name without its ending.
    """
    rows = files.withColumn("_kind", kind_of(F.col(f"`{filename}`")))
    of = lambda kind: rows.where(F.col("_kind") == kind)
    markdown = markdown_blocks(of("markdown"), key, text)
    others = [latex_blocks(of("latex"), key, text), text_blocks(of("text"), key, text)]
    blocks = markdown.select(key, *BLOCK)
    for o in others:
        blocks = blocks.unionByName(o.withColumn("place", F.lit(0)).select(key, *BLOCK))
    named = blocks.where("kind = 'title'").select(F.col(key).alias("_key"), F.col("text").alias("_title"))
    own = rows.join(named, rows[key].eqNullSafe(named["_key"]), "left")
    name = F.coalesce(F.nullif(F.trim("_title"), F.lit("")), F.nullif(stem(F.col(f"`{filename}`")), F.lit("")), F.lit(UNNAMED))
    titles = own.select(key, F.substring(name, 1, TITLE).alias("title"), F.col("_kind").alias("kind"))
    return titles, blocks.where("kind <> 'title'")
