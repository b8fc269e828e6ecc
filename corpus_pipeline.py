"""The corpus pipeline: documents to packed training sequences, each stage one of the numbered operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.op4_simhash_dedup import first_of_groups
from marginalia.llm.op6_language_id import UNKNOWN, trained, with_language
from marginalia.llm.op7_decontamination import contaminated
from marginalia.llm.op8_suffix_dedup import dedup_texts
from marginalia.llm.op9_packing import packed, word_bpe
from marginalia.llm.tables import load, written

#: Least score of a language at which a document stays.
LEAST_SCORE = 0.5


def _unused(name: str, docs: DataFrame) -> str:
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier is sure of.

    Null, empty and letterless texts are of no language and go; without any labelled row all go. Each row is judged by
    its text alone, so that repeated rows, ties and null or shared ids change nothing; very long texts are scored whole.
    An empty table stays empty; columns of any name and number are kept.
    """
    name = _unused("language", docs)
    found = with_language(docs, trained(docs), out=name)
    return found.where((F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.score") >= LEAST_SCORE)).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id, a null id being the largest.

    Of rows that share that id one stays; groups are never told apart by ids, so that no group is lost where rows share
    one or have none. Null and wordless texts are one group; very long texts are fingerprinted whole; repeated rows are
    copies. An empty table stays empty; columns of any name and number are kept.
    """
    return first_of_groups(docs)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings that stand earlier in the corpus; those of which nothing is left go.

    Null texts stay null, empty ones go as nothing is left of them. Null ids come first; rows of one id and other texts
    are judged each by itself, repeated rows as one. n_chars, where there is one, follows the text. Very long texts are
    read whole. An empty table stays empty; columns of any name and number are kept.
    """
    kept = dedup_texts(docs)
    if "n_chars" in kept.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return kept.where(F.col("text").isNull() | (F.col("text") != ""))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    A row goes for what its own text holds: rows are known by id and a hash of the text, so that others of the same id,
    or without one, stay. Null and empty texts stay; very long ones are searched whole; repeated rows go or stay
    together. With an empty benchmark all stay. Columns of any name and number are kept.
    """
    doc, row = _unused("_leak_doc", docs), _unused("_leak_row", docs)
    found = contaminated(docs, load(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(doc), F.col("row").alias(row)).distinct()
    leaks = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(F.col("text")) == F.col(row))
    return docs.join(found, leaks, "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens.

    Null and empty texts are their end token alone; null, shared and repeated ids are passed on, a document for each row;
    very long texts are cut. An empty table gives no pieces; other columns are not read.
    """
    # workers still hold what the stages before needed
    return packed(docs, word_bpe, keep=100_000, lasting=False)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_text", repeated_text),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL expresses none of the learnt, fuzzy or tokenising stages; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage makes of the table documents."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
