"""The graph and log tables that the operators take, derived from the general-purpose tables.

A service that annotates papers would fill these tables; here a deterministic annotator does, row by row: what a
sentence becomes depends on its document's id, its place and its length alone, so no table needs a shuffle.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ENTITY_TYPES, FUNCTIONS, RST_TYPES, SECTIONS

SENTENCE = r"(?s).+?[.!?\n]+|.+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], index: Column) -> Column:
    """values[index], index from 0."""
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def section_rank(k: Column, n: Column) -> Column:
    return F.floor(k * len(SECTIONS) / n).cast("int")


def edu_name(paper: Column, k: Column, n: Column) -> Column:
    rank = section_rank(k, n)
    return F.concat_ws(":", paper, pick(SECTIONS, rank), F.lit("edu"), (k - F.ceil(rank * n / len(SECTIONS))).cast("string"))


#: Units by application and folder: every frame of the graph is read from them, so texts are taken apart once.
_units: dict[tuple[str, str], DataFrame] = {}


def edus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of at least 20 characters as units: (paper_id, doc_id, k, n, section, section_rank, ord, edu_id, text).

    Kept on the executors, on disk where memory is short; a lost block is made again from the table.
    """
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _units:
        _units[key] = _edus(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    return _units[key]


def _edus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    clean = F.filter(F.transform(F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0)), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: F.length(s) >= 20)
    rows = docs.select("doc_id", F.col("doc_id").cast("string").alias("paper_id"), clean.alias("s"))
    # outer: before an inner one Spark asks whether there is anything, for which it makes the sentences twice more
    rows = rows.select("doc_id", "paper_id", F.size("s").alias("n"), F.posexplode_outer("s").alias("k", "text")).where("k is not null")
    rank = section_rank(F.col("k"), F.col("n"))
    return rows.select("paper_id", "doc_id", "k", "n", pick(SECTIONS, rank).alias("section"), rank.alias("section_rank"), (F.col("k") - F.ceil(rank * F.col("n") / len(SECTIONS))).cast("int").alias("ord"), edu_name(F.col("paper_id"), F.col("k"), F.col("n")).alias("edu_id"), "text")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("paper_id"), F.substring("text", 1, 40).alias("title"), F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("filename"), F.sha2("text", 256).alias("content_hash"), F.col("doc_id").alias("created_at"))


def _frus(units: DataFrame) -> DataFrame:
    return units.where("(k + doc_id) % 3 <> 1 or k = 0").withColumn("fru_id", F.concat("paper_id", F.lit(":fru:"), "k"))


def frus(units: DataFrame) -> DataFrame:
    return _frus(units).select("paper_id", "fru_id", pick(FUNCTIONS, (F.col("doc_id") * 7 + F.col("k") * 13 + F.length("text")) % 15).alias("function"), F.substring("text", 1, 60).alias("summary"))


def covers(units: DataFrame) -> DataFrame:
    wide = ((F.col("k") + F.col("doc_id")) % 3 == 0) & (F.col("k") + 1 < F.col("n"))
    rows = _frus(units).select("paper_id", "fru_id", "k", "n", F.posexplode(F.when(wide, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("pos", "step"))
    return rows.select("paper_id", "fru_id", "pos", edu_name(F.col("paper_id"), F.col("k") + F.col("step"), F.col("n")).alias("edu_id"))


def rst(units: DataFrame) -> DataFrame:
    return units.where("k % 5 = 0").select("paper_id", F.concat("paper_id", F.lit(":rst:"), "k").alias("rst_id"), pick(RST_TYPES, (F.col("doc_id") + F.col("k")) % 15).alias("rst_type"))


def rst_edges(units: DataFrame) -> DataFrame:
    roles = F.when(F.col("k") + 1 < F.col("n"), F.array(F.lit("NUCLEUS"), F.lit("SATELLITE"))).otherwise(F.array(F.lit("NUCLEUS")))
    rows = units.where("k % 5 = 0").select("paper_id", "k", "n", F.posexplode(roles).alias("step", "role"))
    return rows.select("paper_id", F.concat("paper_id", F.lit(":rst:"), "k").alias("rst_id"), edu_name(F.col("paper_id"), F.col("k") + F.col("step"), F.col("n")).alias("edu_id"), "role")


def er_triples(units: DataFrame) -> DataFrame:
    """(paper_id, rel_id, src, tgt, predicate, evidence_edu_id): of each fourth unit its first two long words."""
    words = units.where("k % 4 = 0").withColumn("w", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), F.lit(0))).where("size(w) >= 2")
    return words.select("paper_id", F.concat("paper_id", F.lit(":rel:"), "k").alias("rel_id"), F.col("w")[0].alias("src"), F.col("w")[1].alias("tgt"), pick(("uses", "improves", "extends"), F.length(F.col("w")[0]) % 3).alias("predicate"), F.col("edu_id").alias("evidence_edu_id"))


def entities(triples: DataFrame) -> DataFrame:
    names = triples.select("paper_id", F.explode(F.array("src", "tgt")).alias("name")).distinct()
    return names.select("paper_id", F.concat("paper_id", F.lit(":ent:"), "name").alias("entity_id"), "name", pick(ENTITY_TYPES, F.length("name") % 8).alias("type"))


def mentioned_in(triples: DataFrame) -> DataFrame:
    rows = triples.select("paper_id", F.explode(F.array("src", "tgt")).alias("name"), F.col("evidence_edu_id").alias("edu_id")).distinct()
    return rows.select("paper_id", F.concat("paper_id", F.lit(":ent:"), "name").alias("entity_id"), "edu_id")


#: The last rule never fires.
def _rule(number: Column) -> Column:
    return F.concat(F.lit("REL-"), F.lpad((number % 13 + 1).cast("string"), 2, "0"))


def defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to three defects of each document, with position, some without a severity or a confidence."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 3 + 1).cast("int"))).alias("j"))
    severity = F.when((F.col("doc_id") + F.col("j")) % 11 != 0, pick(("high", "medium", "low", "critical"), (F.col("doc_id") + F.col("j")) % 4))
    confidence = F.when((F.col("doc_id") + F.col("j")) % 7 != 0, ((F.col("doc_id") * 3 + F.col("j")) % 11) / 10.0)
    paper = F.col("doc_id").cast("string")
    return docs.select(paper.alias("paper_id"), F.concat(paper, F.lit(":d"), "j").alias("defect_id"), F.col("j").alias("pos"), _rule((F.col("doc_id") + F.col("j") - 1) % 12).alias("rule_id"), severity.alias("severity"), confidence.alias("confidence"), F.concat(F.lit("type"), F.col("j") % 2).alias("defect_type"))


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    verdict = F.when(F.col("quality") != 1, "wrong").when(F.col("toxic") == 1, "partial").otherwise("correct")
    paper = F.col("doc_id").cast("string")
    step = F.when(F.col("doc_id") % 17 == 0, 9).otherwise(1)  # some judge a defect that is gone
    return labels.select(paper.alias("paper_id"), F.concat(paper, F.lit(":d"), step).alias("defect_id"), _rule(F.col("doc_id")).alias("rule_id"), verdict.alias("verdict"), F.col("doc_id").alias("created_at"))


def llm_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs in millionths of a dollar, as longs, so that sums do not depend on their order."""
    rows = table(spark, sf_dir, "conversations")
    model = F.when(F.col("role") == "system", "large-heavy[1m]").when(F.col("role") == "user", "mid").otherwise("small-light")
    tokens = F.length("text").cast("long")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("conv_id") % 10 != 0, F.col("conv_id").cast("string")).alias("paper_id"), F.concat(F.lit("rule_check:"), _rule(F.col("turn"))).alias("stage"), model.alias("model"), tokens.alias("input_tokens"), F.floor(tokens / 4).alias("output_tokens"), (F.col("turn") * 10).alias("cached_tokens"), (tokens * 3 + F.floor(tokens / 4) * 15).alias("cost_micro"), F.col("turn").alias("created_at"))


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").cast("string").alias("paper_id"), "role", F.col("text").alias("content"))


def upload_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "cached").otherwise("pending")
    return rows.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("paper_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("created_at"), F.floor(F.abs("value") * 1000).alias("file_size"), F.when(status == "error", F.concat(F.lit("disk full at "), "user_id")).alias("error_message"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses that have ended: those of texts of at least 200 characters."""
    docs = table(spark, sf_dir, "documents").where("length(text) >= 200")
    return docs.select(F.col("doc_id").cast("string").alias("paper_id"), (F.col("doc_id") + 10).alias("finished_at"))


def evidence(units: DataFrame) -> DataFrame:
    """(paper_id, defect_id, pos, edu_id): a defect's evidence is the unit of its number and the next one."""
    rows = units.select("paper_id", "k", "edu_id", F.posexplode(F.array(F.col("k") + 1, F.col("k"))).alias("pos", "j")).where("j > 0 and k < 4")
    return rows.select("paper_id", F.concat("paper_id", F.lit(":d"), "j").alias("defect_id"), "pos", "edu_id")
