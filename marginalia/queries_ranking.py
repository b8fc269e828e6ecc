"""Registered queries of the folds of logs (M) and of ranking (W), with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import aggregates as A
from .operators import mutations as M
from .operators import ranking as W
from .schema import ENTITY_TYPES
from .sources import standins as S
from .sources.standins_sql import with_tables

Query = Callable[[SparkSession, str], DataFrame]


def upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of writes: key paper_id, order id."""
    e = S.table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("paper_id"), F.col("event_id").alias("id"), F.col("event_type").alias("verdict"), F.col("event_id").alias("created"), F.floor(F.col("value") * 100).alias("amount"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").alias("version_id"), F.when(F.col("role") == "assistant", "autosave").otherwise("manual").alias("label"), F.col("text").alias("content"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.edus(spark, sf_dir).select("paper_id", F.col("k").alias("idx"), "text", F.lit("fulltext").alias("source"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bibliographic records: the query is the source, the title the first letters of the text."""
    d = S.table(spark, sf_dir, "documents").where("text is not null")
    return d.select(F.col("source").alias("query"), F.col("doc_id").alias("pos"), F.substring("text", 1, 12).alias("title"), F.col("lang").alias("surname"), F.char_length("text").cast("long").alias("cited"), F.when(F.char_length("text") > 400, F.substring("text", 1, 40)).alias("abstract"), (F.char_length("text") % 997 / 997.0).alias("score"))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors whose id is divisible by 20 ask; all of their label are searched."""
    e = S.table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0")
    return e.select(F.col("label").alias("topic"), F.col("vec_id").alias("claim_id"), F.col("embedding").alias("claim"))


def w01(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.table(spark, sf_dir, "embeddings")
    return W.w01_top_chunks(_claims(spark, sf_dir), e.select(F.col("label").alias("topic"), F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("chunk")))


def _wrong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.judgments(spark, sf_dir).where("verdict = 'wrong'").select("paper_id").distinct()


def _graph(f: Callable[..., DataFrame]) -> Query:
    return lambda spark, sf_dir: f(S.edus(spark, sf_dir), spark, sf_dir)


def _covered(units: DataFrame) -> DataFrame:
    return S.covers(units).join(units.select("paper_id", "edu_id", "section", "section_rank", "ord"), ["paper_id", "edu_id"])


QUERIES: dict[str, Query] = {
    "m01_upsert_papers": lambda s, d: M.latest(upserts(s, d), ["paper_id"], "id", keep_first=("created",)),
    "m01_upsert_judgments": lambda s, d: M.latest(M.valid(upserts(s, d), "verdict", ("purchase", "error", "view")), ["paper_id"], "id"),
    "m02_last_write": lambda s, d: M.latest(upserts(s, d), ["paper_id", "verdict"], "id"),
    "m03_replace_chunks": lambda s, d: M.replace_keys(chunks(s, d), S.papers(s, d).where("title like '%.%'").select("paper_id", F.lit(0).alias("idx"), F.col("title").alias("text"), F.lit("abstract").alias("source")), ["paper_id"]),
    "m04_delete_papers": lambda s, d: M.cascade(_wrong(s, d), "paper_id", judgments=S.judgments(s, d), llm_calls=S.llm_calls(s, d), chat_messages=S.chat_messages(s, d), results=S.results(s, d)),
    "m05_delete_documents": lambda s, d: M.cascade(versions(s, d).where("label = 'manual' and version_id > 3").select("doc_id").distinct(), "doc_id", versions=versions(s, d)),
    "m06_keep_autosaves": lambda s, d: M.keep_newest(versions(s, d), "doc_id", "version_id", 20, F.col("label") == "autosave").drop("content"),
    "m07_keep_messages": lambda s, d: M.keep_newest(S.chat_messages(s, d), "paper_id", "id", 200).select("paper_id", "id"),
    "m08_conditional_updates": lambda s, d: M.fold_updates(upserts(s, d).withColumn("expected", F.pmod("amount", F.lit(7))), "paper_id", "id", "expected"),
    "m09_restore": lambda s, d: M.restore(versions(s, d).groupBy("doc_id").agg(F.max_by("content", "version_id").alias("content")), versions(s, d), versions(s, d).where("version_id = 0").select("doc_id", "version_id")),
    "m10_interrupt": lambda s, d: M.interrupt(S.upload_events(s, d)).groupBy("status", "error_message").agg(F.count(F.lit(1)).alias("n")),
    "m11_list_errors": lambda s, d: M.list_events(S.upload_events(s, d), "error", 50).select("id", "paper_id", "status"),
    "m12_list_versions": lambda s, d: versions(s, d).select("doc_id", "version_id", "label"),
    "m13_size_guard": lambda s, d: S.table(s, d, "documents").select("doc_id", M.fits(F.col("text"), 25 << 20).alias("fits")),
    "m14_backfill": lambda s, d: M.backfilled(A.result_json(S.defects(s, d)), "defect_count", "$.defects").drop("result_json"),
    "m15_base_names": lambda s, d: S.papers(s, d).select("paper_id", M.base_name(F.concat(F.when(F.length("title") > 39, "/").otherwise(""), F.col("filename"))).alias("name")),
    "m16_negative_cache": lambda s, d: M.with_sentinels(S.papers(s, d), chunks(s, d)).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("paper_id").alias("papers")),
    "w01_cosine_top_k": w01,
    "w02_rerank": lambda s, d: W.w02_rerank(records(s, d)),
    "w03_best_match": lambda s, d: W.w03_best_match(records(s, d)),
    "w04_dedupe": lambda s, d: W.w04_dedupe(records(s, d)),
    "w05_interleave": lambda s, d: W.w05_interleave(records(s, d).where("surname = 'en'").withColumnRenamed("pos", "item").withColumn("pos", F.col("item")), records(s, d).where("surname <> 'en'").withColumnRenamed("pos", "item").withColumn("pos", F.col("item")), "query"),
    "w06_recommend": lambda s, d: W.w06_recommend(records(s, d), "en", 8),
    "w07_entity_dedupe": _graph(lambda u, s, d: W.w07_entity_dedupe(S.er_triples(u))),
    "w08_entity_sections": _graph(lambda u, s, d: W.w08_entity_sections(S.entities(S.er_triples(u)), S.mentioned_in(S.er_triples(u)), u)),
    "w09_relations": _graph(lambda u, s, d: W.w09_relations(S.er_triples(u))),
    "w10_type_counts": _graph(lambda u, s, d: W.w10_counts(S.entities(S.er_triples(u)), "type", ENTITY_TYPES)),
    "w11_ego": _graph(lambda u, s, d: W.w11_ego(S.er_triples(u))),
    "w12_function_places": _graph(lambda u, s, d: W.w12_function_places(_covered(u))),
    "w13_defects_by_function": _graph(lambda u, s, d: W.w13_defects_by_function(S.covers(u), S.evidence(u))),
    "w14_function_order": _graph(lambda u, s, d: W.w14_function_order(S.frus(u), W.w13_defects_by_function(S.covers(u), S.evidence(u)))),
    "w15_top_severity": lambda s, d: W.w15_top_severity(S.defects(s, d)),
    "w16_numbering": _graph(lambda u, s, d: W.w16_numbering(S.er_triples(u).withColumn("place", F.split_part("rel_id", F.lit(":"), F.lit(3)).cast("int")), "paper_id", "src", "place")),
    "w17_history_tail": lambda s, d: W.w17_history_tail(S.chat_messages(s, d), 20),
    "w18_evidence_csv": _graph(lambda u, s, d: W.w18_evidence_csv(S.evidence(u), u)),
    "w19_sections": _graph(lambda u, s, d: W.w19_sections(u)),
    "w20_highlights": _graph(lambda u, s, d: W.w20_highlights(S.defects(s, d), S.evidence(u), u)),
}

_UPSERTS = "upserts AS (SELECT user_id::VARCHAR AS paper_id, event_id AS id, event_type AS verdict, event_id AS created, floor(value * 100)::BIGINT AS amount FROM events)"
_VERSIONS = "versions AS (SELECT conv_id::VARCHAR AS doc_id, turn AS version_id, CASE WHEN role = 'assistant' THEN 'autosave' ELSE 'manual' END AS label, text AS content FROM conversations)"
_RECORDS = "records AS (SELECT source AS query, doc_id AS pos, substr(text, 1, 12) AS title, lang AS surname, length(text) AS cited, CASE WHEN length(text) > 400 THEN substr(text, 1, 40) END AS abstract, length(text) % 997 / 997.0::DOUBLE AS score, lower(trim(regexp_replace(substr(text, 1, 12), '\\s+', ' ', 'g'))) AS key FROM documents WHERE text IS NOT NULL)"
_CHUNKS = "chunks AS (SELECT paper_id, k AS idx, text, 'fulltext' AS source FROM edus)"
_BEST = "SELECT {0} key, surname, arg_max(pos, cited * 1000000 - pos) AS kept_pos, max(cited) AS cited, min(pos) AS place FROM records WHERE key NOT IN ('', '(untitled)') GROUP BY {0} key, surname"
_RELATIONS = "relations AS (SELECT paper_id, src AS entity, 'out' AS direction, predicate, tgt AS other, rel_id FROM er_triples UNION ALL SELECT paper_id, tgt, 'in', predicate, src, rel_id FROM er_triples)"
_BY_FUNCTION = "pairs AS (SELECT DISTINCT c.paper_id, c.fru_id, v.defect_id FROM covers c JOIN evidence v ON v.paper_id = c.paper_id AND v.edu_id = c.edu_id)"
_SEVERITY = "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END"

ORACLES: dict[str, str] = {
    "m01_upsert_papers": f"WITH {_UPSERTS} SELECT paper_id, arg_max(id, id) AS id, arg_max(verdict, id) AS verdict, min(created) AS created, arg_max(amount, id) AS amount FROM upserts GROUP BY paper_id",
    "m01_upsert_judgments": f"WITH {_UPSERTS} SELECT paper_id, max(id) AS id, arg_max(verdict, id) AS verdict, arg_max(created, id) AS created, arg_max(amount, id) AS amount FROM upserts WHERE verdict IN ('purchase', 'error', 'view') GROUP BY paper_id",
    "m02_last_write": f"WITH {_UPSERTS} SELECT paper_id, verdict, max(id) AS id, arg_max(created, id) AS created, arg_max(amount, id) AS amount FROM upserts GROUP BY paper_id, verdict",
    "m03_replace_chunks": with_tables("papers edus", f"WITH {_CHUNKS}, new AS (SELECT * FROM papers WHERE title LIKE '%.%') SELECT * FROM chunks WHERE paper_id NOT IN (SELECT paper_id FROM new) UNION ALL SELECT paper_id, 0, title, 'abstract' FROM new"),
    "m04_delete_papers": with_tables("judgments llm_calls chat_messages results", "WITH gone AS (SELECT paper_id FROM judgments WHERE verdict = 'wrong'), x AS (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, paper_id FROM {t}" for t in ("judgments", "llm_calls", "chat_messages", "results")) + ") SELECT table_name, paper_id, count(*) AS n FROM x WHERE paper_id IS NULL OR paper_id NOT IN (SELECT paper_id FROM gone) GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY table_name, paper_id")),
    "m05_delete_documents": f"WITH {_VERSIONS} SELECT 'versions' AS table_name, doc_id, count(*) AS n FROM versions WHERE doc_id NOT IN (SELECT doc_id FROM versions WHERE label = 'manual' AND version_id > 3) GROUP BY doc_id",
    "m06_keep_autosaves": f"WITH {_VERSIONS} SELECT doc_id, version_id, label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY version_id DESC) AS r FROM versions) WHERE label IS DISTINCT FROM 'autosave' OR r <= 20",
    "m07_keep_messages": with_tables("chat_messages", "SELECT paper_id, id FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY id DESC) AS r FROM chat_messages) WHERE r <= 200"),
    "m08_conditional_updates": f"WITH {_UPSERTS} SELECT paper_id, list_reduce(list_prepend(0, list((amount % 7 + 7) % 7 ORDER BY id)), lambda v, e: CASE WHEN e = v THEN v + 1 ELSE v END)::BIGINT AS version, count(*) AS patches FROM upserts GROUP BY paper_id",
    "m09_restore": f"WITH {_VERSIONS}, wanted AS (SELECT doc_id FROM versions WHERE version_id = 0) SELECT doc_id, 0 AS seq, 'restore-backup' AS label, arg_max(content, version_id) AS content FROM versions WHERE doc_id IN (SELECT doc_id FROM wanted) GROUP BY doc_id UNION ALL SELECT doc_id, 1, 'restored', content FROM versions WHERE version_id = 0",
    "m10_interrupt": with_tables("upload_events", "SELECT CASE WHEN status = 'pending' THEN 'error' ELSE status END AS status, CASE WHEN status = 'pending' THEN 'Interrupted' ELSE error_message END AS error_message, count(*) AS n FROM upload_events GROUP BY 1, 2"),
    "m11_list_errors": with_tables("upload_events", "SELECT id, paper_id, status FROM upload_events WHERE status = 'error' ORDER BY id DESC LIMIT 50"),
    "m12_list_versions": f"WITH {_VERSIONS} SELECT doc_id, version_id, label FROM versions",
    "m13_size_guard": "SELECT doc_id, coalesce(octet_length(encode(text)) <= 26214400, true) AS fits FROM documents",
    "m14_backfill": with_tables("defects", "SELECT paper_id, count(*) AS defect_count FROM defects GROUP BY paper_id"),
    "m15_base_names": with_tables("papers", "SELECT paper_id, CASE WHEN length(title) > 39 THEN regexp_extract(filename, '[^/]*$') ELSE filename END AS name FROM papers"),
    "m16_negative_cache": with_tables("papers edus", "SELECT 'fulltext' AS source, count(*) AS n, count(DISTINCT paper_id) AS papers FROM edus UNION ALL SELECT * FROM (SELECT 'none', count(*) AS c, count(*) FROM papers WHERE paper_id NOT IN (SELECT paper_id FROM edus)) WHERE c > 0"),
    "w01_cosine_top_k": """WITH claims AS (SELECT label, vec_id AS claim_id, embedding::DOUBLE[] AS claim FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT c.label AS topic, claim_id, vec_id AS chunk_id, list_inner_product(claim, embedding::DOUBLE[]) / (sqrt(list_inner_product(claim, claim)) * sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS score FROM claims c JOIN embeddings e ON e.label = c.label AND e.vec_id <> claim_id)
SELECT topic, claim_id, chunk_id, round(score, 4) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY topic, claim_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 3""",
    "w02_rerank": f"WITH {_RECORDS}, n AS (SELECT *, coalesce(trim(abstract) <> '', false) AS has, count(*) FILTER (coalesce(trim(abstract) <> '', false)) OVER (PARTITION BY query) AS c FROM records) SELECT query, pos, (row_number() OVER (PARTITION BY query ORDER BY CASE WHEN c >= 2 AND NOT has THEN 1 ELSE 0 END, CASE WHEN c >= 2 AND has THEN -score ELSE 0 END, pos))::INTEGER AS rank FROM n",
    "w03_best_match": f"WITH {_RECORDS} SELECT query, pos, round(score, 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, pos) AS r FROM records) WHERE r = 1 AND score >= 0.8",
    "w04_dedupe": f"WITH {_RECORDS} {_BEST.format('')}",
    "w05_interleave": f"WITH {_RECORDS}, t AS (SELECT query, pos AS item, (surname <> 'en')::INT AS side, row_number() OVER (PARTITION BY query, surname = 'en' ORDER BY pos) AS turn FROM records WHERE surname IS NOT NULL) SELECT query, (row_number() OVER (PARTITION BY query ORDER BY turn, side))::INTEGER AS place, item FROM t",
    "w06_recommend": f"WITH {_RECORDS}, b AS ({_BEST.format('query,')}) SELECT query, place::INTEGER AS place, kept_pos AS pos FROM (SELECT query, kept_pos, row_number() OVER (PARTITION BY query ORDER BY place) AS place FROM b) WHERE place <= 8",
    "w07_entity_dedupe": with_tables("er_triples", "SELECT paper_id, rel_id, src, predicate, tgt FROM er_triples"),
    "w08_entity_sections": with_tables("entities mentioned_in edus", "SELECT e.paper_id, e.entity_id, coalesce(arg_min(u.section, u.section_rank * 1000000 + u.ord), '__unsectioned__') AS section FROM entities e LEFT JOIN mentioned_in m ON m.paper_id = e.paper_id AND m.entity_id = e.entity_id LEFT JOIN edus u ON u.paper_id = e.paper_id AND u.edu_id = m.edu_id GROUP BY e.paper_id, e.entity_id"),
    "w09_relations": with_tables("er_triples", f"WITH {_RELATIONS} SELECT paper_id, entity, direction, predicate, other, min(rel_id) AS rel_id FROM relations GROUP BY paper_id, entity, direction, predicate, other"),
    "w10_type_counts": with_tables("entities", "SELECT type AS value, list_position([" + ", ".join(f"'{t}'" for t in ENTITY_TYPES) + "], type)::BIGINT AS place, count(*) AS n FROM entities GROUP BY type"),
    "w11_ego": with_tables("er_triples", f"WITH {_RELATIONS} SELECT paper_id, entity, count(DISTINCT other) AS degree, string_agg(DISTINCT other, '|' ORDER BY other) AS neighbours FROM relations GROUP BY paper_id, entity"),
    "w12_function_places": with_tables("covers edus", "SELECT c.paper_id, c.fru_id, arg_min(section, section_rank * 100000 + ord) AS section, arg_min(ord, section_rank * 100000 + ord) AS ord FROM covers c JOIN edus e ON e.paper_id = c.paper_id AND e.edu_id = c.edu_id GROUP BY c.paper_id, c.fru_id"),
    "w13_defects_by_function": with_tables("covers evidence", f"WITH {_BY_FUNCTION} SELECT * FROM pairs"),
    "w14_function_order": with_tables("covers evidence frus", f"WITH {_BY_FUNCTION}, n AS (SELECT f.paper_id, f.fru_id, count(defect_id) AS defects FROM frus f LEFT JOIN pairs p ON p.paper_id = f.paper_id AND p.fru_id = f.fru_id GROUP BY f.paper_id, f.fru_id) SELECT *, (row_number() OVER (PARTITION BY paper_id ORDER BY defects DESC, fru_id))::INTEGER AS place FROM n"),
    "w15_top_severity": with_tables("defects", f"SELECT paper_id, coalesce(['high', 'medium', 'low'][min({_SEVERITY}) + 1], 'low') AS severity FROM defects GROUP BY paper_id"),
    "w16_numbering": with_tables("er_triples", "SELECT paper_id, src, (row_number() OVER (PARTITION BY paper_id ORDER BY min(split_part(rel_id, ':', 3)::INT)))::INTEGER AS number FROM er_triples GROUP BY paper_id, src"),
    "w17_history_tail": with_tables("chat_messages", "SELECT paper_id, id, role, (row_number() OVER (PARTITION BY paper_id ORDER BY id))::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY id DESC) AS back FROM chat_messages) WHERE back <= 20"),
    "w18_evidence_csv": with_tables("evidence edus", "SELECT v.paper_id, v.defect_id, string_agg(DISTINCT k // 4 + 1, ' / ' ORDER BY k // 4 + 1) AS pages, string_agg(text, ' || ' ORDER BY pos, text) AS texts FROM evidence v JOIN edus e ON e.paper_id = v.paper_id AND e.edu_id = v.edu_id GROUP BY v.paper_id, v.defect_id"),
    "w19_sections": with_tables("edus", "SELECT paper_id, (row_number() OVER (PARTITION BY paper_id ORDER BY min(k)))::INTEGER AS place, section, string_agg(edu_id, '|' ORDER BY ord) AS edu_ids FROM edus GROUP BY paper_id, section"),
    "w20_highlights": with_tables("defects evidence edus", "WITH m AS (SELECT v.paper_id, k // 4 AS page, v.defect_id || '>' || v.edu_id || '>' || coalesce(severity, '') AS mark FROM evidence v JOIN defects d ON d.paper_id = v.paper_id AND d.defect_id = v.defect_id JOIN edus e ON e.paper_id = v.paper_id AND e.edu_id = v.edu_id) SELECT paper_id, page::BIGINT AS page, string_agg(mark, '|' ORDER BY mark) AS marks FROM m GROUP BY paper_id, page"),
}
