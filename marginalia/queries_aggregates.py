"""Registered queries of the aggregates, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import aggregates as A
from .schema import PRICES
from .sources import standins as S
from .sources.standins_sql import with_tables

SINCE, NOW = "2024-01-15 00:00:00", "2024-02-01 00:00:00"


def _of(f: Callable[..., DataFrame], *tables: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that gives f these stand-in tables."""
    return lambda spark, sf_dir: f(*(t(spark, sf_dir) for t in tables))


def _rule_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.a09_rule_stats(A.rule_catalog(spark), S.judgments(spark, sf_dir), S.defects(spark, sf_dir), S.results(spark, sf_dir))


def _export(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = S.edus(spark, sf_dir)
    return A.a07_export(S.judgments(spark, sf_dir), S.results(spark, sf_dir), S.papers(spark, sf_dir), S.defects(spark, sf_dir), S.evidence(units), units)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "a01_judgments_by_rule": _of(A.a01_judgments_by_rule, S.judgments),
    "a02_judgments_overall": _of(A.a02_judgments_overall, S.judgments),
    "a03_evaluation": _of(A.a03_evaluation, S.judgments),
    "a04_evaluation_by_severity": _of(A.a04_evaluation_by_severity, S.judgments, S.defects, S.results),
    "a05_evaluation_by_confidence": _of(A.a05_evaluation_by_confidence, S.judgments, S.defects, S.results),
    "a06_orphans": _of(A.a06_orphans, S.judgments, S.defects, S.results),
    "a07_export": _export,
    "a08_rule_firing": _of(A.a08_rule_firing, S.defects, S.results),
    "a09_rule_stats": _rule_stats,
    "a10_cost_total": _of(A.a10_cost_total, S.llm_calls),
    "a11_cost_by_stage": _of(A.a11_cost_by_stage, S.llm_calls),
    "a12_upload_errors": _of(lambda e: A.a12_upload_errors(e, SINCE), S.upload_events),
    "a12_upload_stats": _of(lambda e: A.a12_upload_stats(e, SINCE), S.upload_events),
    "a13_papers": _of(A.a13_papers, S.papers, S.results),
    "a14_finished_papers": _of(A.a14_finished_papers, S.papers, S.results),
    "a15_latest_by_hash": _of(A.a15_latest_by_hash, S.papers, S.results),
    "a16_counts": _of(A.a16_counts, S.results, S.defects, S.edus),
    "a17_cost_by_paper": _of(A.a17_cost_by_paper, S.llm_calls),
    "a18_top_stages": _of(A.a18_top_stages, S.llm_calls),
    "a19_worst_rules": _of(A.a19_worst_rules, S.judgments),
    "a20_burn_and_wrong": _of(A.a20_burn_and_wrong, S.judgments, S.llm_calls),
    "a20_burn_and_wrong_once": _of(lambda j, c: A.a20_burn_and_wrong(j, c, fan_out=False), S.judgments, S.llm_calls),
    "a21_json_extract": _of(lambda d: A.a21_json_extract(A.result_json(d)), S.defects),
    "a22_json_each": _of(lambda d: A.a22_json_each(A.result_json(d)), S.defects),
    "a23_context_share": _of(A.a23_context_share, S.llm_calls),
    "a24_phase": _of(A.a24_phase, S.judgments),
    "a25_kpis": lambda spark, sf_dir: A.a25_kpis(_rule_stats(spark, sf_dir)),
    "a26_fire_rates": lambda spark, sf_dir: A.a26_fire_rates(_rule_stats(spark, sf_dir)),
    "a27_rule_status": lambda spark, sf_dir: A.a27_rule_status(_rule_stats(spark, sf_dir)),
    "a28_badges": _of(A.a28_badges, S.defects),
    "a29_bucket_shares": _of(lambda j, d, r: A.a29_bucket_shares(A.a05_evaluation_by_confidence(j, d, r)), S.judgments, S.defects, S.results),
    "a30_verdicts_of_result": _of(A.a30_verdicts_of_result, S.defects, S.judgments),
    "a31_by_severity": _of(A.a31_by_severity, S.defects),
    "a32_by_rule": _of(A.a32_by_rule, S.defects),
    "a33_token_cost": _of(A.a33_token_cost, S.llm_calls),
    "a34_usage_split": _of(A.a34_usage_split, S.llm_calls),
    "a35_cross_section": _of(A.a35_cross_section, S.defects),
    "a36_labels": _of(A.a36_labels, S.chat_messages),
    "a37_ages": _of(lambda e: A.a37_ages(e, NOW), S.upload_events),
}

_COUNTS = "count(*) AS total, sum((verdict = 'correct')::INT)::BIGINT AS correct, sum((verdict = 'wrong')::INT)::BIGINT AS wrong, sum((verdict = 'partial')::INT)::BIGINT AS partial, (sum((verdict = 'correct')::INT) + sum((verdict = 'partial')::INT) * 0.5::DOUBLE) / count(*)::DOUBLE AS precision"
_JUDGED = "judged AS (SELECT j.*, d.severity, d.confidence, d.defect_type FROM judgments j JOIN defects d ON d.paper_id = j.paper_id AND d.defect_id = j.defect_id)"
_FINISHED = _JUDGED.replace("ON d.paper_id", "ON j.paper_id IN (SELECT paper_id FROM results) AND d.paper_id")
_BUCKET = "CASE WHEN confidence IS NULL THEN 'n/a' WHEN confidence >= 0.8 THEN '>=0.8' WHEN confidence >= 0.5 THEN '0.5-0.8' ELSE '<0.5' END"
_COST = "count(*) AS calls, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens, coalesce(sum(cached_tokens), 0)::BIGINT AS cached_tokens, coalesce(sum(cost_micro), 0)::BIGINT AS cost_micro"
_STATS = f"""
  catalog AS (SELECT 'REL-' || lpad(i::VARCHAR, 2, '0') AS rule_id FROM range(1, 14) t(i)),
  fired AS (SELECT rule_id, count(DISTINCT paper_id) AS papers_fired, count(*) AS total_defects, (SELECT count(*) FROM results) AS papers_analyzed FROM defects WHERE paper_id IN (SELECT paper_id FROM results) GROUP BY rule_id),
  counted AS (SELECT rule_id, {_COUNTS} FROM judgments GROUP BY rule_id),
  stats AS (SELECT c.rule_id, coalesce(papers_fired, 0) AS papers_fired, coalesce(total_defects, 0) AS total_defects, (SELECT count(*) FROM results) AS papers_analyzed, coalesce(total, 0) AS total, coalesce(correct, 0) AS correct, coalesce(wrong, 0) AS wrong, coalesce(partial, 0) AS partial, precision
    FROM catalog c LEFT JOIN fired f USING (rule_id) LEFT JOIN counted k USING (rule_id))"""
_RANK = "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END"
_PRICE = " ".join(f"WHEN '{m}' THEN (input_tokens * {p[0]}::DOUBLE + output_tokens * {p[1]}::DOUBLE + cached_tokens * {p[2]}::DOUBLE) / 1e6" for m, p in PRICES.items())
_SIZE = "octet_length(encode(content))"


def _stats(select: str) -> str:
    return with_tables("defects judgments results", f"WITH {_STATS} {select}")


ORACLES: dict[str, str] = {
    "a01_judgments_by_rule": with_tables("judgments", f"SELECT rule_id, {_COUNTS} FROM judgments GROUP BY rule_id"),
    "a02_judgments_overall": with_tables("judgments", f"SELECT {_COUNTS} FROM judgments"),
    "a03_evaluation": with_tables("judgments", f"SELECT CASE WHEN rule_id IS NULL THEN 'overall' ELSE 'rule' END AS scope, rule_id, total, correct, wrong, partial, round(precision, 4) AS precision FROM (SELECT rule_id, {_COUNTS} FROM judgments GROUP BY ROLLUP (rule_id))"),
    "a04_evaluation_by_severity": with_tables("judgments defects results", f"WITH {_FINISHED} SELECT coalesce(nullif(severity, ''), 'unknown') AS severity, {_COUNTS} FROM judged WHERE coalesce(nullif(severity, ''), 'unknown') IN ('high', 'medium', 'low', 'unknown') GROUP BY 1"),
    "a05_evaluation_by_confidence": with_tables("judgments defects results", f"WITH {_FINISHED} SELECT {_BUCKET} AS bucket, {_COUNTS} FROM judged GROUP BY 1"),
    "a06_orphans": with_tables("judgments defects results", "SELECT count(*) AS orphans FROM judgments j WHERE j.paper_id NOT IN (SELECT paper_id FROM results) OR NOT EXISTS (SELECT 1 FROM defects d WHERE d.paper_id = j.paper_id AND d.defect_id = j.defect_id)"),
    "a07_export": with_tables("judgments defects results papers evidence", f"WITH {_JUDGED}, e AS (SELECT v.paper_id, v.defect_id, string_agg(u.text, '|' ORDER BY pos, v.edu_id) AS evidence FROM evidence v JOIN edus u ON u.paper_id = v.paper_id AND u.edu_id = v.edu_id GROUP BY v.paper_id, v.defect_id) SELECT j.paper_id, p.title, j.rule_id, j.defect_id, j.verdict, j.severity, j.defect_type, coalesce(evidence, '') AS evidence FROM judged j JOIN results r ON r.paper_id = j.paper_id LEFT JOIN papers p ON p.paper_id = j.paper_id LEFT JOIN e ON e.paper_id = j.paper_id AND e.defect_id = j.defect_id"),
    "a08_rule_firing": _stats("SELECT * FROM fired"),
    "a09_rule_stats": _stats("SELECT * FROM stats"),
    "a10_cost_total": with_tables("llm_calls", f"SELECT {_COST} FROM llm_calls"),
    "a11_cost_by_stage": with_tables("llm_calls", f"SELECT stage, model, {_COST} FROM llm_calls GROUP BY stage, model"),
    "a12_upload_errors": with_tables("upload_events", f"SELECT id, paper_id, created_at, error_message FROM upload_events WHERE created_at >= TIMESTAMP '{SINCE}' AND status = 'error'"),
    "a12_upload_stats": with_tables("upload_events", f"SELECT status, count(*) AS n, (sum(count(*)) OVER ())::BIGINT AS total FROM upload_events WHERE created_at >= TIMESTAMP '{SINCE}' GROUP BY status"),
    "a13_papers": with_tables("papers results", "SELECT p.paper_id, title, finished_at IS NOT NULL AS has_result, coalesce(finished_at, created_at) AS listed_at FROM papers p LEFT JOIN results r ON r.paper_id = p.paper_id"),
    "a14_finished_papers": with_tables("papers results", "SELECT p.paper_id, coalesce(nullif(trim(title), ''), nullif(filename, ''), p.paper_id) AS display_title, finished_at FROM papers p JOIN results r ON r.paper_id = p.paper_id"),
    "a15_latest_by_hash": with_tables("papers results", "SELECT content_hash, arg_max(p.paper_id, finished_at) AS paper_id, max(finished_at) AS finished_at FROM papers p JOIN results r ON r.paper_id = p.paper_id GROUP BY content_hash"),
    "a16_counts": with_tables("results defects edus", "SELECT r.paper_id, (SELECT count(*) FROM defects d WHERE d.paper_id = r.paper_id) AS defect_count, (SELECT count(*) FROM edus e WHERE e.paper_id = r.paper_id) AS edu_count FROM results r"),
    "a17_cost_by_paper": with_tables("llm_calls", "SELECT paper_id, count(*) AS calls, round(sum(cost_micro) / 1e6, 4) AS cost, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM llm_calls GROUP BY paper_id"),
    "a18_top_stages": with_tables("llm_calls", "SELECT stage, sum(cost_micro)::BIGINT AS cost_micro, count(*) AS calls FROM llm_calls GROUP BY stage ORDER BY 2 DESC, 1 LIMIT 10"),
    "a19_worst_rules": with_tables("judgments", f"SELECT rule_id, total, round(precision, 2) AS precision FROM (SELECT rule_id, {_COUNTS} FROM judgments GROUP BY rule_id)"),
    "a20_burn_and_wrong": with_tables("judgments llm_calls", "SELECT j.rule_id, coalesce(sum(cost_micro), 0)::BIGINT AS cost_micro, count(*) AS judged, sum((verdict = 'wrong')::INT)::BIGINT AS wrong FROM judgments j LEFT JOIN llm_calls c ON c.paper_id = j.paper_id AND c.stage = 'rule_check:' || j.rule_id GROUP BY j.rule_id"),
    "a20_burn_and_wrong_once": with_tables("judgments llm_calls", "SELECT j.rule_id, coalesce(sum(cost), 0)::BIGINT AS cost_micro, count(*) AS judged, sum((verdict = 'wrong')::INT)::BIGINT AS wrong FROM judgments j LEFT JOIN (SELECT paper_id, stage, sum(cost_micro) AS cost FROM llm_calls GROUP BY paper_id, stage) c ON c.paper_id = j.paper_id AND c.stage = 'rule_check:' || j.rule_id GROUP BY j.rule_id"),
    "a21_json_extract": with_tables("defects", "SELECT paper_id, count(*) AS n_defects, arg_min(rule_id, pos) AS first_rule FROM defects GROUP BY paper_id"),
    "a22_json_each": with_tables("defects", "SELECT paper_id, rule_id, count(*) AS defect_count FROM defects GROUP BY paper_id, rule_id"),
    "a23_context_share": with_tables("llm_calls", "SELECT id, stage, model, round(input_tokens * 100.0::DOUBLE / CASE WHEN contains(model, '[1m]') THEN 1000000 ELSE 200000 END, 2) AS share FROM llm_calls ORDER BY share DESC, id LIMIT 10"),
    "a24_phase": with_tables("judgments", "SELECT rule_id, count(*) AS n, CASE WHEN count(*) >= 3 THEN 'active' ELSE 'collecting' END AS phase FROM judgments GROUP BY rule_id"),
    "a25_kpis": _stats("SELECT sum(total_defects)::BIGINT AS defects, sum(total)::BIGINT AS judged, (sum(correct) + sum(partial) * 0.5::DOUBLE) / sum(total)::DOUBLE AS precision FROM stats"),
    "a26_fire_rates": _stats("SELECT rule_id, CASE WHEN papers_analyzed > 0 THEN papers_fired / papers_analyzed ELSE 0.0::DOUBLE END AS fire_rate FROM stats"),
    "a27_rule_status": _stats("SELECT rule_id, CASE WHEN papers_analyzed = 0 THEN 'no data' WHEN papers_fired = 0 THEN 'never fired' WHEN total >= 3 AND precision < 0.5 THEN 'review' WHEN total >= 3 AND precision >= 0.7 THEN 'good' WHEN papers_fired / papers_analyzed > 0.8 THEN 'high fire' ELSE 'working' END AS status FROM stats"),
    "a28_badges": with_tables("defects", "SELECT CASE WHEN confidence IS NULL THEN 'none' WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS badge, count(*) AS n FROM defects GROUP BY 1"),
    "a29_bucket_shares": with_tables("judgments defects results", f"WITH {_FINISHED} SELECT {_BUCKET} AS bucket, count(*) * 100.0::DOUBLE / (sum(count(*)) OVER ())::DOUBLE AS share FROM judged GROUP BY 1"),
    "a30_verdicts_of_result": with_tables("defects judgments", "SELECT d.paper_id, count(verdict) AS judged, count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'wrong') AS wrong, count(*) FILTER (verdict = 'partial') AS partial FROM defects d LEFT JOIN judgments j ON j.paper_id = d.paper_id AND j.defect_id = d.defect_id GROUP BY d.paper_id"),
    "a31_by_severity": with_tables("defects", f"SELECT paper_id, ({_RANK})::BIGINT AS place, severity, string_agg(defect_id, '|' ORDER BY pos) AS defect_ids FROM defects WHERE severity IN ('high', 'medium', 'low') GROUP BY 1, 2, 3"),
    "a32_by_rule": with_tables("defects", f"SELECT paper_id, rule_id, arg_min(defect_type, pos) AS label, string_agg(defect_id, '|' ORDER BY {_RANK}, pos) AS defect_ids FROM defects GROUP BY paper_id, rule_id"),
    "a33_token_cost": with_tables("llm_calls", f"SELECT id, model, round(coalesce(CASE split_part(model, '[', 1) {_PRICE} END, 0), 6) AS cost FROM llm_calls"),
    "a34_usage_split": with_tables("llm_calls", "SELECT id, greatest(input_tokens - cached_tokens, 0)::BIGINT AS fresh_tokens, cached_tokens FROM llm_calls"),
    "a35_cross_section": with_tables("defects", "SELECT paper_id, count(*) AS defects, count(*) FILTER (rule_id IN ('REL-04', 'REL-08', 'REL-12')) AS cross_section FROM defects GROUP BY paper_id"),
    "a36_labels": with_tables("chat_messages", f"SELECT id, CASE WHEN {_SIZE} = 0 THEN '' WHEN {_SIZE} < 1024 THEN {_SIZE} || ' B' ELSE (({_SIZE} + 512) // 1024) || ' KB' END AS size, CASE WHEN length(content) > 160 THEN substr(content, 1, 160) || '…' ELSE content END AS preview FROM chat_messages"),
    "a37_ages": with_tables("upload_events", f"WITH m AS (SELECT id, created_at, (floor(epoch(TIMESTAMP '{NOW}')) - floor(epoch(created_at))) // 60 AS minutes FROM upload_events) SELECT id, CASE WHEN minutes < 1 THEN 'now' WHEN minutes < 60 THEN minutes::BIGINT || ' min' WHEN minutes < 1440 THEN (minutes // 60)::BIGINT || ' h' ELSE strftime(created_at, '%Y-%m-%d') END AS age FROM m"),
}
