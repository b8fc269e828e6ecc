"""Registered queries of verdicts (V), text functions (X) and statistics (E), with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import aggregates as A
from .operators import statistics as E
from .operators import verdicts as V
from .sources import standins as S
from .sources.standins_sql import with_tables

Query = Callable[[SparkSession, str], DataFrame]


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairwise judgments, of events: (model, paper_id, arm1, arm2, pos, winner, consistent)."""
    e = S.table(spark, sf_dir, "events")
    label = lambda n: F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("tie")), (F.pmod(n, F.lit(3)) + 1).cast("int"))
    n = F.floor(F.col("value") * 100)
    winner, same = E.e05_swap_verdict(label(n), label(F.floor(n / 3)))
    return e.select(F.col("event_type").alias("model"), F.col("user_id").cast("string").alias("paper_id"), F.lit("A").alias("arm1"), F.when(n % 2 == 0, "B").otherwise("C").alias("arm2"), F.col("event_id").alias("pos"), winner.alias("winner"), same.alias("consistent"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("paper_id"), F.col("event_id").alias("candidate_index"), F.col("event_type").alias("rule_id"), (F.col("value") > 5).alias("violates"), F.col("props").alias("description"), F.when(F.col("event_type") == "error", "high").otherwise(F.col("event_type")).alias("severity"), F.when(F.col("event_type") == "view", "Method").alias("section"), F.when(F.col("event_type") == "click", "?").otherwise((F.floor(F.col("value") * 100) / 1000).cast("string")).alias("confidence"))


def _texts(**columns: Callable[[Column], Column]) -> Query:
    return lambda spark, sf_dir: S.table(spark, sf_dir, "documents").select("doc_id", *(f(F.col("text")).alias(k) for k, f in columns.items()))


def _pages(**columns: Callable[[Column], Column]) -> Query:
    return lambda spark, sf_dir: S.table(spark, sf_dir, "pages").select("page_id", *(f(F.col("url")).alias(k) for k, f in columns.items()))


def _meta(s: SparkSession, d: str) -> DataFrame:
    return V.check_meta(verdicts(s, d), V.accepted(verdicts(s, d)))


def _findings(s: SparkSession, d: str) -> DataFrame:
    units = S.edus(s, d)
    return V.normalized_findings(S.defects(s, d), A.evidence_texts(S.evidence(units), units))


QUERIES: dict[str, Query] = {
    "v01_check_meta": _meta,
    "v02_accepted": lambda s, d: V.accepted(verdicts(s, d)).select("candidate_index", "severity", "section", "confidence"),
    "v06_payload_cap": lambda s, d: V.capped_payload(S.edus(s, d).select("paper_id", F.col("k").alias("pos"), F.col("text").alias("json")), 120_000),
    "v09_cross_section": lambda s, d: V.cross_section(S.defects(s, d), S.evidence(S.edus(s, d)), S.edus(s, d)),
    "v11_locale_pick": lambda s, d: S.table(s, d, "documents").select("doc_id", V.picked(F.create_map(F.coalesce("lang", F.lit("?")), F.coalesce("source", F.lit("")), F.lit("zh-Hant"), F.lit("")), F.lit("en"), "fr").alias("picked")),
    "v13_single_section": lambda s, d: S.defects(s, d).where(~F.col("rule_id").isin(*V.NOT_IN_DRAFTS)).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")),
    "v14_memo_keys": lambda s, d: S.table(s, d, "documents").select("doc_id", V.memo_key(F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit("")), "1").alias("cache_key")),
    "v15_merged_drafts": lambda s, d: V.merged_draft(S.edus(s, d).select("paper_id", F.col("k").alias("pos"), "text"), 40_000),
    "v17_findings": _findings,
    "x06_garbled": _texts(garbled=X.garbled),
    "x07_sentences": _texts(n=lambda t: F.size(X.sentences(t)).cast("long"), joined=lambda t: F.array_join(X.sentences(t), "|")),
    "x14_counts": _texts(chars=lambda t: X.char_count(t).cast("long"), words=lambda t: X.word_count(t).cast("long")),
    "x18_ends_sentence": _texts(ends=X.ends_sentence),
    "x24_doi": _texts(doi=X.doi),
    "x25_stripped_tags": lambda s, d: S.table(s, d, "pages").select("page_id", X.stripped_tags(F.col("html")).alias("text")),
    "x26_hosts": _pages(host=X.host, trusted=lambda u: X.trusted(u, ("example.com",))),
    "x33_cjk": _texts(cjk=X.has_cjk),
    "f12_html_escape": lambda s, d: S.table(s, d, "pages").select("page_id", X.html_escaped(F.col("html")).alias("escaped")),
    "e01_win_rates": lambda s, d: E.e01_win_rates(judged(s, d)),
    "e02_agreement": lambda s, d: E.e02_agreement(judged(s, d)),
    "e03_alpha": lambda s, d: E.e03_alpha(judged(s, d)),
    "e04_consistency": lambda s, d: E.e04_consistency(S.edus(s, d).groupBy("paper_id").agg(F.count(F.lit(1)).alias("n")).join(S.papers(s, d), "paper_id").select(F.substring("filename", 1, 4).alias("group"), F.col("paper_id").alias("run"), "n")),
    "e07_audit": lambda s, d: E.e07_audit(A.a01_judgments_by_rule(S.judgments(s, d)).select("rule_id", "total"), A.a01_judgments_by_rule(S.judgments(s, d).where("verdict <> 'partial'")).select("rule_id", "total"), ["rule_id"], "total").select("rule_id", F.col("stored.total").alias("stored"), F.col("recomputed.total").alias("recomputed")),
    "e09_findings": lambda s, d: E.e09_findings(S.defects(s, d).withColumnRenamed("defect_type", "arm"), ("type0", "type1")),
}

_LABELS = "['a', 'b', 'tie']"
_JUDGED = f"""l AS (SELECT *, floor(value * 100)::BIGINT AS n, {_LABELS}[((floor(value * 100)::BIGINT % 3) + 3) % 3 + 1] AS one, {_LABELS}[((floor(floor(value * 100) / 3)::BIGINT % 3) + 3) % 3 + 1] AS two FROM events),
  b AS (SELECT *, CASE two WHEN 'a' THEN 'b' WHEN 'b' THEN 'a' ELSE two END AS back FROM l),
  judged AS (SELECT event_type AS model, user_id::VARCHAR AS paper_id, 'A' AS arm1, CASE WHEN n % 2 = 0 THEN 'B' ELSE 'C' END AS arm2, event_id AS pos, CASE WHEN one = back AND one <> 'tie' THEN one ELSE 'tie' END AS winner, one = back AS consistent FROM b),
  last AS (SELECT paper_id, arm1, arm2, model, arg_max(winner, pos) AS winner FROM judged GROUP BY 1, 2, 3, 4)"""
_VERDICTS = """verdicts AS (SELECT user_id::VARCHAR AS paper_id, event_id AS candidate_index, event_type AS rule_id, value > 5 AND coalesce(trim(props), '') <> '' AS holds,
  CASE WHEN event_type = 'error' THEN 'high' ELSE 'medium' END AS severity, CASE WHEN event_type = 'view' THEN 'Method' ELSE 'Other' END AS section,
  CASE WHEN event_type = 'click' THEN NULL ELSE greatest(0, least(1, floor(value * 100) / 1000)) END AS confidence FROM events)"""

ORACLES: dict[str, str] = {
    "v01_check_meta": f"WITH {_VERDICTS} SELECT paper_id, rule_id, count(*) AS candidate_count, count(*) FILTER (holds) AS defect_count FROM verdicts GROUP BY paper_id, rule_id",
    "v02_accepted": f"WITH {_VERDICTS} SELECT candidate_index, severity, section, confidence FROM verdicts WHERE holds",
    "v06_payload_cap": with_tables("edus", "WITH t AS (SELECT paper_id, sum(length(text) + 2) OVER (PARTITION BY paper_id ORDER BY k) AS total FROM edus) SELECT paper_id, count(*) FILTER (total <= 120000) AS kept, count(*) FILTER (total > 120000) AS dropped FROM t GROUP BY paper_id"),
    "v09_cross_section": with_tables("defects evidence", "SELECT d.paper_id, d.defect_id, d.rule_id, count(*) AS units FROM defects d JOIN evidence v ON v.paper_id = d.paper_id AND v.defect_id = d.defect_id WHERE rule_id IN ('REL-04', 'REL-08', 'REL-12') GROUP BY 1, 2, 3 HAVING count(*) >= 2"),
    "v11_locale_pick": "SELECT doc_id, coalesce(nullif(CASE WHEN lang IS NOT NULL THEN source END, ''), nullif(source, ''), '') AS picked FROM documents",
    "v13_single_section": with_tables("defects", "SELECT rule_id, count(*) AS n FROM defects WHERE rule_id NOT IN ('REL-04', 'REL-08', 'REL-12') GROUP BY rule_id"),
    "v14_memo_keys": "SELECT doc_id, sha256(replace(replace(coalesce(text, ''), '\\', '\\\\'), '|', '\\|') || '|' || replace(replace(coalesce(lang, ''), '\\', '\\\\'), '|', '\\|') || '|1') AS cache_key FROM documents",
    "v15_merged_drafts": with_tables("edus", "SELECT paper_id, substr(string_agg(trim(text), chr(10) || chr(10) ORDER BY k), 1, 40000) AS draft FROM edus WHERE trim(text) <> '' GROUP BY paper_id"),
    "v17_findings": with_tables("defects evidence edus", "WITH e AS (SELECT v.paper_id, v.defect_id, string_agg(text, ' / ' ORDER BY pos, v.edu_id) AS location FROM evidence v JOIN edus u ON u.paper_id = v.paper_id AND u.edu_id = v.edu_id GROUP BY 1, 2) SELECT d.paper_id, coalesce(location, '') AS location, coalesce(nullif(defect_type, ''), rule_id) AS issue_type FROM defects d LEFT JOIN e ON e.paper_id = d.paper_id AND e.defect_id = d.defect_id"),
    "x06_garbled": "SELECT doc_id, CASE WHEN length(h) < 200 THEN false ELSE length(regexp_replace(h, '[^`*~^|]', '', 'g')) * 100 > length(h) * 3 END AS garbled FROM (SELECT doc_id, substr(text, 1, 4000) AS h FROM documents)",
    "x07_sentences": "SELECT doc_id, len(s)::BIGINT AS n, array_to_string(s, '|') AS joined FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '(?s).+?[。．.!?！？\n]+|.+'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: length(x) >= 20)[1:400] AS s FROM documents)",
    "x14_counts": "SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) AS chars, len(regexp_extract_all(text, '\\S+')) AS words FROM documents",
    "x18_ends_sentence": "SELECT doc_id, regexp_matches(text, '[。．.！？!?；;：:…][」』〉》）)\\]｝}＞>\"''\\s]*$') AS ends FROM documents",
    "x24_doi": "SELECT doc_id, regexp_replace(regexp_extract(text, '10\\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+'), '[.,);]+$', '') AS doi FROM documents",
    "x25_stripped_tags": "SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages",
    "x26_hosts": "SELECT page_id, host, host = 'example.com' OR ends_with(host, '.example.com') AS trusted FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', '') AS host FROM pages)",
    "x33_cjk": "SELECT doc_id, regexp_matches(text, '[一-鿿]') AS cjk FROM documents",
    "f12_html_escape": "SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages",
    "e01_win_rates": f"WITH {_JUDGED} SELECT model, arm1, arm2, count(*) AS n, count(*) FILTER (winner = 'a') AS wins1, count(*) FILTER (winner = 'b') AS wins2, count(*) FILTER (winner = 'tie') AS ties, round(count(*) FILTER (NOT consistent) / count(*), 3) AS swap_rate FROM judged GROUP BY model, arm1, arm2",
    "e02_agreement": f"WITH {_JUDGED}, u AS (SELECT count(*) AS m, count(DISTINCT winner) AS k FROM last GROUP BY paper_id, arm1, arm2) SELECT count(*) AS units, round(count(*) FILTER (k = 1) / count(*), 3) AS agreement FROM u WHERE m >= 2",
    "e03_alpha": f"WITH {_JUDGED}, m AS (SELECT *, count(*) OVER (PARTITION BY paper_id, arm1, arm2) AS m FROM last), p AS (SELECT x.winner AS c, y.winner AS k, 1.0::DOUBLE / (x.m - 1) AS w FROM m x JOIN m y ON x.paper_id = y.paper_id AND x.arm1 = y.arm1 AND x.arm2 = y.arm2 AND x.model <> y.model WHERE x.m >= 2), t AS (SELECT c, sum(w) AS n FROM p GROUP BY c), s AS (SELECT sum(n) AS n, sum(n) * sum(n) - sum(n * n) AS d FROM t) SELECT round(1 - (SELECT sum(w) FROM p WHERE c <> k) / (d / (n - 1)), 3) AS alpha FROM s",
    "e04_consistency": with_tables("edus papers", "WITH r AS (SELECT substr(filename, 1, 4) AS g, n FROM papers p JOIN (SELECT paper_id, count(*) AS n FROM edus GROUP BY paper_id) e ON e.paper_id = p.paper_id) SELECT g AS \"group\", count(*) AS runs, round(avg(n), 3) AS mean, round(stddev_pop(n), 3) AS sd, round(stddev_pop(n) / avg(n), 3) AS cv FROM r GROUP BY g"),
    "e07_audit": with_tables("judgments", "SELECT rule_id, stored, recomputed FROM (SELECT rule_id, count(*) AS stored, nullif(count(*) FILTER (verdict <> 'partial'), 0) AS recomputed FROM judgments GROUP BY rule_id) WHERE stored IS DISTINCT FROM recomputed"),
    "e09_findings": with_tables("defects", "SELECT paper_id, count(*) FILTER (defect_type = 'type0') AS type0, count(*) FILTER (defect_type = 'type1') AS type1 FROM defects GROUP BY paper_id"),
}
