"""The stand-in tables of standins.py as DuckDB common table expressions, for the queries that check the operators."""

from __future__ import annotations

from ..schema import ENTITY_TYPES, FUNCTIONS, RST_TYPES, SECTIONS


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _edu_name(k: str) -> str:
    rank = f"floor(({k}) * 8 / n)::INTEGER"
    return f"(paper_id || ':' || {_list(SECTIONS)}[{rank} + 1] || ':edu:' || (({k}) - ceil({rank} * n / 8))::INTEGER::VARCHAR)"


_RULE = "'REL-' || lpad((({}) % 13 + 1)::VARCHAR, 2, '0')"

TABLES = {
    "edus": rf"""
  SELECT paper_id, doc_id, k, n, {_list(SECTIONS)}[floor(k * 8 / n)::INTEGER + 1] AS section, floor(k * 8 / n)::INTEGER AS section_rank,
    (k - ceil(floor(k * 8 / n)::INTEGER * n / 8))::INTEGER AS ord, {_edu_name("k")} AS edu_id, text
  FROM (
    SELECT doc_id, doc_id::VARCHAR AS paper_id, len(s)::INTEGER AS n, unnest(range(len(s)))::INTEGER AS k, unnest(s) AS text FROM (
      SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '(?s).+?[.!?\n]+|.+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) >= 20) AS s
      FROM documents))""",
    "papers": "SELECT doc_id::VARCHAR AS paper_id, substr(text, 1, 40) AS title, source || '/' || doc_id || '.md' AS filename, sha256(text) AS content_hash, doc_id AS created_at FROM documents",
    "frus_": "SELECT *, paper_id || ':fru:' || k AS fru_id FROM edus WHERE (k + doc_id) % 3 <> 1 OR k = 0",
    "frus": f"SELECT paper_id, fru_id, {_list(FUNCTIONS)}[(doc_id * 7 + k * 13 + length(text)) % 15 + 1] AS function, substr(text, 1, 60) AS summary FROM frus_",
    "covers": f"""
  SELECT paper_id, fru_id, 0 AS pos, {_edu_name("k")} AS edu_id FROM frus_
  UNION ALL SELECT paper_id, fru_id, 1, {_edu_name("k + 1")} FROM frus_ WHERE (k + doc_id) % 3 = 0 AND k + 1 < n""",
    "rst": f"SELECT paper_id, paper_id || ':rst:' || k AS rst_id, {_list(RST_TYPES)}[(doc_id + k) % 15 + 1] AS rst_type FROM edus WHERE k % 5 = 0",
    "rst_edges": f"""
  SELECT paper_id, paper_id || ':rst:' || k AS rst_id, edu_id, 'NUCLEUS' AS role FROM edus WHERE k % 5 = 0
  UNION ALL SELECT paper_id, paper_id || ':rst:' || k, {_edu_name("k + 1")}, 'SATELLITE' FROM edus WHERE k % 5 = 0 AND k + 1 < n""",
    "er_triples": """
  SELECT paper_id, paper_id || ':rel:' || k AS rel_id, w[1] AS src, w[2] AS tgt, ['uses', 'improves', 'extends'][length(w[1]) % 3 + 1] AS predicate, edu_id AS evidence_edu_id
  FROM (SELECT *, regexp_extract_all(lower(text), '[a-z]{8,}') AS w FROM edus WHERE k % 4 = 0) WHERE len(w) >= 2""",
    "entities": f"""
  SELECT paper_id, paper_id || ':ent:' || name AS entity_id, name, {_list(ENTITY_TYPES)}[length(name) % 8 + 1] AS type
  FROM (SELECT paper_id, src AS name FROM er_triples UNION SELECT paper_id, tgt FROM er_triples)""",
    "mentioned_in": """
  SELECT paper_id, paper_id || ':ent:' || name AS entity_id, edu_id
  FROM (SELECT paper_id, src AS name, evidence_edu_id AS edu_id FROM er_triples UNION SELECT paper_id, tgt, evidence_edu_id FROM er_triples)""",
    "defects": f"""
  SELECT doc_id::VARCHAR AS paper_id, doc_id || ':d' || j AS defect_id, j AS pos, {_RULE.format("((doc_id + j - 1) % 12)")} AS rule_id,
    CASE WHEN (doc_id + j) % 11 <> 0 THEN ['high', 'medium', 'low', 'critical'][(doc_id + j) % 4 + 1] END AS severity,
    CASE WHEN (doc_id + j) % 7 <> 0 THEN ((doc_id * 3 + j) % 11) / 10.0::DOUBLE END AS confidence, 'type' || j % 2 AS defect_type
  FROM (SELECT doc_id, unnest(range(1, doc_id % 3 + 2))::INTEGER AS j FROM documents)""",
    "judgments": f"""
  SELECT doc_id::VARCHAR AS paper_id, doc_id || ':d' || CASE WHEN doc_id % 17 = 0 THEN 9 ELSE 1 END AS defect_id, {_RULE.format("doc_id")} AS rule_id,
    CASE WHEN quality <> 1 THEN 'wrong' WHEN toxic = 1 THEN 'partial' ELSE 'correct' END AS verdict, doc_id AS created_at FROM labels""",
    "llm_calls": f"""
  SELECT conv_id * 1000 + turn AS id, CASE WHEN conv_id % 10 <> 0 THEN conv_id::VARCHAR END AS paper_id, 'rule_check:' || {_RULE.format("turn")} AS stage,
    CASE role WHEN 'system' THEN 'large-heavy[1m]' WHEN 'user' THEN 'mid' ELSE 'small-light' END AS model, length(text)::BIGINT AS input_tokens,
    floor(length(text) / 4)::BIGINT AS output_tokens, turn * 10 AS cached_tokens, length(text) * 3 + floor(length(text) / 4)::BIGINT * 15 AS cost_micro, turn AS created_at FROM conversations""",
    "results": "SELECT doc_id::VARCHAR AS paper_id, doc_id + 10 AS finished_at FROM documents WHERE length(text) >= 200",
    "evidence": """
  SELECT paper_id, paper_id || ':d' || (k + 1) AS defect_id, 0 AS pos, edu_id FROM edus WHERE k < 4
  UNION ALL SELECT paper_id, paper_id || ':d' || k, 1, edu_id FROM edus WHERE k BETWEEN 1 AND 3""",
    "chat_messages": "SELECT conv_id * 1000 + turn AS id, conv_id::VARCHAR AS paper_id, role, text AS content FROM conversations",
    "upload_events": """
  SELECT event_id AS id, user_id::VARCHAR AS paper_id, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' WHEN 'view' THEN 'cached' ELSE 'pending' END AS status,
    ts AS created_at, floor(abs(value) * 1000)::BIGINT AS file_size, CASE WHEN event_type = 'error' THEN 'disk full at ' || user_id END AS error_message FROM events""",
}
NEEDS = {"evidence": ["edus"], "frus_": ["edus"], "frus": ["frus_"], "covers": ["frus_"], "rst": ["edus"], "rst_edges": ["edus"], "er_triples": ["edus"], "entities": ["er_triples"], "mentioned_in": ["er_triples"]}


def with_tables(names: str, query: str) -> str:
    """query after the definitions of the tables named, and of those that they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    own = query.strip()
    tables = ",\n".join(f"{n} AS MATERIALIZED ({TABLES[n]})" for n in order)
    return f"WITH {tables},\n{own.removeprefix('WITH')}" if own.startswith("WITH ") else f"WITH {tables}\n{own}"
