"""Registered queries of the graph rules, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import rules as R
from .sources import standins as S
from .sources.standins_sql import with_tables


def graph(spark: SparkSession, sf_dir: str) -> R.Graph:
    units = S.edus(spark, sf_dir)
    triples = S.er_triples(units)
    return R.Graph(S.papers(spark, sf_dir), units, S.frus(units), S.covers(units), S.rst(units), S.rst_edges(units), S.entities(triples), S.mentioned_in(triples))


def _of_graph(f: Callable[[R.Graph], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(graph(spark, sf_dir))


def _evidence(g: R.Graph) -> DataFrame:
    """Of each paper a function, a unit, an unknown id and the unit again."""
    rows = g.edus.where("k < 3").groupBy("paper_id").agg(F.max("edu_id").alias("last"))
    return rows.select("paper_id", F.lit(1).alias("item"), F.array(F.concat("paper_id", F.lit(":fru:0")), "last", F.lit("none"), "last").alias("ids"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "r01_claim_evidence": _of_graph(R.r01_claim_evidence),
    "r02_baseline_critique": _of_graph(R.r02_baseline_critique),
    "r03_action_justification": _of_graph(R.r03_action_justification),
    "r04_macro_decomposition": _of_graph(R.r04_macro_decomposition),
    "r05_process_sequence": _of_graph(R.r05_process_sequence),
    "r06_concept_formalization": _of_graph(R.r06_concept_formalization),
    "r07_setup_scoping": _of_graph(R.r07_setup_scoping),
    "r08_problem_solution": _of_graph(R.r08_problem_solution),
    "r09_observation_attribution": _of_graph(R.r09_observation_attribution),
    "r10_concession_compensation": _of_graph(R.r10_concession_compensation),
    "r11_specific_generalization": _of_graph(R.r11_specific_generalization),
    "r12_core_restatement": _of_graph(R.r12_core_restatement),
    "r13_meta_discourse": _of_graph(R.r13_meta_discourse),
    "r15_resolve_evidence": _of_graph(lambda g: R.r15_resolve_evidence(g, _evidence(g))),
    "r16_papers_with_units": _of_graph(R.r16_papers_with_units),
    "r17_graph_edges": _of_graph(R.r17_graph_edges),
    "r17_graph_nodes": _of_graph(R.r17_graph_nodes),
    "r18_unit": _of_graph(lambda g: R.r18_unit(g, "3", "3:Method:edu:0").select("paper_id", "edu_id", "section", "text")),
    "r19_cleared": _of_graph(lambda g: R.r19_cleared(g.frus, g.papers.where("title like 'T%'"))),
    "r20_repeated_ids": lambda spark, sf_dir: R.r20_repeated_ids(S.judgments(spark, sf_dir), "rule_id"),
    "v08_section_dump": _of_graph(lambda g: R.v08_section_dump(g.edus, 400_000)),
    "v18_structure": _of_graph(R.v18_structure),
    "v19_full_text": _of_graph(lambda g: R.v19_full_text(g.edus)),
}

_COVERED = "WITH covered AS (SELECT f.paper_id, f.fru_id, f.function, f.summary, c.pos, e.edu_id, e.section, e.section_rank, e.ord, e.text FROM frus f JOIN covers c USING (paper_id, fru_id) JOIN edus e USING (paper_id, edu_id))"


def _gap(anchor: str, support: str, back: int, forward: int, where: str = "true") -> str:
    return with_tables(
        "edus frus covers",
        f"""{_COVERED}, spans AS (
  SELECT paper_id, fru_id, section, min(ord) AS span_start, max(ord) AS span_end, any_value(summary) AS summary
  FROM covered WHERE function = '{anchor}' AND {where} GROUP BY ALL)
SELECT * FROM spans s WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.function = '{support}' AND c.paper_id = s.paper_id AND c.section = s.section
  AND c.ord BETWEEN s.span_start - {back} AND s.span_end + {forward})""".replace("GROUP BY ALL", "GROUP BY paper_id, fru_id, section"),
    )


def _section_list(section: str) -> str:
    return with_tables("edus papers", f"SELECT p.paper_id, coalesce(string_agg(edu_id, '|' ORDER BY ord), '') AS edu_ids, count(edu_id) AS n FROM papers p LEFT JOIN edus e ON e.paper_id = p.paper_id AND section = '{section}' GROUP BY p.paper_id")


_SET = "string_agg(DISTINCT {0}, '|' ORDER BY {0})"

ORACLES: dict[str, str] = {
    "r17_graph_nodes": with_tables("edus frus rst entities", "SELECT paper_id, 'EDU' AS label, edu_id AS id, text FROM edus UNION ALL SELECT paper_id, 'FRU', fru_id, function FROM frus UNION ALL SELECT paper_id, 'RST', rst_id, rst_type FROM rst UNION ALL SELECT paper_id, 'Entity', entity_id, name FROM entities"),
    "r18_unit": with_tables("edus", "SELECT paper_id, edu_id, section, text FROM edus WHERE paper_id = '3' AND edu_id = '3:Method:edu:0'"),
    "r01_claim_evidence": with_tables(
        "edus frus covers rst rst_edges",
        f"""{_COVERED}, touched AS (
  SELECT paper_id, edu_id FROM covered WHERE function = 'Evidence'
  UNION SELECT paper_id, edu_id FROM rst JOIN rst_edges USING (paper_id, rst_id) WHERE rst_type = 'Evidence')
SELECT paper_id, fru_id, any_value(summary) AS summary, string_agg(edu_id, '|' ORDER BY pos) AS edu_ids, string_agg(text, '|' ORDER BY pos) AS edu_texts, arg_min(section, section_rank * 100000 + ord) AS section
FROM covered c WHERE function = 'Claim' AND NOT EXISTS (SELECT 1 FROM covered x JOIN touched t ON x.paper_id = t.paper_id AND x.edu_id = t.edu_id WHERE x.fru_id = c.fru_id AND x.paper_id = c.paper_id)
GROUP BY paper_id, fru_id""",
    ),
    "r02_baseline_critique": with_tables("edus entities mentioned_in", f"SELECT e.paper_id, e.entity_id, e.name, {_SET.format('u.edu_id')} AS edu_ids, {_SET.format('u.section')} AS sections FROM entities e JOIN mentioned_in m ON m.paper_id = e.paper_id AND m.entity_id = e.entity_id JOIN edus u ON u.paper_id = e.paper_id AND u.edu_id = m.edu_id WHERE (contains(e.name, 'baseline') OR e.type = 'Method') AND u.section IN ('Method', 'Experiment', 'Results') GROUP BY e.paper_id, e.entity_id, e.name"),
    "r03_action_justification": _gap("MethodStep", "Motivation", 8, 3),
    "r09_observation_attribution": _gap("Observation", "Attribution", 3, 8, "section IN ('Results', 'Discussion', 'Experiment')"),
    "r10_concession_compensation": _gap("Concession", "Compensation", 3, 8),
    "r04_macro_decomposition": with_tables("papers edus frus covers", f"{_COVERED} SELECT p.paper_id, coalesce({_SET.format('function')}, '') AS functions FROM papers p LEFT JOIN covered c ON c.paper_id = p.paper_id AND section = 'Introduction' GROUP BY p.paper_id"),
    "r05_process_sequence": _section_list("Method"),
    "r06_concept_formalization": with_tables("edus entities mentioned_in", f"SELECT e.paper_id, e.entity_id, e.name, e.type, coalesce({_SET.format('m.edu_id')}, '') AS edu_ids FROM entities e LEFT JOIN mentioned_in m ON m.paper_id = e.paper_id AND m.entity_id = e.entity_id WHERE type IN ('Concept', 'Metric') GROUP BY e.paper_id, e.entity_id, e.name, e.type"),
    "r07_setup_scoping": _section_list("Experiment"),
    "r08_problem_solution": with_tables("papers edus frus covers", f"{_COVERED}, i AS (SELECT DISTINCT paper_id, section, fru_id || '=' || function AS x FROM covered) SELECT p.paper_id, coalesce(string_agg(x, '|' ORDER BY x) FILTER (section = 'Introduction'), 'null=null') AS introduction, coalesce(string_agg(x, '|' ORDER BY x) FILTER (section = 'Method'), 'null=null') AS method FROM papers p LEFT JOIN i ON i.paper_id = p.paper_id GROUP BY p.paper_id"),
    "r11_specific_generalization": with_tables("edus frus", "SELECT paper_id, coalesce(string_agg(fru_id, '|' ORDER BY fru_id) FILTER (function = 'Specific'), '') AS specific, coalesce(string_agg(fru_id, '|' ORDER BY fru_id) FILTER (function = 'Generalization'), '') AS generalization FROM frus WHERE function IN ('Specific', 'Generalization') GROUP BY paper_id"),
    "r12_core_restatement": with_tables("papers edus", "WITH t AS (SELECT DISTINCT paper_id, section, text FROM edus) SELECT p.paper_id, coalesce(string_agg(text, '|' ORDER BY text) FILTER (section = 'Abstract'), '') AS abstract, coalesce(string_agg(text, '|' ORDER BY text) FILTER (section = 'Conclusion'), '') AS conclusion FROM papers p LEFT JOIN t ON t.paper_id = p.paper_id GROUP BY p.paper_id"),
    "r13_meta_discourse": with_tables("edus frus covers", f"{_COVERED}, m AS (SELECT paper_id, fru_id, string_agg(edu_id, '|' ORDER BY pos) AS edu_ids, arg_min(section, section_rank * 100000 + ord) AS section FROM covered WHERE function = 'MetaDiscourse' GROUP BY paper_id, fru_id), l AS (SELECT paper_id, string_agg(fru_id || '>' || section || '>' || edu_ids, '|' ORDER BY fru_id || '>' || section || '>' || edu_ids) AS meta FROM m GROUP BY paper_id) SELECT e.paper_id, {_SET.format('section')} AS sections, coalesce(any_value(meta), '') AS meta FROM edus e LEFT JOIN l ON l.paper_id = e.paper_id GROUP BY e.paper_id"),
    "r15_resolve_evidence": with_tables(
        "edus covers",
        """WITH w AS (SELECT paper_id, unnest([paper_id || ':fru:0', max(edu_id), 'none', max(edu_id)]) AS id, unnest([0, 1, 2, 3]) AS place_ FROM edus WHERE k < 3 GROUP BY paper_id),
r AS (SELECT w.paper_id, w.place_, 0 AS pos, w.id AS edu_id FROM w JOIN edus e ON e.paper_id = w.paper_id AND e.edu_id = w.id
  UNION ALL SELECT w.paper_id, w.place_, c.pos, c.edu_id FROM w JOIN covers c ON c.paper_id = w.paper_id AND c.fru_id = w.id),
f AS (SELECT paper_id, edu_id, min(place_ * 10 + pos) AS place FROM r GROUP BY paper_id, edu_id)
SELECT paper_id, 1 AS item, string_agg(edu_id, '|' ORDER BY place) AS edu_ids FROM f GROUP BY paper_id""",
    ),
    "r16_papers_with_units": with_tables("edus", "SELECT DISTINCT paper_id FROM edus"),
    "r17_graph_edges": with_tables("edus frus covers rst_edges mentioned_in", "WITH x AS (SELECT paper_id, 'COVERS' AS kind, fru_id AS from_id, edu_id AS to_id FROM covers UNION ALL SELECT paper_id, role, rst_id, edu_id FROM rst_edges UNION ALL SELECT paper_id, 'MENTIONED_IN', entity_id, edu_id FROM mentioned_in) SELECT x.* FROM x JOIN edus e ON e.paper_id = x.paper_id AND e.edu_id = x.to_id"),
    "r19_cleared": with_tables("edus frus papers", "SELECT * FROM frus WHERE paper_id NOT IN (SELECT paper_id FROM papers WHERE title LIKE 'T%')"),
    "r20_repeated_ids": with_tables("judgments", "SELECT rule_id, count(*) AS n FROM judgments GROUP BY rule_id HAVING count(*) > 1"),
    "v08_section_dump": with_tables("edus", "SELECT paper_id, substr(string_agg('[' || edu_id || '] ' || text, chr(10) ORDER BY section_rank, ord), 1, 400000) AS dump FROM edus GROUP BY paper_id"),
    "v18_structure": with_tables("edus frus covers", f"{_COVERED}, l AS (SELECT paper_id, fru_id || ' ' || function || ' ' || coalesce(nullif(summary, ''), substr(string_agg(text, ' ' ORDER BY pos), 1, 120)) AS line FROM covered GROUP BY paper_id, fru_id, function, summary) SELECT paper_id, string_agg(line, chr(10) ORDER BY line) AS structure FROM l GROUP BY paper_id"),
    "v19_full_text": with_tables("edus", "SELECT paper_id, string_agg(text, chr(10) ORDER BY section_rank, ord) AS full_text FROM edus GROUP BY paper_id"),
}
