"""Graph-pattern rules R01-R19, for all papers at once; frames as in the data model, keyed by paper_id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SECTIONS


@dataclass
class Graph:
    """The frames of a corpus's discourse graph."""

    papers: DataFrame
    edus: DataFrame
    frus: DataFrame
    covers: DataFrame
    rst: DataFrame
    rst_edges: DataFrame
    entities: DataFrame
    mentioned_in: DataFrame

    def covered(self, functions: tuple[str, ...] | None = None) -> DataFrame:
        """(paper_id, fru_id, function, summary, pos, edu_id, section, section_rank, ord, text) of covered units."""
        frus = self.frus if functions is None else self.frus.where(F.col("function").isin(*functions))
        edus = self.edus.select("paper_id", "edu_id", "section", "section_rank", "ord", "text")
        return frus.join(self.covers, ["paper_id", "fru_id"]).join(edus, ["paper_id", "edu_id"])


def ordered(item: str | Column, *order: str) -> Column:
    """An array of item by the order columns."""
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(item).alias("_item") if isinstance(item, str) else item.alias("_item"))))
    return F.transform(rows, lambda r: r["_item"])


def joined(item: str, *order: str) -> Column:
    return F.concat_ws("|", ordered(item, *order))


def distinct_sorted(item: Column | str) -> Column:
    return F.concat_ws("|", F.sort_array(F.collect_set(item)))


def r01_claim_evidence(g: Graph) -> DataFrame:
    """Claims that share no unit with an Evidence function and whose units no Evidence relation touches."""
    claims = g.covered(("Claim",))
    evidence = g.frus.where("function = 'Evidence'").join(g.covers, ["paper_id", "fru_id"]).select("paper_id", "edu_id")
    related = g.rst.where("rst_type = 'Evidence'").join(g.rst_edges, ["paper_id", "rst_id"]).select("paper_id", "edu_id")
    backed = claims.join(evidence.unionByName(related), ["paper_id", "edu_id"], "left_semi").select("paper_id", "fru_id").distinct()
    return claims.join(backed, ["paper_id", "fru_id"], "left_anti").groupBy("paper_id", "fru_id").agg(F.first("summary").alias("summary"), joined("edu_id", "pos").alias("edu_ids"), joined("text", "pos").alias("edu_texts"), F.min(F.struct("section_rank", "ord", "section"))["section"].alias("section"))


def r02_baseline_critique(g: Graph) -> DataFrame:
    """Baselines and methods with the units that mention them in the method, experiment and results."""
    wanted = g.entities.where("lower(name) like '%baseline%' or type = 'Method'")
    units = g.edus.where(F.col("section").isin("Method", "Experiment", "Results")).select("paper_id", "edu_id", "section")
    rows = wanted.join(g.mentioned_in, ["paper_id", "entity_id"]).join(units, ["paper_id", "edu_id"])
    return rows.groupBy("paper_id", "entity_id", "name").agg(distinct_sorted("edu_id").alias("edu_ids"), distinct_sorted("section").alias("sections"))


def proximity_gap(g: Graph, anchor: str, support: str, back: int, forward: int, sections: tuple[str, ...] | None = None) -> DataFrame:
    """Spans of an anchor function in a section without a supporting one from back before to forward behind."""
    spans = g.covered((anchor,)) if sections is None else g.covered((anchor,)).where(F.col("section").isin(*sections))
    spans = spans.groupBy("paper_id", "fru_id", "section").agg(F.min("ord").alias("span_start"), F.max("ord").alias("span_end"), F.first("summary").alias("summary"))
    near = g.covered((support,)).select(F.col("paper_id").alias("p"), F.col("section").alias("s"), F.col("ord").alias("at"))
    inside = (F.col("paper_id") == F.col("p")) & (F.col("section") == F.col("s")) & F.col("at").between(F.col("span_start") - back, F.col("span_end") + forward)
    return spans.join(near, inside, "left_anti")


def r03_action_justification(g: Graph) -> DataFrame:
    return proximity_gap(g, "MethodStep", "Motivation", 8, 3)


def r09_observation_attribution(g: Graph) -> DataFrame:
    return proximity_gap(g, "Observation", "Attribution", 3, 8, ("Results", "Discussion", "Experiment"))


def r10_concession_compensation(g: Graph) -> DataFrame:
    return proximity_gap(g, "Concession", "Compensation", 3, 8)


def _per_paper(g: Graph, rows: DataFrame, **aggregates: Column) -> DataFrame:
    """One row for each paper, also where rows has none."""
    return g.papers.select("paper_id").join(rows.groupBy("paper_id").agg(*(v.alias(k) for k, v in aggregates.items())), "paper_id", "left")


def r04_macro_decomposition(g: Graph) -> DataFrame:
    rows = g.covered().where("section = 'Introduction'")
    return _per_paper(g, rows, functions=distinct_sorted("function")).na.fill({"functions": ""})


def _section_list(g: Graph, section: str) -> DataFrame:
    rows = g.edus.where(F.col("section") == section)
    return _per_paper(g, rows, edu_ids=joined("edu_id", "ord"), n=F.count(F.lit(1))).na.fill({"edu_ids": "", "n": 0})


def r05_process_sequence(g: Graph) -> DataFrame:
    return _section_list(g, "Method")


def r06_concept_formalization(g: Graph) -> DataFrame:
    wanted = g.entities.where(F.col("type").isin("Concept", "Metric"))
    return wanted.join(g.mentioned_in, ["paper_id", "entity_id"], "left").groupBy("paper_id", "entity_id", "name", "type").agg(distinct_sorted("edu_id").alias("edu_ids"))


def r07_setup_scoping(g: Graph) -> DataFrame:
    return _section_list(g, "Experiment")


def r08_problem_solution(g: Graph, null_map: bool = True) -> DataFrame:
    """Functions of the introduction and of the method; an empty side is one map of nulls, unless null_map is off."""
    rows = g.covered(None).where(F.col("section").isin("Introduction", "Method")).select("paper_id", "section", "fru_id", "function").distinct()
    item = F.concat_ws("=", "fru_id", "function")
    out = _per_paper(g, rows, introduction=distinct_sorted(F.when(F.col("section") == "Introduction", item)), method=distinct_sorted(F.when(F.col("section") == "Method", item)))
    empty = "null=null" if null_map else ""
    return out.select("paper_id", *(F.when(F.coalesce(c, F.lit("")) == "", empty).otherwise(F.col(c)).alias(c) for c in ("introduction", "method")))


def r11_specific_generalization(g: Graph) -> DataFrame:
    rows = g.frus.where(F.col("function").isin("Specific", "Generalization"))
    return rows.groupBy("paper_id").agg(*(distinct_sorted(F.when(F.col("function") == f, F.col("fru_id"))).alias(f.lower()) for f in ("Specific", "Generalization")))


def r12_core_restatement(g: Graph) -> DataFrame:
    rows = g.edus.where(F.col("section").isin("Abstract", "Conclusion"))
    text = lambda s: distinct_sorted(F.when(F.col("section") == s, F.col("text")))
    return _per_paper(g, rows, abstract=text("Abstract"), conclusion=text("Conclusion")).na.fill({"abstract": "", "conclusion": ""})


def r13_meta_discourse(g: Graph) -> DataFrame:
    """Papers with units: their meta-discourse functions with their units and first section, and all sections."""
    each = g.covered(("MetaDiscourse",)).groupBy("paper_id", "fru_id").agg(joined("edu_id", "pos").alias("edu_ids"), F.min(F.struct("section_rank", "ord", "section"))["section"].alias("section"))
    lists = each.groupBy("paper_id").agg(F.concat_ws("|", F.sort_array(F.collect_list(F.concat_ws(">", "fru_id", "section", "edu_ids")))).alias("meta"))
    return g.edus.groupBy("paper_id").agg(distinct_sorted("section").alias("sections")).join(lists, "paper_id", "left").na.fill({"meta": ""})


def r15_resolve_evidence(g: Graph, wanted: DataFrame) -> DataFrame:
    """(paper_id, item, edu_ids): of ordered mixed ids (paper_id, item, ids) the units, functions expanded, in order."""
    each = wanted.select("paper_id", "item", F.posexplode("ids").alias("at", "id"))
    units = each.join(g.edus.select("paper_id", F.col("edu_id").alias("id")), ["paper_id", "id"]).select("paper_id", "item", "at", F.lit(0).alias("pos"), F.col("id").alias("edu_id"))
    expanded = each.join(g.covers.withColumnRenamed("fru_id", "id"), ["paper_id", "id"]).select("paper_id", "item", "at", "pos", "edu_id")
    first = units.unionByName(expanded).groupBy("paper_id", "item", "edu_id").agg(F.min(F.struct("at", "pos")).alias("place"))
    found = first.groupBy("paper_id", "item").agg(joined("edu_id", "place").alias("edu_ids"))
    return wanted.select("paper_id", "item").join(found, ["paper_id", "item"], "left").na.fill({"edu_ids": ""})


def r16_papers_with_units(g: Graph) -> DataFrame:
    return g.papers.join(g.edus, "paper_id", "left_semi").select("paper_id")


def r17_graph_edges(g: Graph) -> DataFrame:
    """Edges of which both ends are nodes of the paper: (paper_id, kind, from_id, to_id)."""
    nodes = g.edus.select("paper_id", F.col("edu_id").alias("id"))
    covers = g.covers.join(g.frus.select("paper_id", "fru_id"), ["paper_id", "fru_id"], "left_semi").select("paper_id", F.lit("COVERS").alias("kind"), F.col("fru_id").alias("from_id"), F.col("edu_id").alias("to_id"))
    rst = g.rst_edges.join(g.rst.select("paper_id", "rst_id"), ["paper_id", "rst_id"], "left_semi").select("paper_id", F.col("role").alias("kind"), F.col("rst_id").alias("from_id"), F.col("edu_id").alias("to_id"))
    mentions = g.mentioned_in.join(g.entities.select("paper_id", "entity_id"), ["paper_id", "entity_id"], "left_semi").select("paper_id", F.lit("MENTIONED_IN").alias("kind"), F.col("entity_id").alias("from_id"), F.col("edu_id").alias("to_id"))
    edges = covers.unionByName(rst).unionByName(mentions)
    return edges.join(nodes.withColumnRenamed("id", "to_id"), ["paper_id", "to_id"], "left_semi").select("paper_id", "kind", "from_id", "to_id")


def r17_graph_nodes(g: Graph) -> DataFrame:
    """(paper_id, label, id, text): all nodes, a unit's text, a function's and an entity's name, a relation's type."""
    node = lambda frame, label, i, text: frame.select("paper_id", F.lit(label).alias("label"), F.col(i).alias("id"), F.col(text).alias("text"))
    parts = ((g.edus, "EDU", "edu_id", "text"), (g.frus, "FRU", "fru_id", "function"), (g.rst, "RST", "rst_id", "rst_type"), (g.entities, "Entity", "entity_id", "name"))
    first, *rest = (node(*p) for p in parts)
    for more in rest:
        first = first.unionByName(more)
    return first


def r18_unit(g: Graph, paper_id: str, edu_id: str) -> DataFrame:
    return g.edus.where((F.col("paper_id") == paper_id) & (F.col("edu_id") == edu_id))


def r19_cleared(frame: DataFrame, gone: DataFrame) -> DataFrame:
    """A frame without the papers of gone."""
    return frame.join(gone.select("paper_id"), "paper_id", "left_anti")


def r20_repeated_ids(frame: DataFrame, *key: str) -> DataFrame:
    """Keys that are not unique, with how often they stand: empty where the constraint holds."""
    return frame.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def section_rank(section: Column) -> Column:
    """0 for the first section; what is no section comes last."""
    place = F.array_position(F.array(*map(F.lit, SECTIONS)), section)
    return F.when(place > 0, place - 1).otherwise(len(SECTIONS))


def v08_section_dump(edus: DataFrame, limit: int = 400_000) -> DataFrame:
    """(paper_id, dump): units by section and order as lines, cut; units of other sections are left out."""
    rows = edus.withColumn("rank", section_rank(F.col("section"))).where(F.col("rank") < len(SECTIONS))
    line = F.concat(F.lit("["), "edu_id", F.lit("] "), "text")
    return rows.withColumn("line", line).groupBy("paper_id").agg(F.substring(F.concat_ws("\n", ordered("line", "rank", "ord")), 1, limit).alias("dump"))


def v19_full_text(edus: DataFrame) -> DataFrame:
    return edus.groupBy("paper_id").agg(F.concat_ws("\n", ordered("text", "section_rank", "ord")).alias("full_text"))


def v18_structure(g: Graph) -> DataFrame:
    """(paper_id, structure): functions, each with its summary or else the first 120 letters that it covers."""
    text = g.covered().groupBy("paper_id", "fru_id", "function", "summary").agg(F.substring(F.concat_ws(" ", ordered("text", "pos")), 1, 120).alias("covered"))
    line = F.concat_ws(" ", "fru_id", "function", F.coalesce(F.nullif("summary", F.lit("")), "covered"))
    return text.withColumn("line", line).groupBy("paper_id").agg(F.concat_ws("\n", F.sort_array(F.collect_list("line"))).alias("structure"))
