"""Ranking, first-appearance and grouping operators.

"First" and "best" are min, max or min_by over structs wherever one row of a group is wanted: these aggregate before
the shuffle. Windows are left where several rows of a group stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..schema import SEVERITIES
from .aggregates import severity_rank


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, in doubles; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


#: Chunks of a topic's block and claims of its group, at most about; scores that are held at once.
BLOCK, ASKED, TILE = 16_384, 16_384, 1 << 18
#: The score of vectors of two sizes, which is null.
NO_SCORE = -np.finfo(np.float64).max


def _sizes(table: pa.Table, vector: str) -> np.ndarray:
    return pc.list_value_length(table[vector]).fill_null(-1).to_numpy()


def _components(table: pa.Table, vector: str, rows: np.ndarray) -> np.ndarray:
    """(component, row) of rows of one size, in doubles."""
    values = table[vector].combine_chunks().take(pa.array(rows)).flatten().cast(pa.float64())
    return np.ascontiguousarray(values.to_numpy(zero_copy_only=False).reshape(len(rows), -1).T)


@np.errstate(all="ignore")
def _tiles(asked: pa.Table, here: pa.Table, rows: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first claim, scores) of so many claims at a time against all chunks, as cosine() gives them.

    Products are summed in the order of the components, one component for a whole tile at a time, so that scores are to
    the bit those of a sum row by row. Vectors of two sizes have the lowest number as their score, for null.
    """
    (own, other), (own_size, size) = (t["_norm"].to_numpy() for t in (asked, here)), (_sizes(asked, "claim"), _sizes(here, "chunk"))
    (known, counted) = (t["_norm"].is_valid().to_numpy() for t in (asked, here))
    chunks = {n: (at := np.flatnonzero(counted & (size == n)), _components(here, "chunk", at)) for n in np.unique(size[counted])}
    for begin in range(0, len(asked), rows):
        part = np.arange(begin, min(begin + rows, len(asked)))
        score = np.full((len(part), len(here)), NO_SCORE)
        for n in np.unique(own_size[part][known[part]]):
            line = np.flatnonzero(known[part] & (own_size[part] == n))
            if n not in chunks:
                continue
            at, x = chunks[n]
            q = _components(asked, "claim", part[line])
            total = np.zeros((len(line), len(at)))
            product = np.empty_like(total)
            for a, b in zip(q, x, strict=True):
                total += np.multiply.outer(a, b, out=product)
            np.divide(total, np.multiply.outer(own[part[line]], other[at], out=product), out=total)
            score[np.ix_(line, at)] = total
        with_norms = known[part][:, None] & counted
        # above 0, or not a number, as Spark compares
        with_norms &= ~(np.multiply.outer(own[part], other) <= 0)
        score[~with_norms] = 0.0
        yield begin, score


def w01_top_chunks(claims: DataFrame, chunks: DataFrame, k: int = 3) -> DataFrame:
    """(topic, claim_id, rank, chunk_id, score): the k chunks of its topic that are most like each claim.

    Norms are taken once for each vector. Chunks of a topic are dealt into blocks of BLOCK at most, its claims into groups
    of ASKED; each group meets each block in a task, which holds TILE scores at once and gives the k best of the block;
    those are merged. No pair is a row. Work is claims times chunks of a topic: the claims are a set stated.
    """
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
    blocks, groups = max(1, -(-chunks.count() // BLOCK)), max(1, -(-claims.count() // ASKED))
    deal = lambda salt, c, parts: F.pmod(F.xxhash64(F.lit(salt), c), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    here = chunks.where("topic is not null and chunk_id is not null").select("topic", "chunk_id", "chunk", norm("chunk").alias("_norm"), deal("block", "chunk_id", blocks).alias("_block"), every(groups).alias("_group"))
    asked = claims.where("topic is not null and claim_id is not null").select("topic", "claim_id", "claim", norm("claim").alias("_norm"), every(blocks).alias("_block"), deal("group", "claim_id", groups).alias("_group"))
    schema = StructType([asked.schema["topic"], asked.schema["claim_id"], here.schema["chunk_id"], StructField("score", DoubleType())])

    def best(asked: pa.Table, here: pa.Table) -> pa.Table:
        out = []
        if len(asked) and len(here):
            here = here.take(pc.sort_indices(here["chunk_id"]))
            ids, own = (c.to_numpy() for c in (here["chunk_id"], asked["claim_id"]))
            for begin, score in _tiles(asked, here, max(1, TILE // len(here))):
                order = np.where(np.isnan(score), np.inf, score)
                order[own[begin : begin + len(score), None] == ids] = -np.inf
                n = len(ids) - min(k, len(ids))
                least = np.partition(order, n, axis=1)[:, n, None]
                row, at = np.nonzero((order >= least) & (order > -np.inf))
                # by claim and score; places are as ids, so that ties keep theirs
                by = np.lexsort((at, -order[row, at], row))
                row, at = row[by], at[by]
                first = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, at = row[first], at[first]
                out.append((begin + row, at, score[row, at]))
        row, at, score = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        columns = asked["topic"].take(pa.array(row)), asked["claim_id"].take(pa.array(row)), here["chunk_id"].take(pa.array(at))
        return pa.table([*columns, pa.array(score, pa.float64(), mask=score == NO_SCORE)], names=schema.names)

    keys = ("topic", "_block", "_group")
    in_block = asked.groupBy(*keys).cogroup(here.groupBy(*keys)).applyInArrow(best, schema)
    merged = in_block.withColumn("rank", F.row_number().over(Window.partitionBy("topic", "claim_id").orderBy(F.desc("score"), "chunk_id"))).where(F.col("rank") <= k)
    return merged.select("topic", "claim_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


def w02_rerank(items: DataFrame) -> DataFrame:
    """(query, pos, rank) of items (query, pos, abstract, score): by score, those without an abstract behind in their
    order; a query with fewer than two abstracts keeps its order."""
    own = Window.partitionBy("query")
    has = F.coalesce(F.trim("abstract") != "", F.lit(False))
    rows = items.withColumn("_has", has).withColumn("_n", F.count_if(F.col("_has")).over(own))
    moved = (F.col("_n") >= 2) & F.col("_has")
    order = [F.when(F.col("_n") >= 2, F.when(F.col("_has"), 0).otherwise(1)).otherwise(0), F.when(moved, -F.col("score")).otherwise(F.lit(0.0)), F.col("pos")]
    return rows.select("query", "pos", F.row_number().over(own.orderBy(*order)).alias("rank"))


def w03_best_match(pairs: DataFrame, least: float = 0.8) -> DataFrame:
    """Of each query's candidates (query, pos, score) the best, the first on ties, if it reaches the threshold."""
    best = pairs.groupBy("query").agg(F.max(F.struct("score", (-F.col("pos")).alias("back"))).alias("b"))
    return best.where(F.col("b.score") >= least).select("query", (-F.col("b.back")).alias("pos"), F.round("b.score", 3).alias("score"))


def title_key(title: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(title, r"\s+", " ")))


def w04_dedupe(records: DataFrame) -> DataFrame:
    """Records (pos, title, surname, cited) without repeats of (title, surname): the most cited stays, the first on
    ties, at the place of the first; blank and untitled ones go."""
    rows = records.withColumn("key", title_key(F.col("title"))).where("key <> '' and key <> '(untitled)'")
    best = F.max(F.struct("cited", (-F.col("pos")).alias("back"))).alias("b")
    found = rows.groupBy("key", "surname").agg(best, F.min("pos").alias("place"))
    return found.select("place", "key", "surname", (-F.col("b.back")).alias("kept_pos"), F.col("b.cited").alias("cited"))


def w05_interleave(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two ordered lists (key, pos, item) zipped, the longer one's rest behind."""
    turn = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    both = left.select(key, turn.alias("turn"), F.lit(0).alias("side"), "item").unionByName(right.select(key, turn.alias("turn"), F.lit(1).alias("side"), "item"))
    return both.select(key, F.row_number().over(Window.partitionBy(key).orderBy("turn", "side")).alias("place"), "item")


def w06_recommend(records: DataFrame, language: str, k: int) -> DataFrame:
    """The first k of each query after gating by language (all, en, zh) and w04_dedupe()."""
    cjk = F.col("title").rlike(r"[\u4e00-\u9fff]")
    gated = records if language == "all" else records.where(cjk if language == "zh" else ~cjk)
    rows = gated.withColumn("key", title_key(F.col("title"))).where("key <> '' and key <> '(untitled)'")
    best = F.max(F.struct("cited", (-F.col("pos")).alias("back"))).alias("b")
    found = rows.groupBy("query", "key", "surname").agg(best, F.min("pos").alias("first"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("first"))
    return found.select("query", place.alias("place"), (-F.col("b.back")).alias("pos")).where(F.col("place") <= k)


def w07_entity_dedupe(triples: DataFrame) -> DataFrame:
    """Triples with each paper's entities told apart by their folded names: the first spelling stands for all."""
    ends = triples.select("paper_id", F.posexplode(F.array("src", "tgt")).alias("side", "name"), "rel_id")
    key = title_key(F.col("name"))
    first = ends.withColumn("key", key).groupBy("paper_id", "key").agg(F.min(F.struct("rel_id", "side", "name"))["name"].alias("name"))
    side = lambda c: first.select("paper_id", F.col("key").alias(f"{c}_key"), F.col("name").alias(f"{c}_name"))
    rows = triples.withColumns({"src_key": title_key(F.col("src")), "tgt_key": title_key(F.col("tgt"))})
    return rows.join(side("src"), ["paper_id", "src_key"]).join(side("tgt"), ["paper_id", "tgt_key"]).select("paper_id", "rel_id", F.col("src_name").alias("src"), "predicate", F.col("tgt_name").alias("tgt"))


def w08_by_name(entities: DataFrame, edus: DataFrame, least: int = 3) -> DataFrame:
    """(paper_id, entity_id, section): of entities whose evidence is unknown, the section of the first unit in their paper
    that has their name in it, of three characters at least; none without one. A paper's units meet its entities alone."""
    named = entities.where(F.char_length(F.trim("name")) >= least).select("paper_id", "entity_id", F.lower(F.trim("name")).alias("_name"))
    found = named.join(edus.select("paper_id", "section_rank", "ord", "section", F.lower("text").alias("_text")), "paper_id").where(F.col("_text").contains(F.col("_name")))
    return found.groupBy("paper_id", "entity_id").agg(F.min(F.struct("section_rank", "ord", "section"))["section"].alias("section"))


def w08_entity_sections(entities: DataFrame, mentioned: DataFrame, edus: DataFrame) -> DataFrame:
    """(paper_id, entity_id, section): the first section of an entity's evidence, or of a unit that names it, or unsectioned."""
    at = mentioned.join(edus.select("paper_id", "edu_id", "section_rank", "ord", "section"), ["paper_id", "edu_id"])
    first = at.groupBy("paper_id", "entity_id").agg(F.min(F.struct("section_rank", "ord", "section"))["section"].alias("section"))
    rest = entities.join(first, ["paper_id", "entity_id"], "left_anti")
    found = first.unionByName(w08_by_name(rest, edus))
    return entities.join(found, ["paper_id", "entity_id"], "left").select("paper_id", "entity_id", F.coalesce("section", F.lit("__unsectioned__")).alias("section"))


def _relations(triples: DataFrame) -> DataFrame:
    out = triples.select("paper_id", F.col("src").alias("entity"), F.lit("out").alias("direction"), "predicate", F.col("tgt").alias("other"), "rel_id")
    back = triples.select("paper_id", F.col("tgt").alias("entity"), F.lit("in").alias("direction"), "predicate", F.col("src").alias("other"), "rel_id")
    return out.unionByName(back)


def w09_relations(triples: DataFrame) -> DataFrame:
    """Each entity's relations, those of one direction, predicate and other end once, under their first id."""
    return _relations(triples).groupBy("paper_id", "entity", "direction", "predicate", "other").agg(F.min("rel_id").alias("rel_id"))


def w10_counts(rows: DataFrame, column: str, legend: tuple[str, ...]) -> DataFrame:
    """(value, place, n): known values at their place in the legend, from 1, the others all behind it."""
    known = F.array_position(F.array(*map(F.lit, legend)), F.col("value"))
    n = rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("value", F.when(known > 0, known).otherwise(len(legend) + 1).alias("place"), "n")


def w11_ego(triples: DataFrame) -> DataFrame:
    """(paper_id, entity, degree, neighbours): what one step leads to, in either direction."""
    rows = _relations(triples).groupBy("paper_id", "entity")
    return rows.agg(F.count_distinct("other").alias("degree"), F.concat_ws("|", F.sort_array(F.collect_set("other"))).alias("neighbours"))


def w12_function_places(covered: DataFrame) -> DataFrame:
    """(paper_id, fru_id, section, ord): where each function begins."""
    first = covered.groupBy("paper_id", "fru_id").agg(F.min(F.struct("section_rank", "ord", "section")).alias("f"))
    return first.select("paper_id", "fru_id", "f.section", "f.ord")


def w13_defects_by_function(covers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(paper_id, fru_id, defect_id): functions and defects that share a unit."""
    return covers.select("paper_id", "edu_id", "fru_id").join(evidence.select("paper_id", "edu_id", "defect_id"), ["paper_id", "edu_id"]).select("paper_id", "fru_id", "defect_id").distinct()


def w14_function_order(functions: DataFrame, defects_of: DataFrame) -> DataFrame:
    """(paper_id, place, fru_id, defects): by descending number of defects, then by id."""
    n = defects_of.groupBy("paper_id", "fru_id").agg(F.count(F.lit(1)).alias("defects"))
    rows = functions.select("paper_id", "fru_id").join(n, ["paper_id", "fru_id"], "left").na.fill(0, ["defects"])
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("defects"), "fru_id")))


def w15_top_severity(defects: DataFrame) -> DataFrame:
    """Each paper's gravest severity; low where none is known."""
    rank = F.min(severity_rank(F.col("severity")))
    return defects.groupBy("paper_id").agg(F.coalesce(F.get(F.array(*map(F.lit, SEVERITIES)), rank.cast("int")), F.lit("low")).alias("severity"))


def w16_numbering(items: DataFrame, group: str, key: str, order: str) -> DataFrame:
    """(group, key, number): keys numbered from 1 by their first appearance in a group."""
    first = items.groupBy(group, key).agg(F.min(order).alias("first"))
    return first.select(group, key, F.row_number().over(Window.partitionBy(group).orderBy("first")).alias("number"))


def w17_history_tail(messages: DataFrame, n: int = 20) -> DataFrame:
    """The last n messages of each paper, numbered in their order."""
    own = Window.partitionBy("paper_id")
    rows = messages.withColumn("back", F.row_number().over(own.orderBy(F.desc("id")))).where(F.col("back") <= n)
    return rows.select("paper_id", "id", "role", F.row_number().over(own.orderBy("id")).alias("place"))


def w18_evidence_csv(evidence: DataFrame, edus: DataFrame, page_units: int = 4) -> DataFrame:
    """(paper_id, defect_id, pages, texts): pages from 1, distinct and ascending; texts in order."""
    rows = evidence.join(edus.select("paper_id", "edu_id", "k", "text"), ["paper_id", "edu_id"])
    page = F.floor(F.col("k") / page_units) + 1
    lists = rows.groupBy("paper_id", "defect_id").agg(F.sort_array(F.collect_set(page)).alias("pages"), F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("t"))
    return lists.select("paper_id", "defect_id", F.array_join(F.col("pages").cast("array<string>"), " / ").alias("pages"), F.array_join(F.transform("t", lambda t: t["text"]), " || ").alias("texts"))


def w19_sections(edus: DataFrame) -> DataFrame:
    """(paper_id, place, section, edu_ids): sections by first appearance, units by order."""
    rows = edus.groupBy("paper_id", "section").agg(F.min("k").alias("first"), F.sort_array(F.collect_list(F.struct("ord", "edu_id"))).alias("u"))
    return rows.select("paper_id", F.row_number().over(Window.partitionBy("paper_id").orderBy("first")).alias("place"), "section", F.array_join(F.transform("u", lambda u: u["edu_id"]), "|").alias("edu_ids"))


def w20_highlights(defects: DataFrame, evidence: DataFrame, edus: DataFrame, page_units: int = 4) -> DataFrame:
    """(paper_id, page, marks): what to mark on each page, defects' units with their severity; unknown units are left out."""
    units = edus.select("paper_id", "edu_id", F.floor(F.col("k") / page_units).alias("page"))
    rows = evidence.join(defects.select("paper_id", "defect_id", "severity"), ["paper_id", "defect_id"]).join(units, ["paper_id", "edu_id"])
    mark = F.concat_ws(">", "defect_id", "edu_id", F.coalesce("severity", F.lit("")))
    return rows.groupBy("paper_id", "page").agg(F.concat_ws("|", F.sort_array(F.collect_list(mark))).alias("marks"))
