"""Verdicts of rules: filters, defaults, caps and merges (V02-V17), row by row where they can be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CROSS_SECTION_RULES, SEVERITIES

#: Rules that need more than one section.
NOT_IN_DRAFTS = CROSS_SECTION_RULES


def clamped(confidence: Column) -> Column:
    """Between 0 and 1; null where it is no number."""
    x = confidence.try_cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(None).cast("double")).when(x < 0, 0.0).when(x > 1, 1.0).otherwise(x)


def accepted(verdicts: DataFrame) -> DataFrame:
    """Verdicts that hold and say why, with defaults for their severity and section."""
    rows = verdicts.where(F.coalesce("violates", F.lit(False)) & (F.coalesce(F.trim("description"), F.lit("")) != ""))
    return rows.withColumns({"severity": F.when(F.col("severity").isin(*SEVERITIES), F.col("severity")).otherwise("medium"), "section": F.coalesce(F.nullif("section", F.lit("")), F.lit("Other")), "confidence": clamped(F.col("confidence"))})


def all_rules(checks: dict[str, DataFrame], cross_section: bool = True) -> DataFrame:
    """The verdicts of all rules in their order, rule_ord from 0; those that judge whole papers are left to the pass
    across sections where that is on."""
    skipped = ("REL-04", "REL-12") if cross_section else ()
    out = None
    for place, (rule, rows) in enumerate((r, d) for r, d in sorted(checks.items()) if r not in skipped):
        own = rows.withColumns({"rule_id": F.lit(rule), "rule_ord": F.lit(place)})
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def localized(defects: DataFrame, translations: DataFrame, locale: str, fields: tuple[str, ...] = ("description", "suggestion")) -> DataFrame:
    """Defects (paper_id, pos, fields as maps by locale) with the translated texts; indexes that no defect has and empty
    texts change nothing."""
    rows = defects.join(translations.select("paper_id", F.col("index").alias("pos"), *(F.col(f).alias(f"_{f}") for f in fields)), ["paper_id", "pos"], "left")
    for f in fields:
        # the new text stands before the old one, of which a map would hold two
        new = F.map_concat(F.map_filter(F.col(f), lambda k, v: k != locale), F.create_map(F.lit(locale), F.col(f"_{f}")))
        rows = rows.withColumn(f, F.when(F.coalesce(F.col(f"_{f}"), F.lit("")) != "", new).otherwise(F.col(f)))
    return rows.drop(*(f"_{f}" for f in fields))


def normalized_locale(locale: Column, supported: tuple[str, ...], primary: str) -> Column:
    """V12."""
    return F.when(locale.isin(*supported), locale).otherwise(primary)


def formatted_defects(defects: DataFrame, evidence: DataFrame, edus: DataFrame) -> DataFrame:
    """Defects with the texts of their known evidence in order, as an array."""
    known = evidence.join(edus.select("paper_id", "edu_id", "text"), ["paper_id", "edu_id"])
    lists = known.groupBy("paper_id", "defect_id").agg(F.sort_array(F.collect_list(F.struct("pos", "edu_id", "text"))).alias("e"))
    return defects.join(lists, ["paper_id", "defect_id"], "left").withColumn("evidence", F.coalesce(F.transform("e", lambda e: e["text"]), F.array().cast("array<string>"))).drop("e")


def check_meta(candidates: DataFrame, defects: DataFrame) -> DataFrame:
    """By paper and rule the candidates and the defects among them."""
    n = lambda df, name: df.groupBy("paper_id", "rule_id").agg(F.count(F.lit(1)).alias(name))
    return n(candidates, "candidate_count").join(n(defects, "defect_count"), ["paper_id", "rule_id"], "left").na.fill(0, ["defect_count"])


def capped_payload(items: DataFrame, limit: int) -> DataFrame:
    """(paper_id, kept, dropped): how many leading items fit as a list in limit characters, brackets and ", " counted."""
    own = Window.partitionBy("paper_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = items.withColumn("total", F.sum(F.char_length("json") + 2).over(own))
    return rows.groupBy("paper_id").agg(F.count_if(F.col("total") <= limit).alias("kept"), F.count_if(F.col("total") > limit).alias("dropped"))


def cross_section(defects: DataFrame, evidence: DataFrame, edus: DataFrame) -> DataFrame:
    """Defects of the cross-section rules that at least two known units bear out, repeats of a unit counted."""
    known = evidence.join(edus.select("paper_id", "edu_id"), ["paper_id", "edu_id"], "left_semi").groupBy("paper_id", "defect_id").agg(F.count(F.lit(1)).alias("units")).where("units >= 2")
    return defects.where(F.col("rule_id").isin(*CROSS_SECTION_RULES)).join(known, ["paper_id", "defect_id"]).select("paper_id", "defect_id", "rule_id", "units")


def picked(texts: Column, locale: Column, primary: str) -> Column:
    """The text of a locale, else of the primary one, else the first that is not empty, else empty."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(some(F.try_element_at(texts, locale)), some(F.try_element_at(texts, F.lit(primary))), F.get(F.filter(F.map_values(texts), lambda v: v != ""), 0), F.lit(""))


def memo_key(text: Column, locale: Column, version: str) -> Column:
    """What a stored check is found by."""
    part = lambda c: F.coalesce(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\\0"))  # no two triples give one text
    return F.sha2(F.concat(part(text), F.lit("|"), part(locale), F.lit("|"), part(F.lit(version))).cast("binary"), 256)


def memo(sections: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """Sections that are not blank with whether the cache has their check."""
    rows = sections.where(F.trim("text") != "").withColumn("cache_key", memo_key(F.col("text"), F.col("locale"), version))
    return rows.join(cache.select("cache_key", F.lit(True).alias("found")).distinct(), "cache_key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def merged_draft(sections: DataFrame, limit: int = 40_000) -> DataFrame:
    """A paper's sections that are not blank, joined by blank lines and cut."""
    rows = sections.where(F.trim("text") != "").groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.trim("text").alias("text")))).alias("s"))
    return rows.select("paper_id", F.substring(F.array_join(F.transform("s", lambda s: s["text"]), "\n\n"), 1, limit).alias("draft"))


def normalized_findings(defects: DataFrame, texts: DataFrame) -> DataFrame:
    """(paper_id, location, issue_type): the evidence as one string; the type is the rule where none is given."""
    rows = defects.join(texts, ["paper_id", "defect_id"], "left")
    return rows.select("paper_id", F.coalesce(F.array_join("texts", " / "), F.lit("")).alias("location"), F.coalesce(F.nullif("defect_type", F.lit("")), "rule_id").alias("issue_type"))
