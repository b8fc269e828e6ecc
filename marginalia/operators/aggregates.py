"""Aggregates A01-A37 over judgments, defects, calls, papers and uploads; frames as in the data model.

Groups are rules, stages, models or severities, of which there are few: partial aggregates before each shuffle leave a
row for each group and task. Joins are on (paper_id, defect_id) or paper_id and left to the optimizer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CROSS_SECTION_RULES, PRICES, SEVERITIES, VERDICTS

DEFECT = ["paper_id", "defect_id"]


def precision(correct: Column | str, partial: Column | str, total: Column | str) -> Column:
    """Soft precision: a partial verdict counts half; null without any verdict."""
    correct, partial, total = (F.col(c) if isinstance(c, str) else c for c in (correct, partial, total))
    return F.when(total > 0, (correct + partial * 0.5) / total)


def _verdicts() -> list[Column]:
    return [F.count(F.lit(1)).alias("total"), *(F.sum(F.when(F.col("verdict") == v, 1).otherwise(0)).alias(v) for v in VERDICTS)]


def _with_precision(counts: DataFrame) -> DataFrame:
    return counts.withColumn("precision", precision("correct", "partial", "total"))


def a01_judgments_by_rule(judgments: DataFrame) -> DataFrame:
    return _with_precision(judgments.groupBy("rule_id").agg(*_verdicts()))


def a02_judgments_overall(judgments: DataFrame) -> DataFrame:
    """One row; without judgments the total is 0 and the rest null."""
    return _with_precision(judgments.agg(*_verdicts()))


def a03_evaluation(judgments: DataFrame) -> DataFrame:
    """(scope, rule_id, counts, precision to four places), scope being overall or rule: one pass by grouping sets."""
    counts = judgments.rollup("rule_id").agg(F.grouping("rule_id").alias("all"), *_verdicts())
    rows = _with_precision(counts).withColumn("precision", F.round("precision", 4))
    return rows.select(F.when(F.col("all") == 1, "overall").otherwise("rule").alias("scope"), "rule_id", "total", *VERDICTS, "precision")


def first_defects(defects: DataFrame) -> DataFrame:
    """Of defects that share their id in a paper the first."""
    rest = [c for c in defects.columns if c not in DEFECT]
    return defects.groupBy(*DEFECT).agg(F.min(F.struct("pos", *(c for c in rest if c != "pos"))).alias("_first")).select(*DEFECT, *(F.col("_first")[c].alias(c) for c in rest))


def judged(judgments: DataFrame, defects: DataFrame, how: str = "inner") -> DataFrame:
    return judgments.join(first_defects(defects).drop("rule_id"), DEFECT, how)


def finished(judgments: DataFrame, results: DataFrame) -> DataFrame:
    """Judgments of papers whose analysis has ended."""
    return judgments.join(results.select("paper_id"), "paper_id", "left_semi")


def a04_evaluation_by_severity(judgments: DataFrame, defects: DataFrame, results: DataFrame) -> DataFrame:
    """Counts by severity over finished papers; none is unknown, and severities outside the domain are left out."""
    rows = judged(finished(judgments, results), defects).withColumn("severity", F.coalesce(F.nullif("severity", F.lit("")), F.lit("unknown")))
    return _with_precision(rows.where(F.col("severity").isin(*SEVERITIES, "unknown")).groupBy("severity").agg(*_verdicts()))


def confidence_bucket(confidence: Column) -> Column:
    return F.when(confidence.isNull(), "n/a").when(confidence >= 0.8, ">=0.8").when(confidence >= 0.5, "0.5-0.8").otherwise("<0.5")


def a05_evaluation_by_confidence(judgments: DataFrame, defects: DataFrame, results: DataFrame) -> DataFrame:
    return _with_precision(judged(finished(judgments, results), defects).groupBy(confidence_bucket(F.col("confidence")).alias("bucket")).agg(*_verdicts()))


def a06_orphans(judgments: DataFrame, defects: DataFrame, results: DataFrame) -> DataFrame:
    """How many judgments are of a defect, or of a finished paper, that is gone."""
    there = finished(defects, results).select(*DEFECT)
    return judgments.join(there, DEFECT, "left_anti").agg(F.count(F.lit(1)).alias("orphans"))


def evidence_texts(evidence: DataFrame, edus: DataFrame) -> DataFrame:
    """(paper_id, defect_id, edu_ids, texts): evidence in order; an unknown unit has an empty text."""
    rows = evidence.join(edus.select("paper_id", "edu_id", "text"), ["paper_id", "edu_id"], "left").groupBy(*DEFECT)
    lists = rows.agg(F.sort_array(F.collect_list(F.struct("pos", "edu_id", F.coalesce("text", F.lit("")).alias("text")))).alias("e"))
    return lists.select(*DEFECT, F.transform("e", lambda e: e["edu_id"]).alias("edu_ids"), F.transform("e", lambda e: e["text"]).alias("texts"))


def a07_export(judgments: DataFrame, results: DataFrame, papers: DataFrame, defects: DataFrame, evidence: DataFrame, edus: DataFrame) -> DataFrame:
    """Judgments of finished papers whose defect is there, with its details and evidence."""
    rows = judged(judgments.join(results.select("paper_id"), "paper_id", "left_semi"), defects)
    rows = rows.join(evidence_texts(evidence, edus), DEFECT, "left").join(papers.select("paper_id", "title"), "paper_id", "left")
    return rows.select("paper_id", "title", "rule_id", "defect_id", "verdict", "severity", "defect_type", F.coalesce(F.concat_ws("|", "texts"), F.lit("")).alias("evidence"))


def a08_rule_firing(defects: DataFrame, results: DataFrame) -> DataFrame:
    """By rule the papers in which it fires, its defects, and the papers analysed."""
    analysed = results.agg(F.count(F.lit(1)).alias("papers_analyzed"))
    fired = defects.where("rule_id is not null").join(results.select("paper_id"), "paper_id", "left_semi").groupBy("rule_id").agg(F.count_distinct("paper_id").alias("papers_fired"), F.count(F.lit(1)).alias("total_defects"))
    return fired.crossJoin(F.broadcast(analysed))  # one row


def rule_catalog(spark: SparkSession, n: int = 13) -> DataFrame:
    return spark.range(1, n + 1).select(F.concat(F.lit("REL-"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("rule_id"))


def a09_rule_stats(catalog: DataFrame, judgments: DataFrame, defects: DataFrame, results: DataFrame) -> DataFrame:
    """All rules of the catalog, those that never fired too; the papers analysed are the same for each."""
    analysed = results.agg(F.count(F.lit(1)).alias("papers_analyzed"))
    fired = a08_rule_firing(defects, results).drop("papers_analyzed")
    rows = catalog.crossJoin(F.broadcast(analysed)).join(fired, "rule_id", "left").join(a01_judgments_by_rule(judgments), "rule_id", "left")  # one row
    return rows.na.fill(0, ["papers_fired", "total_defects", "total", *VERDICTS])


_TOKENS = ("input_tokens", "output_tokens", "cached_tokens", "cost_micro")


def _costs() -> list[Column]:
    return [F.count(F.lit(1)).alias("calls"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _TOKENS)]


def a10_cost_total(calls: DataFrame, paper_id: str | None = None) -> DataFrame:
    """One row over all calls, those without a paper included, or over those of a paper."""
    return (calls if paper_id is None else calls.where(F.col("paper_id") == paper_id)).agg(*_costs())


def a11_cost_by_stage(calls: DataFrame) -> DataFrame:
    return calls.groupBy("stage", "model").agg(*_costs())


def a12_upload_stats(events: DataFrame, since: str) -> DataFrame:
    """(status, n, total) of the uploads from a time on."""
    n = events.where(F.col("created_at") >= F.lit(since).cast("timestamp")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total"))))  # one row


def a12_upload_errors(events: DataFrame, since: str) -> DataFrame:
    """(place, id, paper_id, created_at): the uploads that failed from a time on, the newest first."""
    rows = events.where((F.col("created_at") >= F.lit(since).cast("timestamp")) & (F.col("status") == "error"))
    return rows.select("id", "paper_id", "created_at", F.col("error_message") if "error_message" in events.columns else F.lit(None).cast("string").alias("error_message")).orderBy(F.desc("created_at"), F.desc("id"))


def a13_papers(papers: DataFrame, results: DataFrame) -> DataFrame:
    """Papers with whether they are finished and the time that they are listed by."""
    rows = papers.join(results.select("paper_id", "finished_at"), "paper_id", "left")
    return rows.select("paper_id", "title", F.col("finished_at").isNotNull().alias("has_result"), F.coalesce("finished_at", "created_at").alias("listed_at"))


def a14_finished_papers(papers: DataFrame, results: DataFrame) -> DataFrame:
    """Finished papers under their title, or else their file's name."""
    rows = papers.join(results.select("paper_id", "finished_at"), "paper_id")
    return rows.select("paper_id", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.nullif("filename", F.lit("")), "paper_id").alias("display_title"), "finished_at")


def a15_latest_by_hash(papers: DataFrame, results: DataFrame) -> DataFrame:
    """For each content the paper that was finished last."""
    rows = papers.join(results, "paper_id")
    return rows.groupBy("content_hash").agg(F.max(F.struct("finished_at", "paper_id")).alias("m")).select("content_hash", "m.paper_id", "m.finished_at")


def a16_counts(results: DataFrame, defects: DataFrame, edus: DataFrame) -> DataFrame:
    """Finished papers with their defects and units; each side is counted before it is joined."""
    n = lambda df, name: df.groupBy("paper_id").agg(F.count(F.lit(1)).alias(name))
    return results.select("paper_id").join(n(defects, "defect_count"), "paper_id", "left").join(n(edus, "edu_count"), "paper_id", "left").na.fill(0)


def a17_cost_by_paper(calls: DataFrame) -> DataFrame:
    return calls.groupBy("paper_id").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("cost_micro") / 1e6, 4).alias("cost"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def a18_top_stages(calls: DataFrame, n: int = 10) -> DataFrame:
    """The n stages that cost most, ties by name."""
    return calls.groupBy("stage").agg(F.sum("cost_micro").alias("cost_micro"), F.count(F.lit(1)).alias("calls")).orderBy(F.desc("cost_micro"), "stage").limit(n)


def a19_worst_rules(judgments: DataFrame) -> DataFrame:
    """Rules by ascending precision to two places: (place, rule_id, precision)."""
    rows = a01_judgments_by_rule(judgments).select("rule_id", "total", F.round("precision", 2).alias("precision"))
    return rows.orderBy("precision", "rule_id")


def a20_burn_and_wrong(judgments: DataFrame, calls: DataFrame, fan_out: bool = True) -> DataFrame:
    """By rule the cost of its checks beside its verdicts. A judgment counts once for each call that matches it, as a
    plain left join gives it; without fan_out it counts once."""
    stage = F.concat(F.lit("rule_check:"), "rule_id")
    if not fan_out:
        calls = calls.groupBy("paper_id", "stage").agg(F.sum("cost_micro").alias("cost_micro"))
    keyed = judgments.withColumn("stage", stage)
    rows = keyed.join(calls.select("paper_id", "stage", "cost_micro"), ["paper_id", "stage"], "left")
    return rows.groupBy("rule_id").agg(F.coalesce(F.sum("cost_micro"), F.lit(0)).alias("cost_micro"), F.count(F.lit(1)).alias("judged"), F.sum(F.when(F.col("verdict") == "wrong", 1).otherwise(0)).alias("wrong"))


def result_json(defects: DataFrame) -> DataFrame:
    """(paper_id, result_json): a paper's defects and the counts by rule, as the text that is stored."""
    meta = defects.groupBy("paper_id", "rule_id").agg(F.count(F.lit(1)).alias("defect_count")).groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("rule_id", "defect_count"))).alias("rule_meta"))
    lists = defects.groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("pos", "defect_id", "rule_id", "severity"))).alias("defects"))
    return lists.join(meta, "paper_id").select("paper_id", F.to_json(F.struct("defects", "rule_meta")).alias("result_json"))


def a21_json_extract(results: DataFrame) -> DataFrame:
    """Out of the stored text: the number of defects, and the first one's rule."""
    return results.select("paper_id", F.json_array_length(F.get_json_object("result_json", "$.defects")).cast("long").alias("n_defects"), F.get_json_object("result_json", "$.defects[0].rule_id").alias("first_rule"))


def a22_json_each(results: DataFrame) -> DataFrame:
    """A row for each rule of the stored text that has defects; texts that cannot be parsed give none."""
    parsed = F.from_json("result_json", "rule_meta array<struct<rule_id: string, defect_count: long>>")
    return results.select("paper_id", F.inline(parsed["rule_meta"])).where("defect_count > 0")


def a23_context_share(calls: DataFrame, n: int = 10) -> DataFrame:
    """The n calls that fill most of their model's window: a million tokens where its name says [1m], else 200,000."""
    window = F.when(F.col("model").contains("[1m]"), 1_000_000).otherwise(200_000)
    return calls.select("id", "stage", "model", F.round(F.col("input_tokens") * 100.0 / window, 2).alias("share")).orderBy(F.desc("share"), "id").limit(n)


def a24_phase(judgments: DataFrame, least: int = 3) -> DataFrame:
    """Rules with enough judgments for examples are active, the others still gather."""
    n = F.count(F.lit(1))
    return judgments.groupBy("rule_id").agg(n.alias("n"), F.when(n >= least, "active").otherwise("collecting").alias("phase"))


def a25_kpis(stats: DataFrame) -> DataFrame:
    """One row over a09_rule_stats(): defects, judgments and the precision of the pooled counts."""
    total, correct, partial = (F.sum(c) for c in ("total", "correct", "partial"))
    return stats.agg(F.sum("total_defects").alias("defects"), total.alias("judged"), precision(correct, partial, total).alias("precision"))


def fire_rate(fired: Column, analysed: Column) -> Column:
    return F.when(analysed > 0, fired / analysed).otherwise(0.0)


def a26_fire_rates(stats: DataFrame) -> DataFrame:
    return stats.select("rule_id", fire_rate(F.col("papers_fired"), F.col("papers_analyzed")).alias("fire_rate"))


def rule_status(analysed: Column, fired: Column, n: Column, p: Column) -> Column:
    """The first that holds: no data, never fired, review, good, high fire; else working."""
    enough = n >= 3
    ladder = F.when(analysed == 0, "no data").when(fired == 0, "never fired").when(enough & (p < 0.5), "review").when(enough & (p >= 0.7), "good")
    return ladder.when(fire_rate(fired, analysed) > 0.8, "high fire").otherwise("working")


def a27_rule_status(stats: DataFrame) -> DataFrame:
    return stats.select("rule_id", rule_status(F.col("papers_analyzed"), F.col("papers_fired"), F.col("total"), F.col("precision")).alias("status"))


def badge(x: Column) -> Column:
    return F.when(x.isNull(), "none").when(x >= 0.8, "high").when(x >= 0.5, "medium").otherwise("low")


def a28_badges(defects: DataFrame) -> DataFrame:
    return defects.groupBy(badge(F.col("confidence")).alias("badge")).agg(F.count(F.lit(1)).alias("n"))


def a29_bucket_shares(buckets: DataFrame) -> DataFrame:
    """Per cent of all judgments in each bucket of a05_evaluation_by_confidence()."""
    whole = buckets.agg(F.sum("total").alias("whole"))
    return buckets.crossJoin(F.broadcast(whole)).select("bucket", F.when(F.col("whole") > 0, F.col("total") * 100.0 / F.col("whole")).otherwise(0.0).alias("share"))  # one row


def a30_verdicts_of_result(defects: DataFrame, judgments: DataFrame) -> DataFrame:
    rows = defects.select(*DEFECT).distinct().join(judgments.select(*DEFECT, "verdict"), DEFECT, "left")
    return rows.groupBy("paper_id").agg(F.count("verdict").alias("judged"), *(F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS))


def severity_rank(severity: Column) -> Column:
    """0 for the gravest; what is no severity comes last."""
    place = F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)
    return F.when(place > 0, place - 1).otherwise(len(SEVERITIES))


def a31_by_severity(defects: DataFrame) -> DataFrame:
    """Each paper's defects by severity, in input order."""
    rows = defects.where(F.col("severity").isin(*SEVERITIES)).groupBy("paper_id", "severity").agg(F.sort_array(F.collect_list(F.struct("pos", "defect_id"))).alias("d"))
    return rows.select("paper_id", severity_rank(F.col("severity")).cast("long").alias("place"), "severity", F.array_join(F.transform("d", lambda d: d["defect_id"]), "|").alias("defect_ids"))


def a32_by_rule(defects: DataFrame) -> DataFrame:
    """Each paper's defects by rule: sorted by severity, labelled by the type of the first one before the sort."""
    item = F.struct(severity_rank(F.col("severity")).alias("rank"), "pos", "defect_id")
    rows = defects.groupBy("paper_id", "rule_id").agg(F.sort_array(F.collect_list(item)).alias("d"), F.min_by("defect_type", "pos").alias("label"))
    return rows.select("paper_id", "rule_id", "label", F.array_join(F.transform("d", lambda d: d["defect_id"]), "|").alias("defect_ids"))


def a33_token_cost(calls: DataFrame) -> DataFrame:
    """Calls with the cost of their tokens by the price list: of the model's whole name, else of its name up to "["."""
    price = F.create_map(*(x for name, p in PRICES.items() for x in (F.lit(name), F.array(*map(F.lit, p)))))
    p = F.coalesce(F.try_element_at(price, F.col("model")), F.try_element_at(price, F.split_part("model", F.lit("["), F.lit(1))))
    cost = (F.col("input_tokens") * p[0] + F.col("output_tokens") * p[1] + F.col("cached_tokens") * p[2]) / 1e6
    return calls.select("id", "model", F.round(F.coalesce(cost, F.lit(0.0)), 6).alias("cost"))


def a34_usage_split(calls: DataFrame) -> DataFrame:
    return calls.select("id", F.greatest(F.col("input_tokens") - F.col("cached_tokens"), F.lit(0)).alias("fresh_tokens"), "cached_tokens")


def a35_cross_section(defects: DataFrame) -> DataFrame:
    return defects.groupBy("paper_id").agg(F.count(F.lit(1)).alias("defects"), F.count_if(F.col("rule_id").isin(*CROSS_SECTION_RULES)).alias("cross_section"))


def size_label(n: Column) -> Column:
    """Bytes, whole KB, or MB with one place, rounded half up; empty for none."""
    kb, tenths = F.floor((n + 512) / 1024).cast("string"), F.floor((n * 10 + (1 << 19)) / (1 << 20))
    mb = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" MB"))
    return F.when(n.isNull() | (n == 0), "").when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(kb, F.lit(" KB"))).otherwise(mb)


def ellipsis(text: Column, limit: int = 160) -> Column:
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def a36_labels(messages: DataFrame) -> DataFrame:
    return messages.select("id", size_label(F.octet_length("content").cast("long")).alias("size"), ellipsis(F.col("content")).alias("preview"))


def age_label(now: Column, then: Column) -> Column:
    minutes = F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 60)
    return F.when(minutes < 1, "now").when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h"))).otherwise(F.date_format(then, "yyyy-MM-dd"))


def a37_ages(events: DataFrame, now: str) -> DataFrame:
    return events.select("id", age_label(F.lit(now).cast("timestamp"), F.col("created_at")).alias("age"))
