"""Evaluation statistics E01-E09 over pairwise judgments and over runs of an analysis.

Agreement is computed from counts of labels by unit, never from pairs of rows, so that a unit with many raters costs no
more than its labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = ["paper_id", "arm1", "arm2"]


def e05_swap_verdict(first: Column, second: Column) -> tuple[Column, Column]:
    """(winner, consistent) of the labels a, b or tie of a run and of the run with its arms swapped."""
    back = F.when(second == "a", "b").when(second == "b", "a").otherwise(second)
    return F.when((first == back) & (first != "tie"), first).otherwise("tie"), first == back


def e01_win_rates(judged: DataFrame) -> DataFrame:
    """By model and ordered pair of arms: n, wins of either, ties, and the share of runs that a swap turns."""
    win = lambda w: F.count_if(F.col("winner") == w)
    rows = judged.groupBy("model", "arm1", "arm2").agg(F.count(F.lit(1)).alias("n"), win("a").alias("wins1"), win("b").alias("wins2"), win("tie").alias("ties"), F.count_if(~F.col("consistent")).alias("swapped"))
    return rows.select("model", "arm1", "arm2", "n", "wins1", "wins2", "ties", F.round(F.col("swapped") / F.col("n"), 3).alias("swap_rate"))


def last_labels(judged: DataFrame) -> DataFrame:
    """The last winner that each model gives each unit."""
    return judged.groupBy(*UNIT, "model").agg(F.max_by("winner", "pos").alias("winner"))


def e02_agreement(judged: DataFrame) -> DataFrame:
    """One row: units that two models or more have judged, and the share of them in which all agree."""
    units = last_labels(judged).groupBy(*UNIT).agg(F.count(F.lit(1)).alias("models"), F.count_distinct("winner").alias("labels")).where("models >= 2")
    n, same = F.count(F.lit(1)), F.count_if(F.col("labels") == 1)
    return units.agg(n.alias("units"), F.when(n > 0, F.round(same / n, 3)).alias("agreement"))


def e03_alpha(judged: DataFrame) -> DataFrame:
    """One row: Krippendorff's alpha for nominal labels; null without pairs, 1 where no disagreement is expected."""
    counts = last_labels(judged).groupBy(*UNIT, "winner").agg(F.count(F.lit(1)).alias("c"))
    units = counts.groupBy(*UNIT).agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("squares")).where("m >= 2")
    weighed = counts.join(units, UNIT)
    # of m labels, c of a kind: c * (m - c) ordered pairs of different kinds, each of weight 1 / (m - 1)
    observed = units.agg(F.sum((F.col("m") * F.col("m") - F.col("squares")) / (F.col("m") - 1)).alias("differing"), F.sum("m").alias("n"))
    expected = weighed.groupBy("winner").agg(F.sum("c").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("same"))
    both = observed.crossJoin(F.broadcast(expected))  # one row each
    chance = (F.col("n") * F.col("n") - F.col("same")) / (F.col("n") - 1)
    return both.select(F.when(F.col("n") >= 2, F.when(chance == 0, 1.0).otherwise(F.round(1 - F.col("differing") / chance, 3))).alias("alpha"))


def e04_consistency(runs: DataFrame) -> DataFrame:
    """By group of runs (group, run, n): their number, mean, deviation over all of them, and coefficient of variation."""
    rows = runs.groupBy("group").agg(F.count(F.lit(1)).alias("runs"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"))
    return rows.select("group", "runs", F.round("mean", 3).alias("mean"), F.round("sd", 3).alias("sd"), F.when(F.col("mean") != 0, F.round(F.col("sd") / F.col("mean"), 3)).alias("cv"))


def e04_jaccard(findings: DataFrame) -> DataFrame:
    """By group of runs (group, run, issue) the mean similarity of their sets of issues over all pairs of runs, runs
    without an issue included; two empty sets are alike.

    Runs of one set are counted and then stand for each other: pairs are of different sets that share an issue, as often as
    their runs make pairs. Runs of the same set add 1 for each pair; sets without a common issue add 0.
    """
    issue = F.lower(F.trim(F.coalesce("issue", F.lit(""))))
    runs = findings.groupBy("group", "run").agg(F.sort_array(F.collect_set(F.when(issue != "", issue))).alias("issues"))
    kinds = runs.groupBy("group", "issues").agg(F.count(F.lit(1)).alias("c"))
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    # a set's name is its issues' hash, kept with the array that it is of: equal names of other sets stay apart
    named = kinds.select("group", "issues", "c", F.size("issues").alias("n"), F.xxhash64("issues").alias("h"))
    sets = named.select("group", "issues", "h", "c", "n", F.explode("issues").alias("issue"))
    other = sets.select("group", F.col("issues").alias("issues2"), F.col("h").alias("h2"), F.col("c").alias("c2"), F.col("n").alias("n2"), "issue")
    apart = (F.col("h") < F.col("h2")) | ((F.col("h") == F.col("h2")) & (F.col("issues") < F.col("issues2")))
    # a pair of sets is met at the first issue that they share, so that it needs no grouping
    both = F.array_intersect("issues", "issues2")
    shared = sets.join(other, ["group", "issue"]).where(apart).withColumn("both", both).where(F.get("both", F.lit(0)) == F.col("issue"))
    size = F.size("both")
    alike = shared.groupBy("group").agg(F.sum(F.col("c") * F.col("c2") * (size / (F.col("n") + F.col("n2") - size))).alias("alike"))
    counts = kinds.groupBy("group").agg(F.sum("c").alias("r"), F.sum(pairs("c")).alias("same"))
    return counts.join(alike, "group", "left").select("group", F.when(F.col("r") > 1, F.round((F.coalesce("alike", F.lit(0.0)) + F.col("same")) / pairs("r"), 3)).alias("jaccard"))


def e10_corpus(papers: DataFrame, ids: list[str] | None = None, first: int | None = None, fresh: bool = False) -> DataFrame:
    """Papers of an experiment: those named, or the first so many by id; fresh keeps those with a file."""
    rows = papers if ids is None else papers.where(F.col("paper_id").isin(*ids))
    rows = rows if first is None else rows.orderBy("paper_id").limit(first)
    return rows.where("can_fresh") if fresh else rows


def e06_lenient_verdict(answer: Column) -> Column:
    """X, Y or tie: what the object between an answer's first and last brace says, if it is one and names one of them; else
    the quoted label, X before Y, in an answer that speaks of a winner; else tie."""
    # in brackets, so that anything behind the object's end is an error or another element
    held = F.try_parse_json(F.concat(F.lit("["), F.nullif(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), F.lit("")), F.lit("]")))
    found = F.when(F.try_variant_get(held, "$[1]", "string").isNull(), F.upper(F.trim(F.try_variant_get(held, "$[0].winner", "string"))))
    said = F.upper(F.coalesce(answer, F.lit("")))
    label = F.when(found.isin("X", "Y"), found).when(found == "TIE", "tie")
    quoted = F.when(said.contains("WINNER"), F.when(said.contains('"X"'), "X").when(said.contains('"Y"'), "Y"))
    return F.coalesce(label, quoted, F.lit("tie"))


def e07_audit(stored: DataFrame, recomputed: DataFrame, key: list[str], *columns: str) -> DataFrame:
    """Keys whose stored values are not those recomputed, missing ones of either side included."""
    s = stored.select(*key, F.struct(*columns).alias("stored"))
    r = recomputed.select(*key, F.struct(*columns).alias("recomputed"))
    return s.join(r, key, "full").where(~F.col("stored").eqNullSafe(F.col("recomputed")))


def e08_arm_pairs(arms: DataFrame, judges: DataFrame) -> DataFrame:
    """Each pair of arms in their order with each judge; both are short lists of an experiment."""
    other = arms.select(F.col("arm").alias("arm2"), F.col("place").alias("place2"))
    return arms.withColumnRenamed("arm", "arm1").join(F.broadcast(other), F.col("place") < F.col("place2")).join(F.broadcast(judges)).select("arm1", "arm2", "model")


def e09_findings(defects: DataFrame, arms: tuple[str, ...]) -> DataFrame:
    """Papers by arms, the number of findings in each cell."""
    return defects.groupBy("paper_id").pivot("arm", list(arms)).agg(F.count(F.lit(1))).na.fill(0)
