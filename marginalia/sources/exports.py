"""Sinks and guarded sources: CSV and JSON texts of frames, upserts of a graph, merged corpora, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: what a CSV file begins with for spreadsheets.
BOM = "﻿"


def csv_field(value: Column) -> Column:
    """Quoted where it has a quote, a comma or a line's end; empty for null."""
    s = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(s.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(row): each row as a line, without its end."""
    return rows.select(F.array_join(F.array(*(csv_field(F.col(c)) for c in columns)), ",").alias("row"))


def write_csv(rows: DataFrame, columns: list[str], folder: str) -> None:
    """One file for each partition, with head and BOM, lines ended by CR LF; rows keep their order within one."""
    head = BOM + ",".join(columns)
    lines = csv_rows(rows, columns).select(F.concat("row", F.lit("\r")).alias("value"))
    lines.write.option("lineSep", "\n").text(folder)
    rows.sparkSession.createDataFrame([(head + "\r",)], "value string").coalesce(1).write.mode("append").option("lineSep", "\n").text(f"{folder}/head")


def json_rows(rows: DataFrame) -> DataFrame:
    """(json): each row as a JSON object, nulls left out."""
    return rows.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns))).alias("json"))


def merged_corpora(papers: list[DataFrame], results: list[DataFrame]) -> DataFrame:
    """Papers of several stores that have a result in their own; the first store that has a paper wins."""
    out = None
    for place, (p, r) in enumerate(zip(papers, results, strict=True)):
        own = p.join(r.select("paper_id"), "paper_id", "left_semi").withColumn("store", F.lit(place))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    first = Window.partitionBy("paper_id").orderBy("store")
    return out.withColumn("_place", F.row_number().over(first)).where("_place = 1").drop("_place")


def graph_upsert(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows of a graph after new ones were merged by key; merging twice changes nothing.

    Rows are dealt by key before they are grouped: most keys are there once, so that an aggregate before the shuffle would
    sort them all and leave as many.
    """
    rows = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))).repartition(*key)
    rest = [c for c in stored.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "_new").alias("r")).select(*key, "r.*") if rest else rows.select(*key).distinct()


def kind_of(path: Column) -> Column:
    """Whether a file is read as PDF or as text."""
    return F.when(F.lower(path).endswith(".pdf"), "pdf").otherwise("text")


def expands_too_far(entries: DataFrame, key: str, limit: int = 200 << 20) -> DataFrame:
    """Archives (key, size of each entry) whose entries have over limit bytes together."""
    return entries.groupBy(key).agg(F.sum("size").alias("bytes")).where(F.col("bytes") > limit)


def fetchable(url: Column, hosts: Column) -> Column:
    """An http address whose host has only addresses of the open net; hosts: array<string> of those it has."""
    private = r"^(?:10\.|127\.|0\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|::1$|f[cd]|fe80)"
    return url.rlike("(?i)^https?://[^/]") & (F.size(hosts) > 0) & ~F.exists(hosts, lambda h: h.rlike(private))


def kept_images(images: DataFrame, key: str, most: int = 100, limit: int = 10 << 20) -> DataFrame:
    """Images (key, place, bytes, colours) of a document in order, the first so many that are small enough and have
    more than one colour; those left out take no room."""
    some = images.where((F.col("bytes") <= limit) & (F.col("colours") > 1))
    return some.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("place"))).where(F.col("_n") <= most).drop("_n")
