"""Upserts, deletes and retention (M01-M16) as folds of logs: each takes frames and gives the frame that is left.

A log's order is a column. The latest row of a key is a partial aggregate before its shuffle, so that a key of many
rows costs no task more than another; deletes are anti joins on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: list[str], order: str, keep_first: tuple[str, ...] = ()) -> DataFrame:
    """The last row of each key; the columns of keep_first stay those of its first row."""
    rest = [c for c in log.columns if c not in key]
    last, first = F.max_by(F.struct(*rest), order).alias("_last"), F.min_by(F.struct(*rest), order).alias("_first")
    rows = log.groupBy(*key).agg(last, *([first] if keep_first else []))
    return rows.select(*key, *(F.col("_first" if c in keep_first else "_last")[c].alias(c) for c in rest))


def valid(log: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    """Rows whose value is of the domain."""
    return log.where(F.col(column).isin(*domain))


def replace_keys(base: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Base with all rows of the keys in new replaced by those of new."""
    return base.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def cascade(gone: DataFrame, key: str, **dependents: DataFrame) -> DataFrame:
    """(table_name, key, n): what is left in dependents without the keys of gone."""
    out = None
    for name, frame in dependents.items():
        left = frame.join(gone.select(key), key, "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), key, "n")
        out = left if out is None else out.unionByName(left)
    return out


def keep_newest(log: DataFrame, key: str, order: str, n: int, only: Column | None = None) -> DataFrame:
    """The newest n rows of each key; rows for which ``only`` does not hold all stay."""
    only = None if only is None else F.coalesce(only, F.lit(False))  # a null label is no autosave
    held = log if only is None else log.where(only)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    newest = held.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")
    return newest if only is None else newest.unionByName(log.where(~only))


def fold_updates(patches: DataFrame, key: str, order: str, expected: str) -> DataFrame:
    """(key, version, applied): patches in order, each applied where it expects the version that stands.

    Each patch depends on whether the ones before it were applied, so a key's patches are folded as one array.
    """
    rows = patches.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, expected))).alias("p"))
    step = lambda v, p: F.when(p[expected] == v, v + 1).otherwise(v)
    return rows.select(key, F.aggregate("p", F.lit(0).cast("long"), step).alias("version"), F.size("p").cast("long").alias("patches"))


def applied_patches(patches: DataFrame, key: str, order: str, expected: str, fields: list[str]) -> DataFrame:
    """(key, version, fields): as fold_updates(), with what the patches that were applied leave: each sets the fields
    that it does not have as null; one that sets none is no patch and counts for nothing."""
    some = patches.where(F.coalesce(*(F.col(f).cast("string") for f in fields)).isNotNull())
    rows = some.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, expected, *fields))).alias("p"))
    start = F.struct(F.lit(0).cast("long").alias("version"), *(F.lit(None).cast(patches.schema[f].dataType).alias(f) for f in fields))
    step = lambda v, p: F.when(p[expected] == v["version"], F.struct((v["version"] + 1).alias("version"), *(F.coalesce(p[f], v[f]).alias(f) for f in fields))).otherwise(v)
    return rows.select(key, F.aggregate("p", start, step).alias("v")).select(key, "v.*")


def restore(current: DataFrame, versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """The log records (doc_id, seq, label, content) that going back to wanted (doc_id, version_id) writes."""
    backup = current.join(wanted, "doc_id", "left_semi").select("doc_id", F.lit(0).alias("seq"), F.lit("restore-backup").alias("label"), "content")
    old = versions.join(wanted, ["doc_id", "version_id"], "left_semi").select("doc_id", F.lit(1).alias("seq"), F.lit("restored").alias("label"), "content")
    return backup.unionByName(old)


def interrupt(events: DataFrame) -> DataFrame:
    """Events with what was pending ended as an error; the messages of all others stay."""
    pending = F.coalesce(F.col("status") == "pending", F.lit(False))
    return events.withColumn("error_message", F.when(pending, "Interrupted").otherwise(F.col("error_message"))).withColumn("status", F.when(pending, "error").otherwise(F.col("status")))


def finished(events: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """Events (id, status, error_message) after the reports of jobs that are done (id) or have failed (id, message)."""
    rows = events.join(done.select("id", F.lit(True).alias("_done")).distinct(), "id", "left").join(failed.select("id", F.col("message").alias("_message"), F.lit(True).alias("_failed")), "id", "left")
    status = F.when(F.col("_failed"), "error").when(F.col("_done"), "done").otherwise(F.col("status"))
    return rows.withColumn("status", status).withColumn("error_message", F.when(F.col("_failed"), F.col("_message")).otherwise(F.col("error_message"))).drop("_done", "_failed", "_message")


def list_events(events: DataFrame, status: str | None, limit: int) -> DataFrame:
    """The newest events, of a status or of all, 1 to 500 of them."""
    rows = events if status is None else events.where(F.col("status") == status)
    return rows.orderBy(F.desc("id")).limit(min(500, max(1, limit)))


def fits(text: Column, limit: int = 25 << 20) -> Column:
    """Whether a text has at most so many bytes."""
    return F.coalesce(F.octet_length(text) <= limit, F.lit(True))


def backfilled(results: DataFrame, column: str, path: str) -> DataFrame:
    """A column filled from the length of an array in result_json where it is null or absent; null where that cannot be parsed."""
    found = F.json_array_length(F.get_json_object("result_json", path)).cast("long")
    return results.withColumn(column, F.coalesce(column, found) if column in results.columns else found)


def base_name(path: Column) -> Column:
    """The last part of an absolute path; a relative one stays."""
    return F.when(path.startswith("/"), F.element_at(F.split(path, "/"), -1)).otherwise(path)


def with_sentinels(asked: DataFrame, chunks: DataFrame, key: str = "paper_id") -> DataFrame:
    """Chunks, and a row of the source none for each key that was asked for and has no chunk."""
    empty = asked.select(key).distinct().join(chunks, key, "left_anti").select(key, F.lit(0).alias("idx"), F.lit("").alias("text"), F.lit("none").alias("source"))
    return chunks.unionByName(empty)
