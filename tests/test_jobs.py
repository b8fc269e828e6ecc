"""Job states on a stream against the batch."""

import datetime as dt
import random

from pyspark.sql import functions as F

from marginalia.streaming import jobs as J
from marginalia.streaming import limits as T

START = dt.datetime(2024, 1, 1)
SCHEMA = "job string, time timestamp, state string"


def updates(seed=4):
    rng = random.Random(seed)
    rows = []
    for job in range(40):
        reached = rng.randint(0, 4)
        for k, state in enumerate(T.STATES[: reached + 1]):
            if state != "done" or reached == 3:
                rows.append((f"j{job}", START + dt.timedelta(seconds=job * 7 + k * 5), state))
        rows.append((f"j{job}", START + dt.timedelta(seconds=job * 7), "unknown"))
    rng.shuffle(rows)
    return rows


def stream(spark, tmp_path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")


def add(spark, tmp_path, rows, files=1):
    for k in range(files):
        spark.createDataFrame(rows[k::files], SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")


def test_states_of_a_stream_are_those_of_the_batch_and_expire(spark, tmp_path):
    J.with_store(spark)
    rows = updates()
    add(spark, tmp_path, rows[: len(rows) // 2], 3)
    changes = lambda: J.job_changes(stream(spark, tmp_path), "1 hour", stalled=3000, keep=600)
    folder = f"file://{tmp_path}/job"
    J.run_through(changes(), folder)
    add(spark, tmp_path, rows[len(rows) // 2 :], 2)  # the stream begins anew from its checkpoint
    got = {(r["job"], r["state"]) for r in J.latest(J.run_through(changes(), folder)).collect()}
    batch = T.job_states(spark.createDataFrame(rows, SCHEMA), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert got == {(r["job"], r["state"]) for r in batch.collect()}
    ended = {j for j, s in got if s in ("done", "error")}
    # the watermark passes what ended, then what stalled
    add(spark, tmp_path, [("late", START + dt.timedelta(hours=1, seconds=1500), "queued")])
    after = {r["job"]: (r["state"], r["message"]) for r in J.latest(J.run_through(changes(), folder)).collect()}
    assert ended and not ended & set(after)
    assert {s for j, (s, _) in after.items() if j != "late"} == {"queued", "extracting", "checking"}
    add(spark, tmp_path, [("later", START + dt.timedelta(hours=2), "queued")])
    after = {r["job"]: (r["state"], r["message"]) for r in J.latest(J.run_through(changes(), folder)).collect()}
    assert {v for j, v in after.items() if not j.startswith("late")} == {("error", "Interrupted")}
    add(spark, tmp_path, [("last", START + dt.timedelta(hours=9), "queued")])
    assert {r["job"] for r in J.latest(J.run_through(changes(), folder)).collect()} <= {"last", "late", "later"}


def test_a_call_handles_all_jobs_of_a_bucket(spark, tmp_path, monkeypatch):
    """One call to a bucket of many jobs, null names and repeated updates included, gives a row for each job that went on."""
    J.with_store(spark)
    monkeypatch.setattr(J, "BUCKETS", 2)
    rows = [(f"j{k}", START + dt.timedelta(seconds=k), T.STATES[k % 4]) for k in range(500)] + [(None, START, "queued"), ("j1", START, "queued")]
    add(spark, tmp_path, rows)
    changes = J.job_changes(stream(spark, tmp_path), "1 hour", stalled=3000, keep=600)
    assert "bucket" in changes._jdf.queryExecution().analyzed().toString()
    got = J.latest(J.run_through(changes, f"file://{tmp_path}/job")).collect()
    assert {(r["job"], r["state"]) for r in got} == {(j, s) for j, _, s in rows[:501]}
