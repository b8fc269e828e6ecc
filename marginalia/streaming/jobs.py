"""Job states on a stream (T06, T08, T11): state with timers, by bucket of jobs.

A job's state is how far it has come and when it was last heard of. Updates may come in any order: the furthest state
stands, and the latest time. Timers of the event's time do what sweeps do in a batch: a job unfinished for ``stalled``
seconds ends as interrupted, and one that ended is forgotten ``keep`` seconds later, so that state follows the jobs of
late, not all jobs. Both are restored from the checkpoint. Jobs are kept in buckets by their hash, so that the number of
calls follows the buckets, and what a call does is done for all of its jobs at once.

Needs Spark's RocksDB state store (spark.sql.streaming.stateStore.providerClass), which with_store() sets.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .limits import STATES

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds that an ended analysis or import is kept.
KEEP, KEEP_IMPORT = 3600, 1800
#: Buckets that jobs are kept in; a checkpoint is bound to their number.
BUCKETS = 4096
ENDED, ERROR = STATES.index("done") + 1, STATES.index("error") + 1
OUT = "job string, state string, time timestamp, message string"


def with_store(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


class Jobs(StatefulProcessor):
    """Changes of the states of a bucket's jobs; gone: one ended ``keep`` seconds ago.

    A bucket's jobs are one value, read and written once for each batch that brings some of them, and its timer is for the
    first of them that is due.
    """

    def __init__(self, stalled: int, keep: int) -> None:
        self.stalled, self.keep = stalled * 1000, keep * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("jobs", "jobs binary")

    def _held(self) -> pd.DataFrame:
        if not self.state.exists():
            return pd.DataFrame({"rank": pd.Series([], dtype="int64"), "at": pd.Series([], dtype="int64")}, index=pd.Index([], dtype="object", name="job"))
        with pa.ipc.open_stream(bytes(self.state.get()[0])) as stored:
            return stored.read_all().to_pandas().set_index("job")

    def _due(self, held: pd.DataFrame) -> pd.Series:
        return held["at"] + (held["rank"] >= ENDED).map({True: self.keep, False: self.stalled}).astype("int64")

    def _hold(self, held: pd.DataFrame) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held.empty:
            self.state.clear()
            return
        rows = pa.Table.from_pandas(held[["rank", "at"]].reset_index(names="job"), preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows)
        self.state.update((sink.getvalue().to_pybytes(),))
        self.handle.registerTimer(int(self._due(held).min()))

    def _rows(self, jobs: pd.DataFrame, states: list[str], message: str = "") -> pd.DataFrame:
        return pd.DataFrame({"job": jobs.index, "state": states, "time": pd.to_datetime(jobs["at"].to_numpy(), unit="ms"), "message": message})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        own = self._held()
        new = pd.concat([batch[["job", "rank", "at"]].astype({"rank": "int64", "at": "int64"}).groupby("job", dropna=False).max() for batch in rows])
        held = pd.concat([own, new]).groupby(level=0, dropna=False).max()
        held.index.name = "job"
        self._hold(held)
        further = held[held["rank"] > own["rank"].reindex(held.index).fillna(0)]
        if len(further):
            yield self._rows(further, [STATES[r - 1] for r in further["rank"]])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self._held()
        due = self._due(held) <= timerValues.getCurrentWatermarkInMs()
        ended, stalled = held[due & (held["rank"] >= ENDED)], held[due & (held["rank"] < ENDED)]
        ended, stalled = ended.assign(at=ended["at"] + self.keep), stalled.assign(rank=ERROR, at=stalled["at"] + self.stalled)
        self._hold(pd.concat([held[~due], stalled]))
        if len(ended):
            yield self._rows(ended, ["gone"] * len(ended))
        if len(stalled):
            yield self._rows(stalled, ["error"] * len(stalled), "Interrupted")

    def close(self) -> None:
        pass


def job_changes(updates: DataFrame, late: str, stalled: int, keep: int = KEEP) -> DataFrame:
    """(job, state, time, message) of a stream of updates (job, time, state); unknown states are left out."""
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("state")).cast("int")
    job = F.col("job").cast("string")
    known = updates.withWatermark("time", late).select(F.pmod(F.xxhash64(job), F.lit(BUCKETS)).cast("int").alias("bucket"), job.alias("job"), "time", rank.alias("rank"), F.unix_millis("time").alias("at")).where(F.col("rank") > 0)
    return known.groupBy("bucket").transformWithStateInPandas(statefulProcessor=Jobs(stalled, keep), outputStructType=OUT, outputMode="append", timeMode="eventTime")


def latest(changes: DataFrame) -> DataFrame:
    """(job, state, message) after all changes; jobs that are gone are left out."""
    order: Column = F.array_position(F.array(*map(F.lit, [*STATES, "gone"])), F.col("state"))
    last = changes.groupBy("job").agg(F.max_by(F.struct("state", "message"), order).alias("last"))
    return last.where("last.state <> 'gone'").select("job", "last.state", "last.message")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that executors share: in spark.checkpoint.dir, or on a local master in a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="marginalia-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_through(changes: DataFrame, folder: str) -> DataFrame:
    """Run a stream over all that its source has now, to a table in folder, and read that."""
    query = changes.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return changes.sparkSession.read.schema(changes.schema).parquet(f"{folder}/out")
