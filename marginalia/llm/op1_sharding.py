"""Operator 1: a store of immutable shards with size-tiered compaction and versioned manifests.

Arrivals are appended as small Parquet shards, one file for each task or ROWS rows. Compaction puts shards into tiers,
each FAN times the size of the one below, and merges runs of similar size until files reach the target size; one Spark
job merges all runs of a round, a task for each run, without a shuffle. Shards never change: a manifest lists those
that make up a version, and committing is the atomic creation of the next manifest file, so a reader sees a whole
version or the one before, and a writer that lost the race fails and can retry. Shards that no manifest lists are
leftovers of lost tasks and are not read.

Defined cases: any rows are kept as they are, nulls, repeated rows and all columns included; an empty arrival commits
a version without new shards; rows keep no order.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .tables import load, new_path

#: Rows of an appended shard, bytes of a compacted one, and how many shards of a tier make one of the next.
ROWS = 4_096
TARGET = 64 << 20
FAN = 4
#: Runs merged by one job; more are merged in further jobs of the same round.
RUNS = 200


@dataclass(frozen=True)
class Shard:
    path: str
    rows: int
    bytes: int


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class SchemaClash(ValueError):
    """An arrival has a column in another type than the store."""


def merged_schema(store: StructType | None, arrival: StructType) -> StructType:
    """The columns of both, all of them nullable: each shard lacks what came after it."""
    fields = {f.name.lower(): f for f in (store.fields if store is not None else [])}
    for f in arrival.fields:
        known = fields.setdefault(f.name.lower(), f)
        if known.dataType.simpleString() != f.dataType.simpleString():
            raise SchemaClash(f"{f.name} is {known.dataType.simpleString()} in the store, {f.dataType.simpleString()} in the arrival")
    return StructType([StructField(f.name, f.dataType, True) for f in fields.values()])


class ShardStore:
    """A table of shards in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, target: int = TARGET, fan: int = FAN) -> None:
        self.spark, self.folder, self.target, self.fan = spark, folder.rstrip("/"), target, fan
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The latest version; 0 has no shards."""
        place = self._path(f"{self.folder}/manifests")
        if not self._fs.exists(place):
            return 0
        return max((int(s.getPath().getName().removesuffix(".json")) for s in self._fs.listStatus(place) if not s.getPath().getName().startswith((".", "_"))), default=0)

    def manifest(self, version: int | None = None) -> tuple[list[Shard], StructType | None]:
        version = self.version() if version is None else version
        if not version:
            return [], None
        text = "\n".join(r[0] for r in self.spark.read.text(f"{self.folder}/manifests/{version:09d}.json").collect())
        found = json.loads(text)
        return [Shard(**s) for s in found["shards"]], StructType.fromJson(found["schema"])

    def commit(self, base: int, shards: list[Shard], schema: StructType) -> int:
        """Make shards the version after base: written aside, then put in place, which fails where the name is taken."""
        version = base + 1
        aside = self._path(f"{self.folder}/aside/{uuid.uuid4().hex}")
        self._fs.mkdirs(self._path(f"{self.folder}/manifests"))
        out = self._fs.create(aside, False)
        out.write(json.dumps({"version": version, "schema": json.loads(schema.json()), "shards": [asdict(s) for s in shards]}).encode())
        out.close()
        try:
            self._place(aside, self._path(f"{self.folder}/manifests/{version:09d}.json"))
        finally:
            self._fs.delete(aside, False)
        return version

    def _place(self, aside: JavaObject, place: JavaObject) -> None:
        if self._fs.getScheme() == "file":
            try:
                os.link(aside.toUri().getPath(), place.toUri().getPath())
            except FileExistsError:
                raise Conflict(f"{place.getName()} exists") from None
            return
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            context.rename(aside, place, none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                raise Conflict(f"{place.getName()} exists") from None
            raise

    def _written(self, folder: str, schema: StructType) -> list[Shard]:
        """The shards in a folder that Spark has just written: rows counted from the files' footers."""
        sizes = {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().startswith("part-")}
        if not sizes:
            return []
        counts = self.spark.read.schema(schema).parquet(folder).groupBy(F.input_file_name().alias("path")).agg(F.count(F.lit(1)).alias("n")).collect()
        rows = {r["path"].rpartition("/")[2]: r["n"] for r in counts}
        return [Shard(f"{folder.removeprefix(self.folder + '/')}/{name}", rows[name], size) for name, size in sorted(sizes.items()) if rows.get(name)]

    def append(self, arrival: DataFrame, rows: int = ROWS) -> int:
        """Write an arrival as small shards and commit them, after whichever versions other writers commit meanwhile."""
        merged_schema(self.manifest()[1], arrival.schema)  # a clash is refused before anything is written
        folder = f"{self.folder}/shards/{uuid.uuid4().hex}"
        arrival.write.option("maxRecordsPerFile", rows).parquet(folder)
        new = self._written(folder, arrival.schema)
        while True:
            base = self.version()
            shards, schema = self.manifest(base)
            try:
                return self.commit(base, shards + new, merged_schema(schema, arrival.schema))
            except Conflict:
                continue

    def tier(self, shard: Shard) -> int:
        """0 for shards of the target size, and k for those that k more merges of FAN bring there."""
        return max(0, math.ceil(math.log(self.target / max(shard.bytes, 1), self.fan) - 1e-9))

    def runs(self, shards: list[Shard]) -> list[list[Shard]]:
        """Which shards to merge: of each tier groups of FAN or more that stay within the target size."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            tiers.setdefault(self.tier(s), []).append(s)
        out = []
        for tier, members in tiers.items():
            if not tier:
                continue
            run, size = [], 0
            for s in sorted(members, key=lambda s: (s.bytes, s.path)):
                if run and size + s.bytes > self.target:
                    if len(run) > 1:
                        out.append(run)
                    run, size = [], 0
                run.append(s)
                size += s.bytes
            if len(run) >= self.fan or len(run) > 1 and size >= self.target / self.fan:
                out.append(run)
        return out

    def compact_round(self) -> bool:
        """Merge the runs of the latest version and commit; whether there were any."""
        base = self.version()
        shards, schema = self.manifest(base)
        runs = self.runs(shards)
        merged: list[Shard] = []
        for lo in range(0, len(runs), RUNS):
            parts = [self._read(run, schema).coalesce(1) for run in runs[lo : lo + RUNS]]
            folder = f"{self.folder}/shards/{uuid.uuid4().hex}"
            reduce(DataFrame.unionAll, parts).write.parquet(folder)
            merged += self._written(folder, schema)
        if not runs:
            return False
        gone = {s.path for run in runs for s in run}
        self.commit(base, [s for s in shards if s.path not in gone] + merged, schema)
        return True

    def compact(self) -> int:
        """Merge until no tier has a run; gives the version."""
        while self.compact_round():
            pass
        return self.version()

    def _read(self, shards: list[Shard], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{s.path}" for s in shards))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the latest by default."""
        shards, schema = self.manifest(version)
        if schema is None:
            raise ValueError("the store has no version yet")
        return self._read(shards, schema) if shards else self.spark.createDataFrame([], schema)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents appended as small shards, compacted, and read back: each row's id and the digest of its text."""
    store = ShardStore(spark, new_path(spark, "shards"))
    store.append(load(spark, sf_dir, "documents"))
    store.compact()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


ORACLE = """
SELECT doc_id, lang, source, n_chars, octet_length(encode(text))::BIGINT AS n_bytes, sha256(text) AS text_sha256 FROM documents
"""
