"""Operator 6: size-tiered compaction of shards under a versioned manifest.

Arrivals are appended as small immutable Parquet shards. A manifest lists the shards of one version. A shard's tier is how
many times ``FAN`` it is smaller than the target; when a tier holds ``FAN`` shards (a run of similar sizes), they are merged into
files of about the target's size or, if they are too little, one of the next tier, and a version commits the exchange. Old
shards stay for readers of old versions until ``vacuum``.

Every change names the version it is based on. A writer claims the next version by creating the claim file of its first
attempt, which one writer alone can, and writes its draft of the manifest. Renaming the claim decides: to ``won`` by its writer, who then
renames the draft into place, or to ``void`` by another writer that finds the claim older than ``lease`` seconds; a file can be renamed
once, so a version has one manifest, and a slow writer learns that it was voided. A writer that dies between its two renames has won,
and whoever comes next puts its draft into place. Who finds the version taken looks at the newest manifest again and makes
its change on that one: an append adds its shards, a merge is dropped if a shard of its run has gone (another compactor was
faster). A manifest that is there counts, whatever claims come later; readers see a version whole or not at all.

This needs a file system whose exclusive creation and renames are atomic (HDFS, POSIX); plain object stores are not. Claims' ages are taken
from its clock alone.

Rows are only copied, partition by partition, without a shuffle; each row is written about log_FAN(target / arrival) times.
The driver handles file names and sizes, never rows.

Defined cases: rows are kept as they are, repeated ones, nulls and all columns; an arrival without shards changes nothing; an
empty table is a manifest without rows and reads as an empty table; the columns that ``read`` adds get underscores in front
where the table has their names.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cindermap.llm.common import shared_dir, table

#: Bytes of a full shard, and how many shards of a tier are merged.
TARGET, FAN = 32 << 20, 4
#: Seconds after which a claim without a manifest counts as a dead writer's.
LEASE = 60.0
#: Seconds for which ``vacuum`` keeps shards that no manifest lists: their writers may be about to commit them.
ORPHANS = 86_400.0
#: What there can be of an attempt at a version.
NAME = re.compile(r"(\d+)\.(\d+)\.(claim|draft|won|void|json)")


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    merged: int  # how often its rows were merged


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores in front until no column has it."""
    lower = {t.lower() for t in taken}
    while name in lower:
        name = f"_{name}"
    return name


class Lake:
    """A table of shards in one folder of a file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, target: int = TARGET, fan: int = FAN, lease: float = LEASE):
        self.spark, self.folder, self.schema, self.target, self.fan, self.lease = spark, folder, schema, target, fan, lease
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{folder}/manifests"))
        #: Names of the columns that ``read`` adds.
        self.shard_column, self.merged_column = (free_name(n, schema.names) for n in ("shard_id", "merged"))

    def _attempts(self) -> dict[int, dict[int, set[str]]]:
        """For each version, its attempts and what there is of them."""
        found: dict[int, dict[int, set[str]]] = {}
        for status in self._fs.listStatus(self._path(f"{self.folder}/manifests")):
            if m := NAME.fullmatch(status.getPath().getName()):
                found.setdefault(int(m[1]), {}).setdefault(int(m[2]), set()).add(m[3])
        return found

    def _file(self, version: int, attempt: int, kind: str):
        return self._path(f"{self.folder}/manifests/{version:012d}.{attempt:04d}.{kind}")

    def versions(self) -> dict[int, int]:
        """The committed versions, and the attempt that counts for each."""
        return {v: min(own) for v, tries in self._attempts().items() if (own := [k for k, kinds in tries.items() if "json" in kinds])}

    def version(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> list[Shard]:
        known = self.versions()
        version = max(known, default=0) if version is None else version
        return self._read(version, known[version]) if version else []

    def _read(self, version: int, attempt: int) -> list[Shard]:
        stream = self._fs.open(self._file(version, attempt, "json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(**x) for x in json.loads(text)["shards"]]

    def _renamed(self, version: int, attempt: int, kind: str, to: str) -> bool:
        """Whether we renamed the file; False if another writer did."""
        try:
            return bool(self._fs.rename(self._file(version, attempt, kind), self._file(version, attempt, to)))
        except Py4JJavaError:
            if self._fs.exists(self._file(version, attempt, kind)):
                raise
            return False

    def _age(self, path) -> float:
        """Seconds since the file was written, by the file system's own clock."""
        probe = self._path(f"{self.folder}/manifests/.clock-{uuid.uuid4().hex}")
        self._fs.create(probe, True).close()
        now = self._fs.getFileStatus(probe).getModificationTime()
        self._fs.delete(probe, False)
        return (now - self._fs.getFileStatus(path).getModificationTime()) / 1000

    def _claim(self, version: int) -> int | None:
        """The number of our attempt at a version; None if it is committed or another writer is at it."""
        tries = self._attempts().get(version, {})
        last = max(tries, default=-1)
        if any("json" in kinds for kinds in tries.values()):
            return None
        if last >= 0 and "won" in tries[last]:
            self._renamed(version, last, "draft", "json")  # its writer died before this, or is just doing it
            return None
        if last >= 0 and "void" not in tries[last]:
            claim = self._file(version, last, "claim")
            try:
                if self._age(claim) < self.lease:
                    return None
            except Py4JJavaError:
                if self._fs.exists(claim):
                    raise
                return None
            if not self._renamed(version, last, "claim", "void"):
                return None
        return last + 1 if self._fs.createNewFile(self._file(version, last + 1, "claim")) else None

    def _publish(self, version: int, attempt: int, shards: list[Shard]) -> bool:
        """Commit an attempt that we claimed; False if it was voided meanwhile."""
        out = self._fs.create(self._file(version, attempt, "draft"), True)
        try:
            out.write(bytearray(json.dumps({"version": version, "shards": [asdict(s) for s in shards]}).encode()))
        finally:
            out.close()
        if not self._renamed(version, attempt, "claim", "won"):
            return False
        if not self._renamed(version, attempt, "draft", "json") and not self._fs.exists(self._file(version, attempt, "json")):
            raise OSError(f"cannot write the manifest of version {version}")
        return True

    def update(self, change: Callable[[list[Shard]], list[Shard] | None]) -> bool:
        """Commit ``change(newest manifest)``; on the then newest one if another writer is faster. False if it gives None: nothing to do (any more)."""
        pause = 0.05
        while True:
            base = self.version()
            shards = change(self.manifest(base))
            if shards is None:
                return False
            attempt = self._claim(base + 1)
            if attempt is None:
                time.sleep(pause)
                pause = min(2.0, pause * 1.5)
            elif base + 1 not in self.versions() and self._publish(base + 1, attempt, shards):
                return True

    def _new(self, merged: int) -> str:
        return f"{self.folder}/shards/m{merged}-{uuid.uuid4().hex}"

    def _written(self, folder: str, merged: int) -> list[Shard]:
        found = [] if not self._fs.exists(self._path(folder)) else self._fs.listStatus(self._path(folder))
        return sorted((Shard(str(s.getPath().toString()), int(s.getLen()), merged) for s in found if s.getPath().getName().endswith(".parquet")), key=lambda s: s.path)

    def _add(self, new: list[Shard]) -> None:
        names = {s.path for s in new}
        self.update(lambda now: None if names <= {s.path for s in now} else now + new)

    def append(self, rows: DataFrame) -> None:
        """One arrival: its partitions become shards, without a shuffle."""
        folder = self._new(0)
        rows.write.option("compression", "snappy").parquet(folder)
        self._add(self._written(folder, 0))

    def append_dealt(self, rows: DataFrame, arrival: str) -> None:
        """Arrivals 0, 1, 2... of ``rows`` by the column ``arrival``, written in one pass and committed one by one."""
        folder = self._new(0)
        rows.write.option("compression", "snappy").partitionBy(arrival).parquet(folder)
        dirs = [s.getPath() for s in self._fs.listStatus(self._path(folder)) if s.isDirectory()]
        for d in sorted(dirs, key=lambda p: int(p.getName().rpartition("=")[2])):
            self._add(self._written(d.toString(), 0))

    def tier(self, shard: Shard) -> int:
        """0: at least half of the target; else how many times ``fan`` it is smaller."""
        tier, size = 0, shard.bytes
        while 2 * size < self.target and tier < 20:
            size *= self.fan
            tier += 1
        return tier

    def due(self) -> list[Shard]:
        """The shards of the smallest-sized tier that has ``fan`` of them; none: nothing is due."""
        tiers: dict[int, list[Shard]] = {}
        for s in self.manifest():
            tiers.setdefault(self.tier(s), []).append(s)
        return next((tiers[t] for t in sorted(tiers, reverse=True) if t and len(tiers[t]) >= self.fan), [])

    def merge(self, run: list[Shard]) -> bool:
        """Write the run's rows anew and commit the exchange; False, and nothing written stays, if a shard of the run has gone meanwhile."""
        merged = 1 + max(s.merged for s in run)
        folder = self._new(merged)
        rows = self.spark.read.schema(self.schema).parquet(*(s.path for s in run))
        rows.coalesce(max(1, sum(s.bytes for s in run) // self.target)).write.option("compression", "snappy").parquet(folder)
        new, gone = self._written(folder, merged), {s.path for s in run}
        done = {s.path for s in new}

        def exchange(now: list[Shard]) -> list[Shard] | None:
            names = {s.path for s in now}
            return [s for s in now if s.path not in gone] + new if gone <= names else None

        if self.update(exchange) or done <= {s.path for s in self.manifest()}:
            return True
        self._fs.delete(self._path(folder), True)
        return False

    def compact(self) -> int:
        """Merge until no tier is due; returns the number of merges committed here."""
        merges = 0
        while run := self.due():
            merges += self.merge(run)
        return merges

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with a number that names their shard and how often they were merged, both from the shard's path."""
        shards = self.manifest(version)
        if not shards:
            return self.spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField(self.shard_column, T.LongType()), T.StructField(self.merged_column, T.IntegerType())]))
        name = F.element_at(F.split("_metadata.file_path", "/shards/"), -1)
        rows = self.spark.read.schema(self.schema).parquet(*(s.path for s in shards))
        return rows.select("*", F.xxhash64(name).alias(self.shard_column), F.regexp_extract(name, "^m([0-9]+)-", 1).cast("int").alias(self.merged_column))

    def vacuum(self, orphans: float = ORPHANS) -> int:
        """Delete the shards that the newest version does not list, and all manifests before it; readers of older versions must have ended.
        Shards that no manifest lists are dead writers' if they are older than ``orphans`` seconds. Returns the number of shards deleted."""
        known = self.versions()
        newest = max(known, default=0)
        used = {s.path for s in self.manifest(newest)}
        gone = {s.path for v in known if v != newest for s in self.manifest(v)} - used
        top = self._path(f"{self.folder}/shards")
        walk = self._fs.listFiles(top, True) if self._fs.exists(top) else None
        while walk is not None and walk.hasNext():
            path = walk.next().getPath()
            name = str(path.toString())
            if name.endswith(".parquet") and name not in used | gone and self._age(path) > orphans:
                gone.add(name)
        deleted = sum(bool(self._fs.delete(self._path(p), False)) for p in sorted(gone))
        for version, tries in self._attempts().items():
            if version < newest:
                for attempt, kinds in tries.items():
                    for kind in kinds:
                        self._fs.delete(self._file(version, attempt, kind), False)
        return deleted


def op6_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in eight portions of doc_id; returns where each row stands after compaction, and its text's check sum."""
    docs = table(spark, sf_dir, "documents")
    lake = Lake(spark, shared_dir(spark, "lake"), docs.schema)
    arrival = free_name("arrival", docs.columns)
    lake.append_dealt(docs.withColumn(arrival, F.coalesce(F.pmod(F.col("doc_id"), F.lit(8)), F.lit(0)).cast("int")), arrival)
    lake.compact()
    placed = lake.read().select("doc_id", F.col(lake.shard_column).alias("shard_id"), F.col(lake.merged_column).alias("merged"), "text")
    return placed.select("doc_id", "shard_id", "merged", F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("text_crc32"), F.octet_length("text").alias("text_bytes"))
