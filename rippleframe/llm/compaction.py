"""Size-tiered compaction of immutable Parquet shards under a versioned manifest.

A store is a folder in the shared file system.  Every arrival is appended as small shard files that are never changed.
Compaction puts shards of similar size (one tier spans a factor of ``fan``) into runs and merges each run of enough
shards into one file of about the target size; nothing is moved that is not merged.  What a reader sees is one manifest
version; a version is written beside its place and renamed into it, which fails if another writer was first.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import new_path, table, write_once

#: The query's sizes: merged files of this many bytes, runs of at least so many shards, tiers a factor of FAN apart.
TARGET_BYTES, MIN_RUN, FAN = 64 << 20, 4, 4
#: Appends of the query.
ARRIVALS = 4
#: Shards that one round merges at most (its list goes to every task); what is left waits for the next round.
ROUND_SHARDS = 10_000


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int


def _place(rows: DataFrame):
    """Folder and name of the file that a row of ``rows`` was read from, whatever its columns are called."""
    parts = F.split(rows.metadataColumn("_metadata")["file_path"], "/")
    return F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))


class ManifestConflict(RuntimeError):
    """Another writer has committed the version first."""


class ShardStore:
    """Append, compact and read one store."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._fs_path(self._path).getFileSystem(conf)
        self._context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._fs.mkdirs(self._fs_path(f"{self._path}/manifests"))

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._fs_path(f"{self._path}/manifests"))]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._fs.open(self._fs_path(self._name(version)))
        try:
            text = bytes(self._spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
        return [Shard(**s) for s in json.loads(text)["shards"]]

    def _name(self, version: int) -> str:
        return f"{self._path}/manifests/v{version:010d}.json"

    def _commit(self, shards: list[Shard], based_on: int) -> int:
        """Atomically publish the version after ``based_on``."""
        text = json.dumps({"version": based_on + 1, "shards": [vars(s) for s in sorted(shards, key=lambda s: s.path)]})
        beside = self._fs_path(f"{self._path}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(beside, False)
        out.write(bytearray(text.encode()))
        out.close()
        none = self._spark.sparkContext._gateway.new_array(self._spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(beside, self._fs_path(self._name(based_on + 1)), none)
        except Exception as error:
            self._fs.delete(beside, False)
            raise ManifestConflict(f"version {based_on + 1} is already there") from error
        return based_on + 1

    def _written(self, folder: str) -> list[Shard]:
        """The files of a finished write, with their sizes and rows."""
        files = []
        walk = self._fs.listFiles(self._fs_path(folder), True)
        while walk.hasNext():
            s = walk.next()
            if s.getPath().getName().endswith(".parquet"):
                files.append((s.getPath().toString(), s.getLen()))
        if not files:
            return []
        # files of several runs may share a name: the folder tells them apart
        written = self._spark.read.parquet(folder)
        count = written.groupBy(_place(written).alias("f")).count()
        rows = {r["f"]: r["count"] for r in count.collect()}  # a row for each shard
        return [Shard(p, n, rows.get("/".join(p.rsplit("/", 2)[1:]), 0)) for p, n in files]

    def append(self, arrival: DataFrame) -> int:
        """Write an arrival as new shards, one for each of its partitions, and commit them.

        Rows are stored as they are: nulls, repeated rows and columns of any name.  An empty arrival adds no shard.
        """
        version = self.version()
        folder = f"{self._path}/data/{uuid.uuid4().hex}"
        arrival.write.option("compression", "zstd").parquet(folder)
        return self._commit(self.shards(version) + [s for s in self._written(folder) if s.rows], version)

    def plan(self, shards: list[Shard], target: int, min_run: int, fan: int) -> list[list[Shard]]:
        """Runs to merge: shards of one tier, smallest first, packed up to the target.

        Shards of half the target or more rest, and so do tiers with fewer than ``min_run`` shards, until others of
        their size arrive.
        """
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < target / 2:
                tiers.setdefault(int(math.log(max(s.bytes, 1), fan)), []).append(s)
        runs = []
        for tier in sorted(tiers):
            run, size = [], 0
            for s in sorted(tiers[tier], key=lambda s: (s.bytes, s.path)):
                if run and size + s.bytes > target:
                    runs.append(run)
                    run, size = [], 0
                run.append(s)
                size += s.bytes
            if len(run) >= min_run:
                runs.append(run)
        return [r for r in runs if len(r) > 1]

    def compact(self, target: int = TARGET_BYTES, min_run: int = MIN_RUN, fan: int = FAN) -> int:
        """Merge until no tier has a run left; every round is one job and one version, every run one task and one file.

        A run has at most the target's bytes, so a task can write it.  A store without shards stays as it is.
        """
        while planned := self.plan(shards := self.shards(version := self.version()), target, min_run, fan):
            runs: list[list[Shard]] = []
            for r in planned:
                if not runs or sum(map(len, runs)) + len(r) <= ROUND_SHARDS:
                    runs.append(r)
            place = [("/".join(s.path.rsplit("/", 2)[1:]), k) for k, run in enumerate(runs) for s in run]
            mark = uuid.uuid4().hex  # names that no column of the store has
            groups = self._spark.createDataFrame(place, f"shard_{mark} string, run_{mark} int")
            source = self._spark.read.parquet(*(s.path for run in runs for s in run))
            named = source.withColumn(f"shard_{mark}", _place(source)).join(F.broadcast(groups), f"shard_{mark}")
            merged = named.repartitionById(len(runs), F.col(f"run_{mark}")).drop(f"shard_{mark}", f"run_{mark}")
            folder = f"{self._path}/data/{uuid.uuid4().hex}"
            write_once(self._spark, lambda merged=merged, folder=folder: merged.write.option("compression", "zstd").parquet(folder))
            gone = {s.path for run in runs for s in run}
            made = self._written(folder)
            if sum(s.rows for s in made) != sum(s.rows for run in runs for s in run):
                raise RuntimeError("a merge has not kept all rows")
            self._commit([s for s in shards if s.path not in gone] + made, version)
        return self.version()

    def vacuum(self) -> int:
        """Delete shard files that the newest version does not name; their number."""
        live = {s.path for s in self.shards()}
        walk = self._fs.listFiles(self._fs_path(f"{self._path}/data"), True)
        dead = []
        while walk.hasNext():
            p = walk.next().getPath()
            if p.getName().endswith(".parquet") and p.toString() not in live:
                dead.append(p)
        for p in dead:
            self._fs.delete(p, False)
        return len(dead)

    def read(self, schema, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        paths = [s.path for s in self.shards(version)]
        return self._spark.read.schema(schema).parquet(*paths) if paths else self._spark.createDataFrame([], schema)


def op2_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append all documents in a few arrivals, compact them, and return where every document is.

    One row for every document of the newest version: doc_id, n_bytes of its text, shard, shard_rows, shard_bytes and
    version.  Null ids and texts are stored as they are (null n_bytes); repeated rows stay repeated.
    """
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, new_path(spark, "shards"))
    for k in range(ARRIVALS):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)) == k))
    version = store.compact()
    store.vacuum()
    shards = [("/".join(s.path.rsplit("/", 2)[1:]), s.rows, s.bytes) for s in store.shards(version)]
    sizes = spark.createDataFrame(shards, "shard string, shard_rows long, shard_bytes long")
    stored = store.read(docs.schema, version)
    rows = stored.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), _place(stored).alias("shard")) if shards else stored.select("doc_id", F.lit(None).cast("long").alias("n_bytes"), F.lit("").alias("shard"))
    return rows.join(sizes, "shard", "left").select("doc_id", "n_bytes", "shard", "shard_rows", "shard_bytes", F.lit(version).cast("long").alias("version"))
