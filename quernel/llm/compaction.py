"""Sharding by size-tiered compaction, on DataFrames alone.

A store is a folder of immutable shards (Parquet) and a chain of manifests. Arrivals are appended as they come, each as
a run of small shards. Runs of similar size are merged: a run's tier is the whole part of the logarithm, to the base
``fan_in``, of its bytes over ``base_bytes``; whenever a tier has ``fan_in`` runs, these become one run of
files of about ``target_bytes``, one tier up or so. Merges are planned ahead over all tiers, so runs that would be merged again at
once are written once, and the merges of a version run side by side. Each row is rewritten about once for each tier at most.

A manifest ``v%012d.json`` lists the runs of a version: name, tier, bytes, rows' schema, files. It is written under a name of its
own and renamed, which fails if the version exists already, so a reader sees a whole version or the one before
it. Of two writers one wins; the other makes its change again on the winner's version. (The store must rename atomically, as HDFS
does; where it does not, writers need a lock of their own.) All arrivals of a call come in one version. Shards that no
manifest lists (of lost tasks or failed jobs) are never read. Nothing is deleted by merging: readers of older versions go
on. ``vacuum`` deletes what only versions list that are older than an age and not among the last ones.

Rows move from file to file in Spark's own readers and writers; the driver handles file names and sizes alone.

Defined cases: nulls, empty and long texts, repeated rows and columns of any name are kept as they are; a null number of an arrival
is an arrival of its own; an empty arrival commits a version without a new run; a store without runs reads as an empty
table. An arrival may bring new columns, which
are null in the rows of others, and lack old ones; one whose columns have another type, or names that differ
in case alone, is refused before anything is written.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_BYTES = 1 << 20
TARGET_BYTES = 128 << 20
FAN_IN = 4
#: How often a change is made again after another writer was first.
TRIES = 20
#: Merges that run side by side.
SIDE_BY_SIDE = 4
#: Seconds for which versions are kept, whatever came after them.
AGE = 24 * 3600


class Beaten(RuntimeError):
    """Another writer committed the version first."""


def merged_schema(old: dict | None, new: T.StructType) -> dict:
    """The columns of the store and those that an arrival adds; raises if a column of both differs in type."""
    fields = T.StructType.fromJson(old).fields if old else []
    held = {f.name.lower(): f for f in fields} | {f.name: f for f in fields}
    added = []
    for f in new:
        known = held.get(f.name) or held.get(f.name.lower())
        if known is None:
            added.append(f)
        elif known.name != f.name or known.dataType.simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name} {f.dataType.simpleString()} does not fit the store's {known.name} {known.dataType.simpleString()}")
    return json.loads(T.StructType([*fields, *added]).json())


class ShardStore:
    """A store in a folder that all machines see."""

    def __init__(self, spark: SparkSession, folder: str, fan_in: int = FAN_IN, base_bytes: int = BASE_BYTES, target_bytes: int = TARGET_BYTES):
        self.spark, self.folder = spark, folder
        self.fan_in, self.base_bytes, self.target_bytes = fan_in, base_bytes, target_bytes
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- Manifests

    def versions(self) -> list[int]:
        where = self.path(f"{self.folder}/manifests")
        if not self.fs.exists(where):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(where)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The given or the last version; version 0 is the empty store."""
        version = (self.versions() or [0])[-1] if version is None else version
        if version == 0:
            return {"version": 0, "schema": None, "runs": []}
        stream = self.fs.open(self.path(f"{self.folder}/manifests/v{version:012d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def commit(self, manifest: dict) -> dict:
        """Write the version after the one that the manifest was made from; raises if another writer was first."""
        after = manifest | {"version": manifest["version"] + 1}
        folder = f"{self.folder}/manifests"
        self.fs.mkdirs(self.path(folder))
        draft, final = self.path(f"{folder}/.draft-{uuid.uuid4().hex}"), self.path(f"{folder}/v{after['version']:012d}.json")
        out = self.fs.create(draft, False)
        out.write(bytearray(json.dumps(after).encode()))
        out.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        plain = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        plain[0] = hadoop.Options.Rename.NONE
        try:
            hadoop.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, plain)
        except Py4JJavaError as error:
            self.fs.delete(draft, False)
            if self.fs.exists(final):
                raise Beaten(f"version {after['version']} was committed by another writer") from error
            raise
        return after

    def update(self, change: Callable[[dict], dict | None]) -> dict:
        """Commit a change of the last version, made again whenever another writer was first; None changes nothing."""
        for attempt in range(TRIES):
            manifest = self.manifest()
            after = change(manifest)
            if after is None:
                return manifest
            try:
                return self.commit(after)
            except Beaten:
                if attempt == TRIES - 1:
                    raise
                time.sleep(0.05 * (attempt + 1))
        raise AssertionError

    # ---- Runs

    def tier(self, size: int) -> int:
        return max(0, int(math.log(max(size, 1) / self.base_bytes, self.fan_in))) if size > self.base_bytes else 0

    def run(self, folder: str) -> dict | None:
        """The run that a job wrote to a folder; None if it has no rows to speak of."""
        files = [(f.getPath().toString(), f.getLen()) for f in self.fs.listStatus(self.path(folder)) if f.getPath().getName().endswith(".parquet")]
        size = sum(n for _, n in files)
        return {"name": folder, "tier": self.tier(size), "bytes": size, "files": [f for f, _ in sorted(files)]} if files else None

    def fresh(self) -> str:
        return f"{self.folder}/shards/{uuid.uuid4().hex}"

    def append(self, rows: DataFrame) -> dict:
        """Add one arrival as a run of its own."""
        merged_schema(self.manifest()["schema"], rows.schema)
        folder = self.fresh()
        rows.write.parquet(folder)
        return self.add([folder], rows.schema)

    def append_all(self, rows: DataFrame, arrival: Column) -> dict:
        """Add arrivals, told apart by a number, each as a run of its own. They are written in one job and come in one version."""
        merged_schema(self.manifest()["schema"], rows.schema)
        folder, number = self.fresh(), f"arrival_{uuid.uuid4().hex}"
        rows.withColumn(number, arrival).write.partitionBy(number).parquet(folder)
        found = [f.getPath().toString() for f in self.fs.listStatus(self.path(folder)) if f.isDirectory() and f.getPath().getName().startswith(number)]
        return self.add(sorted(found), rows.schema)

    def add(self, folders: list[str], schema: T.StructType) -> dict:
        runs = [run for folder in folders if (run := self.run(folder))]
        self.update(lambda m: m | {"schema": merged_schema(m["schema"], schema), "runs": m["runs"] + runs})
        return self.compact()

    def plan(self, runs: list[dict]) -> list[dict]:
        """The merges that leave no tier with ``fan_in`` runs: of each, the runs that go in (``parts``), their bytes and the tier."""
        tiers: dict[int, list[dict]] = {}
        for run in runs:
            tiers.setdefault(run["tier"], []).append(run)
        while full := sorted(t for t, held in tiers.items() if len(held) >= self.fan_in):
            low = full[0]
            merged, tiers[low] = tiers[low][: self.fan_in], tiers[low][self.fan_in :]
            size = sum(r["bytes"] for r in merged)
            # a merged run counts for a tier above its parts, even where compression makes it smaller
            whole = {"parts": [p for r in merged for p in r.get("parts", [r])], "bytes": size, "tier": max(self.tier(size), low + 1)}
            tiers.setdefault(whole["tier"], []).append(whole)
        return [r for held in tiers.values() for r in held if "parts" in r]

    def merge(self, merge: dict, schema: dict | None) -> dict | None:
        """Write one merge. No shuffle: whole splits are put together to files of about the target size."""
        folder = self.fresh()
        rows = self.rows([f for r in merge["parts"] for f in r["files"]], schema)
        rows.coalesce(max(1, -(-merge["bytes"] // self.target_bytes))).write.parquet(folder)
        run = self.run(folder)
        return run and run | {"tier": max(run["tier"], merge["tier"])}

    def compact(self) -> dict:
        """Merge until no tier has ``fan_in`` runs. A merge of runs that another writer has merged meanwhile is dropped."""
        while True:
            manifest = self.manifest()
            merges = self.plan(manifest["runs"])
            if not merges:
                return manifest
            with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
                made = list(pool.map(lambda merge: self.merge(merge, manifest["schema"]), merges))

            def change(last: dict, merges=merges, made=made) -> dict | None:
                there = {r["name"] for r in last["runs"]}
                valid = [(names, run) for merge, run in zip(merges, made) if (names := {p["name"] for p in merge["parts"]}) <= there]
                gone = set().union(*(names for names, _ in valid))
                return last | {"runs": [r for r in last["runs"] if r["name"] not in gone] + [run for _, run in valid if run]} if valid else None

            self.update(change)

    def vacuum(self, keep: int = 1, age: float = AGE) -> None:
        """Delete manifests that are older than ``age`` seconds and not among the last ``keep``, and the shards that only these list."""
        versions = self.versions()
        until = 1000 * (time.time() - age)
        made = {v: self.fs.getFileStatus(self.path(f"{self.folder}/manifests/v{v:012d}.json")).getModificationTime() for v in versions}
        # a version is left when the next one is made
        old = [v for v, after in zip(versions, versions[1:]) if made[after] < until and v not in versions[-keep:]]
        wanted = {r["name"] for v in versions if v not in old for r in self.manifest(v)["runs"]}
        for name in {r["name"] for v in old for r in self.manifest(v)["runs"]} - wanted:
            self.fs.delete(self.path(name), True)
        for v in old:
            self.fs.delete(self.path(f"{self.folder}/manifests/v{v:012d}.json"), False)

    def rows(self, files: list[str], schema: dict | None) -> DataFrame:
        known = T.StructType.fromJson(schema) if schema else T.StructType()
        if not files:
            return self.spark.createDataFrame([], known)
        return self.spark.read.schema(known).parquet(*files)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        manifest = self.manifest(version)
        return self.rows([f for r in manifest["runs"] for f in r["files"]], manifest["schema"])

    def layout(self, version: int | None = None) -> list[tuple[int, int, int]]:
        """Tier, bytes and number of files of each run."""
        return [(r["tier"], r["bytes"], len(r["files"])) for r in self.manifest(version)["runs"]]
