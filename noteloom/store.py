"""Several tables as one store: hash buckets written copy-on-write, and versions that switch all tables at once.

A table's rows lie in buckets by a hash of its key.  A commit rewrites only the
buckets whose keys it touches, into new folders, and then writes a manifest that
names, for each bucket of each table, the folder to read.  Readers take the newest
manifest that is marked complete: a commit that dies half way leaves some folders
that nobody reads, and the version before as it was.  The manifest is of the
size of the bucket numbers, not of the data.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteloom import tables

#: Buckets of a table; a commit rewrites at least one, so they are to hold some hundred MB at most.
BUCKETS = 64


@dataclass(frozen=True)
class Change:
    """Of one table: keys (key) whose rows go, and rows that come; the keys of rows that come go too."""

    gone: DataFrame | None = None
    fresh: DataFrame | None = None


class Store:
    """Tables below ``root``; ``keys`` names for each the SQL expression that its rows are dealt by.

    One writer at a time; any number of readers.
    """

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, str], buckets: int = BUCKETS):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        return tables.versions(self.spark, self.root)

    def manifest(self, version: int | None = None, below: int | None = None) -> dict:
        """Of a version, by default the newest complete one (below a number): {table: {schema, files}}; {} where there is none."""
        done = tables.versions(self.spark, self.root, below)
        if version is None and not done:
            return {}
        return json.loads(self.spark.read.text(f"{self.root}/v{done[-1] if version is None else version}/manifest.json", wholetext=True).first()[0])

    def _of(self, name: str, manifest: dict, buckets: Iterable[int] | None = None) -> DataFrame:
        held = manifest[name]
        schema = T.StructType.fromJson(held["schema"])
        wanted = held["files"] if buckets is None else {str(b): held["files"][str(b)] for b in buckets if str(b) in held["files"]}
        paths = [f"{self.root}/{p}" for p in wanted.values()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, name: str, ids: list | None = None, version: int | None = None) -> DataFrame:
        """A table; with ``ids`` (a short list of keys) only the buckets that can hold them are read, and their rows returned."""
        manifest = self.manifest(version)
        if manifest.get(name, {}).get("schema") is None:
            raise FileNotFoundError(f"no complete version of {name} in {self.root}")
        if ids is None:
            return self._of(name, manifest)
        asked = self.spark.createDataFrame([(str(i),) for i in ids], "id string")
        rows = self._of(name, manifest, {r.b for r in asked.select(self.bucket(F.col("id")).alias("b")).collect()})
        return rows.filter(F.expr(self.keys[name]).cast("string").isin([str(i) for i in ids]))

    def _written(self, name: str, change: Change, manifest: dict, commit: str) -> dict:
        """The table's entry in the next manifest, its touched buckets written."""
        key = F.expr(self.keys[name]).cast("string")
        held = manifest.get(name)
        held, own = held if held and held["schema"] else None, []
        if held is None and change.fresh is None:
            return {"schema": None, "files": {}}
        if held is None:  # the first rows: nothing to keep
            held, touched, rows = {"schema": json.loads(change.fresh.schema.json()), "files": {}}, [], change.fresh
        else:
            schema = T.StructType.fromJson(held["schema"])
            fresh = None if change.fresh is None else tables.written(change.fresh, "fresh")
            named = [d for d in (None if change.gone is None else change.gone.select(F.col("key").cast("string").alias("key")), None if fresh is None else fresh.select(key.alias("key"))) if d is not None]
            if not named:
                return held
            keys = tables.written((named[0] if len(named) == 1 else named[0].unionByName(named[1])).distinct(), "keys")
            own = [keys] if fresh is None else [keys, fresh]
            touched = sorted(r.b for r in keys.select(self.bucket(F.col("key")).alias("b")).distinct().collect())
            rows = self._of(name, {name: held}, touched).join(keys, key.eqNullSafe(keys["key"]), "left_anti").select(*[f"`{c}`" for c in schema.fieldNames()])
            if fresh is not None:
                rows = rows.unionByName(fresh.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields]))
        path = f"files/{name}/{commit}"
        # rebalanced by bucket: a large bucket may be written by several tasks
        rows.withColumn("__bucket", self.bucket(key)).hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(f"{self.root}/{path}")
        tables.discard(*own)
        at, fs = tables.file_system(self.spark, f"{self.root}/{path}")
        made = {n.rpartition("=")[2] for n in (s.getPath().getName() for s in fs.listStatus(at)) if n.startswith("__bucket=")}
        files = {b: p for b, p in held["files"].items() if int(b) not in touched} | {b: f"{path}/__bucket={b}" for b in sorted(made)}
        return {"schema": held["schema"], "files": files}

    def commit(self, changes: dict[str, Change], number: int | None = None, keep: int = 2) -> int:
        """All changes as one new version (``number``, by default the next) on top of the one below; a number that is complete already stays as it is, so a commit may be repeated."""
        done = self.versions()
        number = max(done, default=-1) + 1 if number is None else number
        if number in done:
            return number
        if done and number < done[0]:
            raise ValueError(f"version {number} is older than all that are kept")
        manifest = self.manifest(below=number)
        made = manifest | {name: self._written(name, c, manifest, f"{number}-{uuid.uuid4().hex[:8]}") for name, c in changes.items()}
        at, fs = tables.file_system(self.spark, f"{self.root}/v{number}/manifest.json")
        out = fs.create(at, True)
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        tables.completed(self.spark, f"{self.root}/v{number}")
        self.expire(keep)
        return number

    def expire(self, keep: int = 2) -> None:
        """Drop all but the newest complete versions, and the buckets that none of those names."""
        tables.expired(self.spark, self.root, keep)
        used = {p for v in self.versions() for t in self.manifest(v).values() for p in t["files"].values()}
        for name in self.keys:
            at, fs = tables.file_system(self.spark, f"{self.root}/files/{name}")
            for commit in fs.listStatus(at) if fs.exists(at) else ():
                folder = f"files/{name}/{commit.getPath().getName()}"
                inside = [s.getPath().getName() for s in fs.listStatus(commit.getPath())]
                stale = [b for b in inside if b.startswith("__bucket=") and f"{folder}/{b}" not in used]
                if len(stale) == sum(b.startswith("__bucket=") for b in inside):
                    tables.dropped(self.spark, f"{self.root}/{folder}")
                else:
                    for b in stale:
                        tables.dropped(self.spark, f"{self.root}/{folder}/{b}")
