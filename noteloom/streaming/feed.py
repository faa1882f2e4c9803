"""Incremental indexing as a stream, and windowed counts over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteloom import tables
from noteloom.store import BUCKETS, Change, Store


def changes(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 64, name: str = "*.parquet") -> DataFrame:
    """The Parquet files of a folder (by name pattern) as a stream of changes."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", name).parquet(path)


def last_change(batch: DataFrame, key: str = "note_id", time: str = "changed_at") -> DataFrame:
    """Of several changes of one note in a batch, the last; of equal times, the one with the largest hash, so that a rerun takes the same."""
    hashed = [f.name for f in batch.schema.fields if "map<" not in f.dataType.simpleString()]
    w = Window.partitionBy(key).orderBy(F.desc(time), F.xxhash64(*hashed).desc())
    return batch.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def deleted(before: DataFrame, listed: DataFrame, key: str = "note_id") -> DataFrame:
    """Keys known before that a listing no longer has: file streams do not report deletions."""
    return before.select(key).distinct().join(listed.select(key), key, "left_anti")


def matching(batch: DataFrame, extensions: tuple[str, ...] = (".md",), path: str = "rel") -> DataFrame:
    """Changes of files with these extensions, none of whose folders (nor the file itself) begins with a dot."""
    at = F.col(path)
    suffix = F.lower(F.regexp_extract(at, r"(\.[^./]*)$", 1))
    return batch.filter(suffix.isin([e.lower() for e in extensions]) & ~at.rlike(r"(^|/)\.[^/]"))


def upsert_sink(table: str, key: str = "note_id", time: str = "changed_at", gone: str | None = None, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each batch becomes one version of the table, of which only the buckets with changed keys are written.

    ``gone`` names a boolean column that marks deletions: a key whose last change
    is one leaves the table.  A batch that is run again finds its version complete; ``current`` reads the
    newest complete version, and all but two are dropped.
    """

    def run(batch: DataFrame, number: int) -> None:
        fresh = tables.written(last_change(batch, key, time), "fresh")
        here = fresh if gone is None else fresh.filter(~F.coalesce(F.col(gone), F.lit(False)))
        Store(batch.sparkSession, table, {"rows": key}, buckets).commit({"rows": Change(fresh.select(F.col(key).alias("key")), here)}, number)
        tables.discard(fresh)

    return run


def current(spark: SparkSession, table: str, version: int | None = None) -> DataFrame | None:
    """The newest complete version (or a given one) of an upserted table; none before the first."""
    store = Store(spark, table, {"rows": ""})
    return store.read("rows", version=version) if store.versions() else None


def upsert_stream(stream: DataFrame, table: str, checkpoint: str, key: str = "note_id", time: str = "changed_at", gone: str | None = None) -> None:
    """Runs through all that is there, then stops."""
    q = stream.writeStream.foreachBatch(upsert_sink(table, key, time, gone)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type; works on streams (with a watermark) and tables alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Counts per user and session."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """One event of each key (of a stream: of those no further apart than ``late``, which bounds what is remembered)."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)
