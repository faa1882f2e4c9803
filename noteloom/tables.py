"""Tables in the folder that all executors share, and versioned ones that readers never see half written."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, a temporary one, but only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/noteloom-{os.getuid()}"


def file_system(spark: SparkSession, path: str) -> tuple:
    """(path, file system) as the JVM's objects."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def dropped(spark: SparkSession, path: str) -> None:
    at, fs = file_system(spark, path)
    fs.delete(at, True)


def _drop_quietly(spark: SparkSession, path: str) -> None:
    try:
        dropped(spark, path)
    except Exception:  # the session may be gone already; nothing else depends on the files
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there goes when the driver's Python ends."""
    path = f"{shared_folder(spark)}/noteloom-tables/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop_quietly, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: its lineage ends there.

    The files survive lost executors and go when the driver's Python ends.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Drop the files of tables that ``written`` made and nothing reads any more."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/noteloom-tables/" in path:
                dropped(df.sparkSession, path)


DONE = "_SUCCESS"


def versions(spark: SparkSession, root: str, below: int | None = None) -> list[int]:
    """Complete versions (folders v{n} with a mark of success) under ``root``, ascending."""
    at, fs = file_system(spark, root)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    done = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(file_system(spark, f"{root}/{n}/{DONE}")[0])]
    return sorted(n for n in done if below is None or n < below)


def completed(spark: SparkSession, path: str) -> None:
    """Mark a version whose tables are all written."""
    at, fs = file_system(spark, f"{path}/{DONE}")
    fs.create(at, True).close()


def expired(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Drop all but the newest complete versions; readers of the one before the newest can finish."""
    for n in versions(spark, root)[:-keep]:
        dropped(spark, f"{root}/v{n}")
