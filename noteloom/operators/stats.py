"""Summaries: classes of notes, taxonomy coverage, evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_distribution(classed: DataFrame, column: str = "para_type") -> DataFrame:
    """(class, n, percent) of the classified rows."""
    n = classed.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))  # a row per class


def taxonomy(notes: DataFrame) -> DataFrame:
    """One row over notes (para_type, tags, path): totals and what is left to classify."""
    return notes.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(F.col("para_type").isNotNull() | (F.size("tags") > 0), 1)).alias("with_metadata"),
        F.count("para_type").alias("with_type"),
        F.count(F.when(F.size("tags") > 0, 1)).alias("with_tags"),
        (F.count(F.lit(1)) - F.count("para_type")).alias("remaining"),
    )


def top_folders(notes: DataFrame, n: int = 10) -> DataFrame:
    """(folder, n): first path segments, most frequent first."""
    return notes.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("folder")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "folder").limit(n)


def rule_class(path: Column, tags: Column) -> Column:
    """Class by rule where no model is given: a para tag, else a folder name, else resource."""
    tagged = F.regexp_extract(F.array_join(tags, " "), r"(?:^|\s)para/(project|area|resource|archive)", 1)
    placed = F.regexp_extract(F.lower(path), r"(?:^|/)(?:\d+\s*)?(project|area|resource|archive)s?(?:/|$)", 1)
    return F.coalesce(F.nullif(tagged, F.lit("")), F.nullif(placed, F.lit("")), F.lit("resource"))


def eval_summary(runs: DataFrame) -> DataFrame:
    """Per operation: runs, mean latency, results and relevance, strategies used, success rate."""
    return runs.groupBy("operation").agg(
        F.count(F.lit(1)).alias("runs"),
        F.round(F.avg("latency"), 6).alias("avg_latency"),
        F.round(F.avg("results"), 6).alias("avg_results"),
        F.round(F.avg("relevance"), 6).alias("avg_relevance"),
        F.countDistinct("strategy").alias("strategies"),
        F.round(F.avg(F.col("ok").cast("double")), 6).alias("success_rate"),
    )
