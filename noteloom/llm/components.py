"""Connected components of an edge table by alternating star contractions.

Large-star joins every larger neighbour of a node to the least of its
neighbourhood, small-star every smaller one; repeated, each component becomes a
star around its least node.  Every round is two aggregations with map-side
combination and two joins over the edges, written to the shared folder; nothing
but two numbers reaches the driver.  Least neighbours are written before they
are joined, so that both sides are plain exchanges and the rows of a star's
centre can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import discard, written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
    moved = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    # written, because the small star reads it twice
    out = written(moved.filter("a <> b").distinct(), "large")
    discard(least)
    return out


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = written(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = written(moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "edges")
    discard(least)
    return out


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long) but the roots; root is the least node reachable.

    Self-loops and repeated edges change nothing; no edges give no rows.
    """
    edges = written(edges.filter("a <> b").distinct(), "edges")
    state = _state(edges)
    while state[0]:
        large = _large(edges)
        discard(edges)
        edges = _small(large)
        discard(large)
        after = _state(edges)
        if after == state:
            break
        state = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
