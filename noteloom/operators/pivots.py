"""Exact nearest neighbours of many queries: vectors lie in cells around pivots, whole cells are skipped by the triangle inequality.

1. ``celled``: every vector goes to the nearest of a few pivots (rows with the
   least hashed ids), with its distance to it; one pass, no exchange.  Of each
   cell only its size and its least and greatest distance reach the driver.
2. A query's distance to a pivot bounds its distances to the cell's vectors from
   both sides.  The nearest cells that hold ``k`` vectors are searched first; the
   k-th distance found there then rules out every cell that cannot come nearer.
3. Queries meet cells as blocks: a block of a cell's rows and a block of the queries that ask for it, both of
   bounded size, so a task holds the two and keeps ``k`` rows a query.

Distances that decide are computed from differences, not from expanded squares,
and the bounds are taken wide enough for rounding; answers equal a full search, ties by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.tables import written

#: Pivots at most; rows and queries of a block; digits that distances are rounded to.
PIVOTS, ROW_BLOCK, QUERY_BLOCK, DIGITS = 512, 16_384, 1024, 9
#: Rows that meet the pivots at a time, queries that a block's rows meet at a time.
PLACE, MEET = 1024, 32
#: Slack of bounds, so that distances equal after rounding stay in.
SLACK, RELATIVE = 2e-4, 1e-9


@dataclass(frozen=True)
class Cells:
    """Vectors in cells: rows (chunk_id, embedding, cell, radius) in a written table, pivots, and per cell (size, least, greatest radius).

    ``origin``: rows of length zero under the cosine, which are as far from everything; those of least id are enough.
    """

    rows: DataFrame
    pivots: np.ndarray
    size: np.ndarray
    low: np.ndarray
    high: np.ndarray
    metric: str
    origin: DataFrame | None = None


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in column])


def _placed(x: np.ndarray, metric: str) -> np.ndarray:
    """Where vectors lie: as they are, or on the unit sphere, where the cosine distance is half the squared distance."""
    return x if metric == "l2" else x / np.sqrt((x * x).sum(axis=1))[:, None]


def _between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all a to all b, block by block of a."""
    out = np.empty((len(a), len(b)))
    for k in range(len(b)):
        d = a - b[k]
        out[:, k] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def _sliced(batches: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    """Batches cut to ``n`` rows at most: what is made of a row may be much wider than the row."""
    for pdf in batches:
        for k in range(0, len(pdf), n):
            yield pdf.iloc[k : k + n]


def _sized(vectors: DataFrame, where: Column | None) -> DataFrame:
    rows = (vectors if where is None else vectors.filter(where)).filter("embedding is not null")
    return rows.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"))


def _zero(c: str = "embedding") -> Column:
    return ~F.exists(c, lambda x: x != 0)


def celled(vectors: DataFrame, metric: str = "l2", where: Column | None = None, pivots: int | None = None) -> Cells:
    """Vectors (chunk_id, embedding) in cells; null vectors are left out."""
    rows = _sized(vectors, where)
    origin = None
    if metric == "cosine":
        origin = rows.filter(_zero()).select("chunk_id")
        rows = rows.filter(~_zero())
    n = rows.count()
    wanted = min(PIVOTS, max(1, int(n**0.5))) if pivots is None else pivots
    chosen = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(wanted).select("embedding").collect()
    at = _placed(np.array([r.embedding for r in chosen], dtype=float), metric) if chosen else np.zeros((0, 1))
    sent = rows.sparkSession.sparkContext.broadcast(at)  # PIVOTS vectors at most

    def run(batches):
        for pdf in _sliced(batches, PLACE):
            away = _between(_placed(_stack(pdf["embedding"]), metric), sent.value)
            cell = away.argmin(axis=1)
            yield pdf.assign(cell=cell, radius=away[np.arange(len(pdf)), cell])

    kind = rows.schema["chunk_id"].dataType.simpleString()
    placed = written(rows.mapInPandas(run, f"chunk_id {kind}, embedding array<double>, cell int, radius double"), "cells")
    size, low, high = np.zeros(len(at), np.int64), np.zeros(len(at)), np.zeros(len(at))
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high")).collect():
        size[r.cell], low[r.cell], high[r.cell] = r.n, r.low, r.high
    return Cells(placed, at, size, low, high, metric, origin)


def _asked(cells: Cells, queries: DataFrame, k: int) -> DataFrame:
    """(ask, qid, cell, away, least, bound, first): for each query (ask, qid, embedding) its cells; ``first`` marks the nearest that hold k vectors together.

    ``bound`` is a distance within which k vectors are known to lie.  A query has a row for each pivot at most, so
    rows are made of few queries at a time, and the query's vector is not in them.
    """
    sent = queries.sparkSession.sparkContext.broadcast((cells.pivots, cells.size, cells.low, cells.high))
    metric = cells.metric

    def run(batches):
        pivots, size, low, high = sent.value
        for pdf in _sliced(batches, MEET):
            away = _between(_placed(_stack(pdf["embedding"]), metric), pivots)
            out = []
            for i in range(len(pdf)):
                farthest = away[i] + high
                order = np.argsort(farthest, kind="stable")
                order = order[size[order] > 0]
                enough = np.searchsorted(np.cumsum(size[order]), k)
                bound = farthest[order[min(enough, len(order) - 1)]] if enough < len(order) else np.inf
                near = order[np.argsort(away[i][order], kind="stable")]
                take = near[: np.searchsorted(np.cumsum(size[near]), k) + 1]
                least = np.maximum(np.maximum(away[i] - high, low - away[i]), 0)
                keep = order[least[order] <= bound * (1 + RELATIVE) + SLACK]
                out.append((np.full(len(keep), i), keep, away[i][keep], least[keep], np.full(len(keep), bound), np.isin(keep, take)))
            at, *rest = map(np.concatenate, zip(*out))
            yield pd.DataFrame({"ask": pdf["ask"].to_numpy()[at], "qid": pdf["qid"].to_numpy()[at]} | dict(zip(("cell", "away", "least", "bound", "first"), rest)))

    kind = queries.schema["qid"].dataType.simpleString()
    return queries.mapInPandas(run, f"ask long, qid {kind}, cell int, away double, least double, bound double, first boolean")


def _distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """What is reported: squared distances, or cosine distances."""
    if metric == "l2":
        d = x - q
        return np.einsum("ij,ij->i", d, d)
    return 1 - (x @ q) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt(q @ q))


def _searched(cells: Cells, asked: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, chunk_id, distance): of each query and block of rows the k best; ``asked`` is a written table."""
    metric = cells.metric
    blocks = [max(1, -(-int(n) // ROW_BLOCK)) for n in cells.size]
    many = F.element_at(F.array(*[F.lit(b) for b in blocks]) if blocks else F.array(F.lit(1)), F.col("cell") + 1)
    rows = cells.rows.withColumn("rb", F.pmod(F.xxhash64("chunk_id"), many).cast("int"))
    # queries of a cell in blocks: numbered by hash, as many as their count asks for
    per = asked
    counted = per.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("qbs"))
    per = per.join(F.broadcast(counted), "cell")  # a row for each pivot at most
    per = per.withColumns({"qb": F.pmod(F.xxhash64("qid"), F.col("qbs")).cast("int"), "rb": F.explode(F.sequence(F.lit(0), many - 1))}).join(queries.select("ask", "embedding"), "ask")
    rows = rows.join(F.broadcast(counted), "cell").withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qbs") - 1))).drop("qbs")
    return _met(rows, per, k, metric)


def _met(rows: DataFrame, per: DataFrame, k: int, metric: str) -> DataFrame:
    """(qid, chunk_id, distance): the k best of each query in each block (cell, rb, qb) of rows (chunk_id, embedding, radius) and queries (qid, embedding, away, bound)."""
    none = pd.DataFrame({"qid": [], "chunk_id": [], "distance": []}, dtype=object)

    def run(key, left, right):
        if not len(left) or not len(right):
            return none
        left = left.sort_values("chunk_id", kind="stable")
        ids, x, radius = left["chunk_id"].to_numpy(), _stack(left["embedding"]), left["radius"].to_numpy()
        at = _placed(x, metric)
        square = (at * at).sum(axis=1)
        out = []
        for part in _sliced([right], MEET):
            asked = _stack(part["embedding"])
            p = _placed(asked, metric)
            size = (p * p).sum(axis=1)
            rough = np.maximum(square + size[:, None] - 2 * (p @ at.T), 0)
            limit = part["bound"].to_numpy() * (1 + RELATIVE) + SLACK
            rough[np.abs(radius - part["away"].to_numpy()[:, None]) > limit[:, None]] = np.inf
            if len(ids) > k:
                kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
            else:
                kth = np.full(len(part), np.inf)
            for i, qid in enumerate(part["qid"]):
                # an infinite k-th means that fewer than k are open: all of them stay
                near = rough[i] <= kth[i] + 1e-6 * (1 + kth[i] + size[i]) if np.isfinite(kth[i]) else np.isfinite(rough[i])
                open_ = np.flatnonzero(near)
                if len(open_):
                    found = np.round(_distances(x[open_], asked[i], metric), DIGITS) + 0.0
                    best = np.argsort(found, kind="stable")[:k]
                    out.append((np.full(len(best), qid, dtype=object), ids[open_[best]], found[best]))
        return pd.DataFrame(dict(zip(none.columns, map(np.concatenate, zip(*out))))) if out else none

    kinds = f"qid {per.schema['qid'].dataType.simpleString()}, chunk_id {rows.schema['chunk_id'].dataType.simpleString()}, distance double"
    return rows.groupBy("cell", "rb", "qb").cogroup(per.groupBy("cell", "rb", "qb")).applyInPandas(run, kinds)


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "chunk_id"))
    return found.withColumn("place", place).filter(F.col("place") <= k).drop("place")


def nearest_within(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, chunk_id, distance): by cosine, the k nearest rows (cell, chunk_id, embedding) of each query (cell, qid, embedding) that share a cell with it, each once.

    Rows and queries of a cell meet as blocks, and of each block k rows a query leave the task: pairs are
    compared but never exchanged.  A vector of zeros has distance 1 from all.  Null vectors are left out.
    """
    double = F.col("embedding").cast("array<double>").alias("embedding")
    queries = written(queries.filter("embedding is not null").select("cell", "qid", double), "asks")
    rows = written(rows.filter("embedding is not null").join(queries.select("cell").distinct(), "cell", "left_semi").select("cell", "chunk_id", double).distinct(), "rows")
    size = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / ROW_BLOCK).cast("int").alias("rbs"))
    size = written(size.join(queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("qbs")), "cell"), "sizes")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = rows.filter(~_zero()).join(size, "cell").withColumns({"rb": F.pmod(F.xxhash64("chunk_id"), "rbs").cast("int"), "qb": every("qbs"), "radius": F.lit(0.0)})
    per = queries.filter(~_zero()).join(size, "cell").withColumns({"qb": F.pmod(F.xxhash64("qid"), "qbs").cast("int"), "rb": every("rbs"), "away": F.lit(0.0), "bound": F.lit(float("inf"))})
    first = F.row_number().over(Window.partitionBy("cell").orderBy("chunk_id"))
    heads = lambda df: df.withColumn("n", first).filter(F.col("n") <= k).select("cell", "chunk_id")
    far = queries.filter(~_zero()).join(heads(rows.filter(_zero())), "cell").unionByName(queries.filter(_zero()).join(heads(rows), "cell"))
    found = _met(at.drop("rbs", "qbs"), per.drop("rbs", "qbs"), k, "cosine").unionByName(far.select("qid", "chunk_id", F.lit(1.0).alias("distance")))
    return _best(found.groupBy("qid", "chunk_id").agg(F.min("distance").alias("distance")), k)


def nearest(cells: Cells, queries: DataFrame, k: int) -> DataFrame:
    """(qid, chunk_id, distance): the ``k`` nearest vectors of every query (qid, embedding), exactly; ties by id.

    Null queries are not asked; a vector of zeros has cosine distance 1 from all.
    """
    return _with_plan(cells, queries, k)[0]


def skipped(cells: Cells, queries: DataFrame, k: int) -> DataFrame:
    """One row: pairs (of query and vector), searched (those in cells that were not ruled out), share skipped."""
    plan = _with_plan(cells, queries, k)[1]
    size = cells.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    seen = plan.join(size, "cell").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("searched"))
    asked = queries.filter("embedding is not null").agg((F.count(F.lit(1)) * F.lit(int(cells.size.sum()))).alias("pairs"))
    return asked.crossJoin(seen).withColumn("skipped", 1 - F.try_divide("searched", "pairs"))  # one row each


def _with_plan(cells: Cells, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    asked = queries.filter("embedding is not null").select("qid", F.col("embedding").cast("array<double>").alias("embedding"))
    extra = None
    if cells.metric == "cosine":
        # zero vectors: those of least id stand for all that are equally far
        zero = cells.origin.orderBy("chunk_id").limit(k)
        every = cells.rows.select("chunk_id").unionByName(cells.origin).orderBy("chunk_id").limit(k)
        far = lambda qs, rows: qs.select("qid").crossJoin(F.broadcast(rows)).withColumn("distance", F.lit(1.0))  # noqa: E731  k rows
        extra = far(asked.filter(~_zero()), zero).unionByName(far(asked.filter(_zero()), every))
        asked = asked.filter(~_zero())
    # a number of its own for each row of queries, by which its vector is found again
    asked = written(asked.withColumn("ask", F.monotonically_increasing_id()), "asks")
    plan = written(_asked(cells, asked, k), "plan")
    first = written(_best(_searched(cells, plan.filter("first").drop("least", "first"), asked, k), k), "first")
    kth = first.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("kth"))
    metric = F.sqrt("kth") if cells.metric == "l2" else F.sqrt(2 * F.greatest("kth", F.lit(0.0)))
    rest = plan.filter("not first").drop("first").join(kth, "qid", "left").withColumn("bound", F.least("bound", metric)).drop("kth")
    rest = written(rest.filter(F.col("least") <= F.col("bound") * (1 + RELATIVE) + SLACK).drop("least"), "rest")
    found = _best(first.unionByName(_searched(cells, rest, asked, k)), k)
    searched = plan.filter("first").select("qid", "cell").unionByName(rest.select("qid", "cell"))
    return (found if extra is None else _best(found.unionByName(extra), k)), searched
