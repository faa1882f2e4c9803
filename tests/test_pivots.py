"""Pruned neighbours against a full search."""

import numpy as np
import pytest

from noteloom.operators import pivots, search

SCHEMA = "chunk_id string, embedding array<float>, label int"


@pytest.fixture(scope="module")
def data(spark):
    """Clusters, copies, ties, zeros, a null and one far away."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 8)) * 10
    x = np.concatenate([centres[k % 6] + r.normal(size=(1, 8)) * 0.3 for k in range(300)])
    x = np.round(x, 3).astype(np.float32)
    x[10:25] = x[9]
    x[40:45] = 0
    x[50] = 100
    rows = [(f"v{k:03d}", [float(a) for a in x[k]], k % 5) for k in range(300)] + [("none", None, 0)]
    return x, spark.createDataFrame(rows, SCHEMA).repartition(3)


def full(x, ids, q, k, metric):
    x, q = x.astype(float), q.astype(float)
    if metric == "l2":
        d = ((x - q) ** 2).sum(axis=1)
    else:
        size = np.sqrt((x * x).sum(axis=1) * (q @ q))
        d = 1 - np.divide(x @ q, size, out=np.zeros(len(x)), where=size > 0)
    return [(ids[i], round(d[i], 6)) for i in sorted(range(len(x)), key=lambda i: (round(d[i], 9), ids[i]))[:k]]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("block", [None, 16])
def test_equals_a_full_search(spark, data, metric, block, monkeypatch):
    x, df = data
    if block:
        monkeypatch.setattr(pivots, "ROW_BLOCK", block)
        monkeypatch.setattr(pivots, "QUERY_BLOCK", 3)
    ids = [f"v{k:03d}" for k in range(len(x))]
    asked = [0, 9, 12, 41, 50, 77, 120, 299]
    queries = spark.createDataFrame([(k, [float(a) for a in x[k]]) for k in asked] + [(999, None)], "qid int, embedding array<float>")
    got = {}
    for r in search.knn_many(df, queries, 20, metric).collect():
        got.setdefault(r.qid, []).append((r.distance, r.chunk_id))
    assert set(got) == set(asked)
    for q, hits in got.items():
        assert [(c, round(d, 6)) for d, c in sorted(hits)] == full(x, ids, x[q], 20, metric)


def test_filter_and_more_than_there_are(spark, data):
    x, df = data
    queries = spark.createDataFrame([(1, [float(a) for a in x[7]])], "qid int, embedding array<float>")
    keep = [k for k in range(len(x)) if k % 5 == 2]
    got = search.knn_many(df, queries, 500, "l2", df["label"] == 2).collect()
    want = full(x[keep], [f"v{k:03d}" for k in keep], x[7], 500, "l2")
    assert [(r.chunk_id, round(r.distance, 4)) for r in sorted(got, key=lambda r: (r.distance, r.chunk_id))] == [(c, round(d, 4)) for c, d in want]


def test_cells_are_skipped(spark, data):
    x, df = data
    queries = spark.createDataFrame([(k, [float(a) for a in x[k]]) for k in range(60, 120)], "qid int, embedding array<float>")
    cells = pivots.celled(df)
    row = pivots.skipped(cells, queries, 5).first()
    assert row.pairs == 60 * 300 and row.searched <= row.pairs
    assert row.skipped > 0.5  # six clusters far apart


def test_nothing_to_search_or_to_ask(spark, data):
    _, df = data
    none = spark.createDataFrame([], SCHEMA)
    queries = spark.createDataFrame([(1, [1.0] * 8)], "qid int, embedding array<float>")
    for metric in ("l2", "cosine"):
        assert search.knn_many(none, queries, 3, metric).collect() == []
        assert search.knn_many(df, queries.limit(0), 3, metric).collect() == []


def test_plan_rows_are_made_of_few_queries(spark, data, monkeypatch):
    """A query has a row for each pivot: batches of them stay small, and hold no vectors."""
    x, df = data
    queries = spark.createDataFrame([(k % 7, [float(a) for a in x[k]]) for k in range(60, 260)], "qid int, embedding array<float>").coalesce(1)
    cells = pivots.celled(df, pivots=16)
    asked = queries.selectExpr("qid", "cast(embedding as array<double>) AS embedding", "cast(qid as long) AS ask")
    plan = pivots._asked(cells, asked, 200)
    assert "embedding" not in plan.columns
    sizes = plan.mapInArrow(lambda batches: batches, plan.schema).count()
    assert sizes > pivots.MEET * 16
    # rows of one query id are asked each, as a search of a table with repeats is
    assert pivots.nearest(cells, queries, 3).count() == 7 * 3


def test_nearest_within_cells_by_brute_force(spark, data, monkeypatch):
    """Pairs are compared in blocks: no join of queries with rows stands in the plan."""
    x, df = data
    monkeypatch.setattr(pivots, "ROW_BLOCK", 16)
    monkeypatch.setattr(pivots, "QUERY_BLOCK", 3)
    rows = spark.createDataFrame([(f"t{t}", f"v{k:03d}", [float(a) for a in x[k]]) for k in range(300) for t in (k % 3, k % 5)], "cell string, chunk_id string, embedding array<float>")
    asked = [(f"t{t}", k) for k in (0, 9, 41, 120, 299) for t in (1, 4)]
    queries = spark.createDataFrame([(t, k, [float(a) for a in x[k]]) for t, k in asked], "cell string, qid int, embedding array<float>")
    got = {}
    for r in pivots.nearest_within(rows, queries, 20).collect():
        got.setdefault(r.qid, []).append((r.distance, r.chunk_id))
    keep = [k for k in range(300) if k % 3 == 1 or k % 5 in (1, 4)]
    for k in {k for _, k in asked}:
        assert [(c, round(d, 6)) for d, c in sorted(got[k])] == full(x[keep], [f"v{j:03d}" for j in keep], x[k], 20, "cosine")
