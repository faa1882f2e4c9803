"""Streams with restarts, late rows and timers, against plain renderings of the same rules."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from noteloom.streaming import feed, run
from noteloom.streaming.debounce import debounced, merged

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "path string, at timestamp, n long, tags array<string>"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def feed_in(spark, where, parts, plan, schema=SCHEMA):
    """Each part as a file of its own and a run of its own; what each run reports."""
    out = []
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{where}/in")
        out.append(run.drained(plan(spark.readStream.schema(schema).parquet(f"{where}/in")), f"{where}/out", f"{where}/state"))
    return out


def test_merged_bursts():
    r = random.Random(4)
    for _ in range(300):
        times = [r.randrange(60) for _ in range(r.randrange(1, 12))]
        points = [(t, t, k, f"{t}/{k}") for k, t in enumerate(times)]
        # last of a burst: nothing follows within less than the quiet time
        want = sorted(max((p for p in points if p[1] == t))[3] for t in set(times) if not any(t < u < t + 5 for u in times))
        r.shuffle(points)
        held = []
        for p in points:  # one change a batch, in any order
            held = merged([*held, p], 5)
        assert sorted(b[3] for b in held) == want == sorted(b[3] for b in merged(points, 5))


@pytest.fixture(scope="module")
def changed():
    r = random.Random(9)
    rows = [(f"n{r.randrange(6)}.md", at(r.randrange(4000) / 10), k, ["x"] if k % 3 else None) for k in range(400)]
    return rows + [("last.md", at(4000), -1, None)]  # carries the watermark past all others


def settled_of(rows, quiet):
    out = set()
    for path in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == path), key=lambda r: (r[1], r[2]))
        out |= {a[2] for a, b in zip(own, [*own[1:], None]) if b is None or (b[1] - a[1]).total_seconds() >= quiet}
    return out - {-1}


@pytest.mark.parametrize("parts", [1, 3])
def test_debounce_across_restarts(spark, tmp_path, changed, parts):
    """However the changes are cut into runs, the same ones settle, with all their columns."""
    rows = sorted(changed, key=lambda r: r[1]) if parts > 1 else changed
    cut = [rows[k * len(rows) // parts : (k + 1) * len(rows) // parts] for k in range(parts)]
    # neighbouring parts overlap in time: every seventh change comes one part later
    for k in range(parts - 1):
        late = cut[k][-40::7]
        cut[k], cut[k + 1] = [x for x in cut[k] if x not in late], late + cut[k + 1]
    reports = feed_in(spark, tmp_path, cut, lambda s: debounced(s, "path", "at", 1000, "60 seconds", "n"))
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sum(r.dropped for r in reports) == 0 and sum(r.rows for r in reports) == len(rows)
    assert {r.n for r in got} == settled_of(rows, 1.0) and len(got) == len({r.n for r in got})
    by = {r[2]: r for r in rows}
    assert all((r.path, r.at.replace(tzinfo=timezone.utc), r.tags) == (by[r.n][0], by[r.n][1], by[r.n][3]) for r in got)
    assert reports[-1].held == 1  # last.md waits still


def test_debounce_drops_and_counts_late_changes(spark, tmp_path):
    parts = [[("a", at(0), 1, None), ("a", at(0.5), 2, None), ("b", at(500), 3, None)], [("a", at(0.9), 4, None), ("b", at(500.2), 5, None)], [("c", at(2000), 6, None)]]
    reports = feed_in(spark, tmp_path, parts, lambda s: debounced(s, "path", "at", 1000, "10 seconds", "n"))
    assert [r.dropped for r in reports] == [0, 1, 0]
    assert {r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {2, 5}


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def test_windows_count_late_rows(spark, tmp_path):
    """Two batches: the second holds three rows behind the watermark, each of another window and type."""
    first = [(k, at(600 * k), k % 3, "click", 1.0) for k in range(60)]
    second = [(100, at(10), 1, "late", 1.0), (101, at(4000), 1, "late", 1.0), (102, at(10), 1, "later", 1.0), (103, at(600 * 60), 1, "click", 2.0), (104, at(600 * 59), 2, "click", 4.0), (105, at(100_000), 0, "end", 0.0)]
    reports = feed_in(spark, tmp_path, [first, second, []], lambda s: feed.windowed(s, "1 hour", late="1 hour"), EVENTS)
    assert [r.dropped for r in reports[:2]] == [0, 3]
    got = {(r.start.replace(tzinfo=timezone.utc), r.event_type): (r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(at(3600 * h), "click"): (6, 6.0) for h in range(10)}
    want[(at(3600 * 9), "click")] = (7, 10.0)
    want[(at(36_000), "click")] = (1, 2.0)
    assert got == want


def test_sessions_and_duplicates_across_batches(spark, tmp_path):
    first = [(1, at(0), 1, "a", 0.0), (2, at(100), 1, "a", 0.0), (3, at(7000), 2, "a", 0.0), (1, at(0), 1, "a", 0.0)]
    second = [(4, at(7100), 2, "a", 0.0), (3, at(7000), 2, "a", 0.0), (5, at(50), 1, "late", 0.0), (6, at(90_000), 9, "end", 0.0)]
    reports = feed_in(spark, tmp_path / "s", [first, second], lambda s: feed.sessions(s, "10 minutes", "10 minutes"), EVENTS)
    got = {(r.user_id, r.n) for r in spark.read.parquet(f"{tmp_path}/s/out").collect()}
    assert got == {(1, 3), (2, 3)} and reports[1].dropped == 1
    reports = feed_in(spark, tmp_path / "d", [first, second], lambda s: feed.deduplicated(s, ["event_id"], late="10 minutes"), EVENTS)
    ids = sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/d/out").collect())
    assert ids == [1, 2, 3, 4, 6] and reports[1].dropped == 1


def test_tables_are_deduplicated_too(spark):
    rows = spark.createDataFrame([(1, at(0), 1, "a", 0.0)] * 3 + [(2, at(1), 1, "a", 0.0)], EVENTS)
    assert feed.deduplicated(rows, ["event_id"]).agg(F.count(F.lit(1)).alias("n")).first().n == 2


def test_debounce_is_native(spark, tmp_path):
    """No Python worker holds a key's bursts: state and timers of one key cost a call each there, which a large table cannot pay."""
    spark.createDataFrame([("a", at(0), 1, None)], SCHEMA).write.parquet(f"{tmp_path}/in")
    stream = debounced(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), "path", "at", 1000, "10 seconds", "n")
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Session" in plan.replace("session", "Session")
