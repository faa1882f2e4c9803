"""The quality loop against plain Python, and enrichment that is broken off and taken up."""

import re

import pytest
from pyspark.sql import functions as F

from noteloom.operators import rounds

CHUNKS = {f"c{i}": text for i, text in enumerate(["alpha beta", "gamma delta", "beta mars", "venus orbit", "mars rover", "empty", "delta venus", "sun"])}
NEXT = {"c0": ["c1", "c2"], "c1": ["c3"], "c2": ["c4", "c6"], "c3": ["c7"], "c4": ["c5"], "c5": [], "c6": ["c7", "c0"], "c7": []}
QUESTIONS = [("q1", "alpha beta"), ("q2", "Beta, mars? rover!"), ("q3", "venus orbit sun gamma nothing more words"), ("q4", "of it"), ("q5", None), ("q6", "no hits here")]
START = {"q1": ["c0"], "q2": ["c0"], "q3": ["c1", "c2"], "q4": ["c5"], "q5": ["c5"], "q6": []}


def words(t):
    return re.split(r"[^\w]+", (t or "").lower())


def plain(k, limit, enough):
    """The same loop, question by question."""
    hits, states = set(), set()
    for q, text in QUESTIONS:
        have = [(c, i + 1, 0) for i, c in enumerate(START[q])]
        for n in range(1, limit + 1):
            asked = {w for w in words(text) if len(w) > 2}
            got = set(words("\n".join(CHUNKS[c] for c, _, _ in have)))
            score = len(asked & got) / len(asked) if asked else 1.0
            last = (q, n, round(score, 6))
            if score > enough:
                break
            more = sorted({d for c, _, _ in have for d in NEXT[c]} - {c for c, _, _ in have}, key=lambda c: (-int(c[1:]), c))
            new = [(c, i + 1, n) for i, c in enumerate(more) if i < k // 2 and i + 1 + len(have) <= 2 * k]
            have += new
            if not new:
                break
        states.add(last)
        hits |= {(q, *h) for h in have}
    return hits, states


@pytest.fixture(scope="module")
def tables(spark):
    chunks = spark.createDataFrame(list(CHUNKS.items()), "chunk_id string, content string")
    edges = spark.createDataFrame([(a, b) for a, bs in NEXT.items() for b in bs], "src string, dst string")
    hits = spark.createDataFrame([(q, c, i + 1) for q, cs in START.items() for i, c in enumerate(cs)], "qid string, chunk_id string, place int")
    questions = spark.createDataFrame(QUESTIONS, "qid string, question string")

    def widen(h, number):
        found = h.select("qid", F.col("chunk_id").alias("src")).join(edges, "src")
        return found.select("qid", F.col("dst").alias("chunk_id"), F.substring("dst", 2, 9).cast("double").alias("rank_score")).distinct()

    return questions, hits, chunks, widen


@pytest.mark.parametrize(("k", "limit", "enough"), [(4, 2, 0.7), (2, 3, 0.99), (2, 1, 0.5), (1, 2, 0.7)])
def test_quality_loop(tables, k, limit, enough):
    questions, hits, chunks, widen = tables
    got, states = rounds.improved(questions, hits, chunks, widen, k=k, rounds=limit, enough=enough)
    want = plain(k, limit, enough)
    assert {(r.qid, r.chunk_id, r.place, r.round) for r in got.collect()} == want[0]
    assert {(r.qid, r.rounds, round(r.completeness, 6)) for r in states.collect()} == want[1]


def test_quality_loop_with_a_hook(tables):
    """The hook sees open questions only; whatever it finds complete stops at once."""
    questions, hits, chunks, widen = tables
    got, states = rounds.improved(questions, hits, chunks, widen, rounds.assessor(lambda qs, cs: [1.0 if "alpha" in q else 0.0 for q in qs]), k=4)
    by = {r.qid: (r.rounds, r.completeness) for r in states.collect()}
    assert by["q1"] == (1, 1.0) and by["q2"] == (2, 0.0)
    assert got.filter("qid = 'q1'").count() == 1 and got.filter("qid = 'q2' and round = 2").count() > 0


def test_relations_widen(spark):
    from noteloom.operators import structure

    c = spark.createDataFrame([(f"n/chunk_{i}", "n", i, 1 + i % 2, "text", f"h{i}", f"w{i}", i / 10) for i in range(6)], "chunk_id string, note_id string, seq int, header_level int, chunk_type string, header_text string, content string, importance_score double")
    q = spark.createDataFrame([("q", "other words")], "qid string, question string")
    h = spark.createDataFrame([("q", "n/chunk_0", 1)], "qid string, chunk_id string, place int")
    got, _ = rounds.improved(q, h, c, rounds.beside(structure.chunk_edges(c), c), k=2)
    assert got.filter("round > 0").count() > 0


def test_enrichment_is_taken_up(spark, tmp_path):
    calls = tmp_path / "calls"

    def classify(texts):
        with calls.open("a") as f:
            f.writelines(t + "\n" for t in texts)
        if any(t.startswith("bad") for t in texts):
            raise ValueError("no class")
        if any(t.startswith("later") for t in texts) and not (tmp_path / "now").exists():
            raise TimeoutError("try again")
        return ["area" if len(t) % 2 else "project" for t in texts]

    def asked():
        out = sorted(set(calls.read_text().split("\n")) - {""}) if calls.exists() else []
        calls.unlink(missing_ok=True)
        return out

    texts = [("a", "one"), ("b", "bad"), ("c", "later"), ("d", ""), ("e", None), ("f", "four"), ("g", " \n")]
    notes = spark.createDataFrame(texts, "note_id string, text string")
    state = rounds.enrichment(spark, str(tmp_path / "state"), 4)
    assert rounds.enrich(notes, state, classify, "m1") == 4
    assert asked() == ["bad", "four", "later", "one"]
    got = {r.note_id: (r["class"], r.attempts, r.error) for r in state.read("state").collect()}
    assert got == {"a": ("area", 1, None), "b": (None, 1, "ValueError: no class"), "c": (None, 1, "TimeoutError: try again"), "f": ("project", 1, None)}
    (tmp_path / "now").touch()
    assert rounds.enrich(notes, state, classify, "m1") == 2  # only what failed
    assert asked() == ["bad", "later"]
    assert rounds.enrich(notes, state, classify, "m1") == 1 and asked() == ["bad"]
    last = state.versions()
    assert rounds.enrich(notes, state, classify, "m1") == 0 and asked() == []  # three attempts are enough
    assert state.versions() == last  # a run without work writes nothing
    changed = notes.withColumn("text", F.when(F.col("note_id") == "a", "other").otherwise(F.col("text")))
    assert rounds.enrich(changed, state, classify, "m1") == 1 and asked() == ["other"]
    assert rounds.enrich(changed, state, classify, "m2") == 4  # another mark starts anew


def test_a_run_that_dies_is_taken_up_behind_its_last_part(spark, tmp_path, monkeypatch):
    notes = spark.createDataFrame([(f"n{i}", f"text {i}") for i in range(40)], "note_id string, text string")
    state = rounds.enrichment(spark, str(tmp_path / "state"), 4)
    whole, seen = type(state).commit, []

    def dying(self, *a, **b):
        seen.append(1)
        if len(seen) == 3:
            raise OSError("driver lost")
        return whole(self, *a, **b)

    monkeypatch.setattr(type(state), "commit", dying)
    with pytest.raises(OSError, match="driver lost"):
        rounds.enrich(notes, state, lambda ts: ["area"] * len(ts), "m", parts=4)
    monkeypatch.undo()
    done = state.read("state").count()
    assert 0 < done < 40
    assert rounds.enrich(notes, state, lambda ts: ["area"] * len(ts), "m", parts=4) == 40 - done
    assert state.read("state").filter("attempts = 1").count() == 40


def test_example_questions(spark):
    """Every kind, in one of its phrasings, the same each time; concepts are capitalised words that are no stop words."""
    from noteloom.operators import examples

    chunks = spark.createDataFrame([("n1/c0", "n1", "Head One", "The Mars Rover met Venus. This is From Earth"), ("n1/c1", "n1", "", "nothing"), ("n2/c0", "n2", None, None)], "chunk_id string, note_id string, header_text string, content string")
    notes = spark.createDataFrame([("n1", "First"), ("n2", "Second"), ("n3", None)], "note_id string, title string")
    edges = spark.createDataFrame([("n1", "n2"), ("n1", "n2"), ("n2", "n2")], "src string, dst string")
    tags = spark.createDataFrame([("n2", "a/b"), ("n1", "a/b")], "note_id string, tag string")
    got = [tuple(r) for r in examples.examples(chunks, notes, edges, tags).collect()]
    assert sorted(got) == sorted(tuple(r) for r in examples.examples(chunks, notes, edges, tags).collect())
    about = {"header": [("Head One",)], "link": [("First", "Second")], "tag": [("a/b",)], "concept": [("Earth",), ("From Earth",), ("The Mars Rover",), ("Venus",)], "factual": [("First",), ("Second",)]}
    for kind, _, question, ideal, intent, _ in got:
        want, answer, ways = examples.KINDS[kind]
        low = [tuple(x.lower() for x in a) if kind == "header" else a for a in about[kind]]
        assert intent == want and any(question == w.format(*a) for w in ways for a in low) and ideal in {answer.format(*a) for a in about[kind]}
    assert {k: sum(g[0] == k for g in got) for k in ("header", "link", "tag", "factual")} == {"header": 1, "link": 1, "tag": 1, "factual": 2}
