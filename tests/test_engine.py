"""A small vault, indexed and searched from end to end."""

import pytest
from pyspark.sql import functions as F

from noteloom.functions import hooks
from noteloom.operators.engine import Engine
from noteloom.plans import index
from tests.test_operators import CORPUS


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("vault")
    for name, content in CORPUS.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(content, encoding="utf-8")
    out = str(tmp_path_factory.mktemp("index"))
    index.build(spark, str(root), "v").write(out)
    made = index.read(spark, out)
    chunks = hooks.with_embeddings(made.chunks.join(made.notes.select("note_id", "tags", "vault"), "note_id"), "content").cache()
    return made, Engine(chunks, made.chunk_edges)


def test_index(built):
    made, _ = built
    kinds = {(r.note_id, r.chunk_type) for r in made.chunks.collect()}
    assert ("planets/Earth.md", "section") in kinds
    assert ("planets/Earth.md", "frontmatter") in kinds
    assert made.edges.filter("dst = 'planets/Mars.md'").count() == 2


def test_refresh_is_idempotent(built):
    made, _ = built
    fresh = made.notes.filter("note_id = 'planets/Mars.md'")
    once = index.refreshed(made, fresh)
    assert once.chunks.count() == made.chunks.count()
    assert {(r.src, r.dst) for r in once.edges.collect()} == {(r.src, r.dst) for r in made.edges.collect()}


def test_vector_search_finds_the_note(built):
    _, engine = built
    top = engine.search_notes("near Mars blue sky Earth", k=3)
    assert "planets/Earth.md" in {r.chunk_id.rsplit("/chunk", 1)[0] for r in top.collect()}


@pytest.mark.parametrize(("question", "strategy"), [("notes tagged with planets", "tag"), ("what links to Mars?", "graph"), ("explain #planets idea", "hybrid"), ("mars details", "vector")])
def test_smart_search(built, question, strategy):
    _, engine = built
    r = engine.smart_search(question, k=4)
    assert r.routed.strategy == strategy
    hits = r.hits.collect()
    assert hits
    assert len({h.chunk_id for h in hits}) == len(hits) <= 4
    assert not {x.chunk_id for x in r.related.collect()} & {h.chunk_id for h in hits}
    row = r.status.first()
    assert 0 <= row.confidence <= 1
    assert row.status in ("ok", "degraded")


def test_vault_without_notes(built):
    _, engine = built
    r = engine.smart_search("mars details", vault="other")
    assert r.hits.count() == 0
    assert r.status.first().status == "degraded"
    assert engine.ask("mars details", vault="other")["answer"] == ""


def test_ask(built):
    _, engine = built
    got = engine.ask("what is near Mars?")
    assert "Mars" in got["context"]
    assert got["answer"]


def test_expanded_is_a_choice_of_candidates(built):
    _, engine = built
    got = engine.expanded("near mars", 3).collect()
    assert sorted(r.place for r in got) == list(range(len(got)))
    assert {r.chunk_id for r in got} <= {r.chunk_id for r in engine.chunks.collect()}


@pytest.mark.parametrize("question", ["what links to Mars?", "notes tagged with topic", "in note Earth", "about mars"])
def test_retrieve_by_intent(built, question):
    _, engine = built
    got = engine.retrieve(question, 4).collect()
    assert len({r.chunk_id for r in got}) == len(got) <= 4


def test_hooks(spark):
    df = spark.createDataFrame([("Old Town is a place",), (None,)], "text string")
    got = hooks.with_class(df, lambda texts: ["area" if t else "archive" for t in texts])
    assert sorted(r.para_type for r in got.collect()) == ["archive", "area"]
    assert df.select(hooks.concepts(F.col("text")).alias("c")).first().c == ["Old Town"]
    assert df.select(hooks.concepts(F.col("text"), F.lit("1. Graph theory")).alias("c")).first().c == ["Graph theory"]
    assert hooks.hashed_embedding([""])[0] == [0.0] * 64
    assert sum(x * x for x in hooks.hashed_embedding(["a b"])[0]) == pytest.approx(1)


def test_written_index_can_be_refreshed_in_place(built, spark, tmp_path):
    made, _ = built
    out = str(tmp_path / "index")
    made.write(out)
    before = {(r.note_id, r.text) for r in made.notes.collect()}
    for turn in range(3):
        now = index.read(spark, out)
        fresh = now.notes.filter("note_id = 'planets/Mars.md'").withColumn("text", F.lit(f"## Turn\n{turn}"))
        index.refreshed(now, fresh).write(out)
        now.notes.count()  # who still reads the version before is not disturbed
    after = {r.note_id: r.text for r in index.read(spark, out).notes.collect()}
    assert after == {n: "## Turn\n2" if n == "planets/Mars.md" else t for n, t in before}
    assert len([p for p in (tmp_path / "index").iterdir() if p.is_dir()]) == 2


def test_last_change_does_not_depend_on_order(spark):
    from noteloom.streaming import feed

    rows = [("a", 1, f"text {k}") for k in range(40)]
    got = {feed.last_change(spark.createDataFrame(rows[k:] + rows[:k], "note_id string, changed_at int, text string").repartition(k + 1)).first().text for k in range(4)}
    assert len(got) == 1


def test_changes_are_filtered_by_extension_and_dot_folders(spark):
    from noteloom.streaming import feed

    paths = ["a.md", "b/C.MD", "b/c.txt", ".git/a.md", "b/.hidden/a.md", "b/.a.md", "v1.2/a.md", "md"]
    assert [r.rel for r in feed.matching(spark.createDataFrame([(p,) for p in paths], "rel string")).collect()] == ["a.md", "b/C.MD", "v1.2/a.md"]


def test_scratch_needs_a_shared_folder_off_a_local_master():
    from noteloom import tables

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        tables.shared_folder(Session())
