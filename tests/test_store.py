"""Buckets that are written copy-on-write, versions over several tables, and the index kept in them."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from noteloom.operators.notes import note_tags, resolve_links
from noteloom.plans import index
from noteloom.store import Change, Store


def files(root):
    return {str(p.relative_to(root)) for p in Path(root).rglob("*.parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def table(spark, pairs):
    return spark.createDataFrame(pairs, "id string, v int")


def keys(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "key string")


@pytest.fixture
def made(spark, tmp_path):
    s = Store(spark, str(tmp_path), {"a": "id", "b": "id"}, 8)
    s.commit({"a": Change(fresh=table(spark, [(f"k{i}", i) for i in range(40)])), "b": Change(fresh=table(spark, [("x", 1), (None, 2)]))})
    return s


def test_one_key_writes_one_bucket_a_table(spark, made, tmp_path):
    before = files(tmp_path)
    made.commit({"a": Change(fresh=table(spark, [("k7", 700), ("k7", 701)]))})
    new = {f.rpartition("/")[0] for f in files(tmp_path) - before}
    assert len(new) == 1 and next(iter(new)).startswith("files/a/1-")
    assert rows(made.read("a")) == sorted([(f"k{i}", i) for i in range(40) if i != 7] + [("k7", 700), ("k7", 701)], key=repr)
    assert rows(made.read("a", version=0)) == sorted([(f"k{i}", i) for i in range(40)], key=repr)
    assert rows(made.read("b")) == rows(made.read("b", version=0))
    assert rows(made.read("a", ["k7", "k8", "none"])) == [("k7", 700), ("k7", 701), ("k8", 8)]


def test_deletes_and_empty_buckets(spark, made):
    made.commit({"a": Change(gone=keys(spark, [f"k{i}" for i in range(39)])), "b": Change(gone=keys(spark, ["x"]))})
    assert rows(made.read("a")) == [("k39", 39)]
    assert rows(made.read("b")) == [(None, 2)]
    made.commit({"a": Change(gone=keys(spark, ["k39"]))})
    assert made.read("a").count() == 0 and made.read("a").columns == ["id", "v"]
    made.commit({"a": Change(fresh=table(spark, [("back", 1)]))})
    assert rows(made.read("a")) == [("back", 1)]


def test_a_commit_that_dies_between_tables_changes_nothing(spark, made, monkeypatch):
    whole, seen = Store._written, []

    def dying(self, name, *rest):
        seen.append(name)
        if len(seen) == 2:
            raise OSError("lost")
        return whole(self, name, *rest)

    monkeypatch.setattr(Store, "_written", dying)
    before = rows(made.read("a")), rows(made.read("b"))
    with pytest.raises(OSError, match="lost"):
        made.commit({"a": Change(fresh=table(spark, [("k1", -1)])), "b": Change(fresh=table(spark, [("x", -1)]))})
    assert (rows(made.read("a")), rows(made.read("b"))) == before and made.versions() == [0]
    monkeypatch.undo()
    assert made.commit({"a": Change(fresh=table(spark, [("k1", -1)]))}) == 1
    assert ("k1", -1) in rows(made.read("a"))


def test_a_repeated_commit_gives_the_same(spark, made):
    change = {"a": Change(fresh=table(spark, [("k1", 5)]))}
    made.commit(change, number=3)
    once = rows(made.read("a"))
    made.commit({"a": Change(fresh=table(spark, [("k2", 6)]))}, number=4)
    made.commit(change, number=3)
    assert rows(made.read("a", version=3)) == once


def test_unused_buckets_go(spark, made, tmp_path):
    for n in range(4):
        made.commit({"a": Change(fresh=table(spark, [("k1", n)]))})
    assert made.versions() == [3, 4]
    named = {p for v in made.versions() for t in made.manifest(v).values() for p in t["files"].values()}
    assert {f.rpartition("/")[0] for f in files(tmp_path)} == named


# --- the index -----------------------------------------------------------------------------------

NOTE = "note_id string, title string, stem string, text string, tags array<string>, links array<string>"


def notes(spark, items):
    return spark.createDataFrame([(i, t, i.rpartition("/")[2].removesuffix(".md"), x, tags, links) for i, t, x, tags, links in items], NOTE)


START = [
    ("a/one.md", "One", "# One\n\nText of one, long enough to be kept as a paragraph of its own.", ["t"], ["Two", "missing"]),
    ("a/two.md", "Two", "# Two\n\nBody.\n\n## Sub\n\nMore.", ["t", "u"], ["one"]),
    ("b/three.md", "Three", "Plain.", [], ["TWO", "four"]),
    ("b/two.md", "Other", "A second file of that stem.", [], []),
]


def whole(spark, items):
    n = notes(spark, items)
    chunks = index.chunked(n)
    return index.Index(n, note_tags(n), resolve_links(n), chunks, index.structure.chunk_edges(chunks))


def same(a, b):
    for name, df in vars(a).items():
        other = getattr(b, name)
        assert rows(df.select(sorted(df.columns))) == rows(other.select(sorted(df.columns))), name


@pytest.fixture
def held(spark, tmp_path):
    s = index.store(spark, str(tmp_path), 16)
    index.put(s, whole(spark, START))
    return s


def test_refresh_equals_a_full_build(spark, held, tmp_path):
    """A note that changes its name, a new one that settles an open link, one that goes: all links come out as if built anew."""
    fresh = [("a/two.md", "Deux", "# Deux\n\nNew body.", ["v"], ["three"]), ("c/four.md", "Four", "x", [], ["Two"])]
    index.refresh(held, notes(spark, fresh), spark.createDataFrame([("a/one.md",)], "note_id string"))
    same(index.get(held), whole(spark, [START[2], START[3], *fresh]))
    same(index.get(held, 0), whole(spark, START))


def test_refresh_of_one_note_writes_one_bucket_a_table(spark, held, tmp_path):
    before = files(tmp_path)
    index.refresh(held, notes(spark, [("b/three.md", "Three", "Changed.", ["w"], ["One"])]))
    new = {f.rpartition("/")[0] for f in files(tmp_path) - before}
    assert sorted(f.split("/")[1] for f in new) == sorted({f.split("/")[1] for f in new}) and len(new) <= 5


def test_archive_moves_everything_together(spark, held):
    index.archive(held, spark.createDataFrame([("a/two.md",), ("b/two.md",)], "note_id string"))
    moved = [START[0], ("Archive/two.md", *START[1][1:]), START[2], ("Archive/two 2.md", *START[3][1:])]
    # stems follow the text of the note, not its new place
    want = whole(spark, moved)
    got = index.get(held)
    assert rows(got.notes.select("note_id", "title", "stem")) == rows(want.notes.select("note_id", "title").withColumn("stem", F.when(F.col("note_id").startswith("Archive"), "two").otherwise(F.regexp_extract("note_id", r"([^/]+)\.md$", 1))))
    ids = {r.note_id for r in got.notes.collect()}
    assert {r.src for r in got.edges.collect()} | {r.dst for r in got.edges.collect()} <= ids
    held_chunks = {r.note_id for r in got.chunks.collect()}
    assert "Archive/two.md" in held_chunks and held_chunks <= ids
    chunk_ids = {r.chunk_id for r in got.chunks.collect()}
    assert {r.src for r in got.chunk_edges.collect()} <= chunk_ids
    assert ("b/three.md", 0, "Archive/two 2.md") in rows(got.edges) or ("b/three.md", 0, "Archive/two.md") in rows(got.edges)
    same(index.get(held, 0), whole(spark, START))
