"""Operators against small worked examples and plain Python renderings."""

import random

import pytest
from pyspark.sql import functions as F

from noteloom.operators import chunking, filters, graph, mutations, search, structure
from noteloom.operators import notes as note_ops
from noteloom.sources import vault
from noteloom.streaming import feed
from tests import plain_chunks

CORPUS = {
    "README.md": "---\ntitle: Main\ntags: [test/suite, corpus]\n---\n# Main\nwelcome",
    "planets/Earth.md": "---\ntitle: Earth\ntags:\n  - test/suite\n  - topic/planets\nrating: 5\n---\n# Earth\nnear [[Mars]] #blue/sky",
    "planets/Mars.md": "---\ntitle: Mars\ntags: [test/suite, topic/planets]\n---\n# Mars\nnear [[earth|home]]",
    "links/Link Map.md": "---\ntitle: Link Map\ntags: [links]\n---\n[[Earth]] and [[Mars#x]] and [[Nowhere]]",
    "draw.excalidraw": '{"elements":[{"text":"one"},{"type":"line"},{"text":"two [[Earth]]"}]}',
    "broken.md": "---\n: : :\n  bad\n---\nbody",
    "empty.md": "",
    ".hidden/no.md": "x",
    "b.base": '{"id":"b"}',
}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("vault")
    for name, content in CORPUS.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(content, encoding="utf-8")
    return str(root), vault.notes(spark, str(root), "v").cache()


def test_vault(spark, corpus):
    root, notes = corpus
    rows = {r.note_id: r for r in notes.collect()}
    assert set(rows) == set(CORPUS) - {".hidden/no.md", "b.base", "empty.md"}  # Spark does not list empty files
    assert rows["planets/Earth.md"].tags == ["blue/sky", "test/suite", "topic/planets"]
    assert rows["planets/Earth.md"].frontmatter["rating"] == "5"
    assert rows["draw.excalidraw"].text == "one\ntwo [[Earth]]"
    listed = vault.bases(spark, root)
    assert [r.name for r in listed.collect()] == ["b.base"]
    assert [(r.name, r.exact) for r in vault.base_exists(listed, "b").collect()] == [("b.base", True)]


def test_links_and_backlinks(corpus):
    edges = note_ops.resolve_links(corpus[1])
    got = sorted((r.src, r.ord, r.dst) for r in edges.collect())
    assert got == [("draw.excalidraw", 0, "planets/Earth.md"), ("links/Link Map.md", 0, "planets/Earth.md"), ("links/Link Map.md", 1, "planets/Mars.md"), ("planets/Earth.md", 0, "planets/Mars.md"), ("planets/Mars.md", 0, "planets/Earth.md")]
    back = {r.note_id: r.backlinks for r in note_ops.backlinks(edges).collect()}
    assert back["planets/Mars.md"] == ["links/Link Map.md", "planets/Earth.md"]
    near = graph.neighbors(edges, edges.sparkSession.createDataFrame([("planets/Earth.md",)], "node string"), 1)
    assert {r.node for r in near.collect()} == {"planets/Earth.md", "planets/Mars.md", "links/Link Map.md", "draw.excalidraw"}


def test_tags(corpus):
    tags = note_ops.note_tags(corpus[1])
    assert {r.note_id for r in note_ops.notes_by_tag(corpus[1], "topic/planets").collect()} == {"planets/Earth.md", "planets/Mars.md"}
    tree = {r.path: r.n for r in note_ops.tag_hierarchy(tags).collect()}
    assert tree["test"] == tree["test/suite"] == 3
    assert tree["topic"] >= tree["topic/planets"]
    assert note_ops.tag_neighbors(tags, F.lit("planets/Earth.md")).filter("note_id = 'planets/Mars.md'").first().shared == 2


@pytest.fixture(scope="module")
def chunks(spark):
    r = random.Random(3)
    rows = []
    for n in range(25):
        for s in range(r.randrange(0, 14)):
            rows.append((f"n{n}/chunk_{s}", f"n{n}", s, r.choice([None, 1, 2, 3, 4, 5, 6]), f"h{n}.{s}", "section", "x" * r.randrange(0, 300)))
    df = spark.createDataFrame(rows, "chunk_id string, note_id string, seq int, header_level int, header_text string, chunk_type string, content string")
    return df.withColumn("contains_tags", F.array().cast("array<string>")).withColumn("contains_links", F.array().cast("array<string>")).cache(), rows


def test_structure_against_loops(chunks):
    df, rows = chunks
    by_note: dict = {}
    for c in rows:
        by_note.setdefault(c[1], []).append(c)
    parent = {}
    for cs in by_note.values():
        for i, c in enumerate(cs):
            above = [p for p in cs[:i] if c[3] and p[3] and p[3] < c[3]]
            if above:
                parent[c[0]] = above[-1]
    assert {(r.src, r.dst) for r in structure.parent_edges(df).collect()} == {(k, v[0]) for k, v in parent.items()}
    level = {c[0]: c[3] for c in rows}
    assert {(r.src, r.dst) for r in structure.child_edges(df).collect()} == {(v[0], k) for k, v in parent.items() if level[k] == v[3] + 1}
    up = lambda c: parent.get(c[0], (None,))[0]
    pairs = {(a[0], b[0]) for cs in by_note.values() for a in cs for b in cs if a[0] != b[0] and a[3] and a[3] == b[3] and up(a) == up(b)}
    assert {(r.src, r.dst) for r in structure.sibling_edges(df).collect()} == pairs
    # the same as classes: a row each, spelled out only for chunks that are asked for
    edges = structure.chunk_edges(df)
    assert edges.filter("rel = 'sibling'").count() == sum(c[3] is not None for c in rows)
    assert {(r.src, r.dst) for r in graph.steps(edges).filter("rel = 'sibling'").collect()} == pairs
    asked = df.filter("seq < 2").select(F.col("chunk_id").alias("src"))
    ids = {r.src for r in asked.collect()}
    assert {(r.src, r.dst) for r in graph.steps(edges, asked).filter("rel = 'sibling'").collect()} == {p for p in pairs if p[0] in ids}
    few = {}
    for a, b in sorted(pairs):
        few.setdefault(a, []).append(b)
    got = graph.first_neighbors(graph.steps(edges, asked, 2).filter("rel = 'sibling'"), 2).collect()
    assert {(r.src, r.dst) for r in got} == {(a, b) for a, bs in few.items() if a in ids for b in bs[:2]}
    steps = {(a[0], b[0]) for cs in by_note.values() for a, b in zip(cs, cs[1:])}
    seq = structure.sequential_edges(df)
    assert {(r.src, r.dst) for r in seq.filter("rel = 'sequential_next'").collect()} == steps
    assert {(r.dst, r.src) for r in seq.filter("rel = 'sequential_prev'").collect()} == steps


def test_header_paths_against_a_stack(chunks):
    df, rows = chunks
    expected, stacks = {}, {}
    for cid, note, _, lvl, title, *_ in rows:
        stack = stacks.setdefault(note, [])
        expected[cid] = ""
        if lvl:
            expected[cid] = " > ".join(t for k, t in _ancestors(stack, lvl))
            stack.append((lvl, title))
    assert {r.chunk_id: r.path for r in structure.header_path(df).collect()} == expected


def _ancestors(seen, level):
    out = []
    for k, t in seen:
        if k < level:
            while out and out[-1][0] >= k:
                out.pop()
            out.append((k, t))
    return out


def test_importance_is_clamped(chunks):
    got = structure.with_importance(chunks[0]).select(F.min("importance_score"), F.max("importance_score")).first()
    assert 0 <= got[0] <= got[1] <= 1


def test_traversal_depth(chunks):
    df, _ = chunks
    edges = structure.chunk_edges(df)
    start = df.filter("seq = 0").select("chunk_id").limit(1)
    depth = {r.chunk_id: r.depth for r in graph.traverse(edges, start, 2).collect()}
    ends: dict = {}
    for r in graph.steps(edges).collect():
        ends.setdefault(r.src, set()).add(r.dst)
    seen = {start.first().chunk_id: 0}
    frontier = set(seen)
    for d in (1, 2):
        frontier = {x for f in frontier for x in ends.get(f, ())} - set(seen)
        seen |= dict.fromkeys(frontier, d)
    assert depth == seen


@pytest.mark.parametrize("line, kind", [("", "empty"), ("# x", "header"), ("#tag", "header"), ("```py", "code_fence"), ("> q", "quote"), ("  - a", "list_item"), ("12. a", "list_item"), ("|a|b|", "table_row"), ("--- ==", "separator"), ("a - b", "text")])
def test_line_type(spark, line, kind):
    assert spark.range(1).select(chunking.line_type(F.lit(line)).alias("v")).first().v == kind


def test_character_chunks():
    words = " ".join(f"word{i}" for i in range(600))
    parts = chunking.split_characters(words, 200, 50)
    assert all(len(p) <= 200 for p in parts)
    assert parts[0] == words[: len(parts[0])]
    assert chunking.split_characters("short") == ["short"]
    assert chunking.split_characters("x" * 450, 200, 50) == ["x" * 200, "x" * 200, "x" * 150]


def test_semantic_chunks():
    long = "\n\n".join(f"paragraph {i} " + "y" * 700 for i in range(8))
    md = f"before the first header there is a paragraph that is long enough\n# A\nintro\n## B\ntext\n```\n# not a header\n- not a list\n```\n# C\n{long}\n- one\n- two"
    found = plain_chunks.semantic_chunks("n", md, "title: x")
    assert [c["chunk_type"] for c in found[:4]] == ["frontmatter", "paragraph", "section", "section"]
    b = next(c for c in found if c["header_text"] == "B")
    assert b["parent_headers"] == ["A"]
    assert "# not a header" in b["content"]
    c = [x for x in found if x["header_text"] == "C"]
    assert [x["chunk_type"] for x in c][-1] == "list"
    assert all(len(x["content"]) <= 3000 for x in c)
    assert "".join(x["content"] for x in c[:-1]).replace("\n", "") == long.replace("\n", "")
    assert [x["seq"] for x in found] == list(range(len(found)))


def test_merge_small():
    base = {"chunk_type": "paragraph", "header_level": 1, "header_text": "h", "end_line": 0, "contains_tags": [], "contains_links": []}
    out = plain_chunks.merge_small([base | {"content": "a" * 150}, base | {"content": "b" * 150, "end_line": 5}, base | {"content": "c" * 50}, base | {"content": "d", "header_text": "i"}])
    assert [len(c["content"]) for c in out] == [302, 50, 1]
    assert out[0]["end_line"] == 5


def test_split_large_prefers_rules():
    assert plain_chunks.split_large("a" * 2000 + "\n***\n" + "b" * 2000) == ["a" * 2000, "b" * 2000]
    assert [len(p) for p in plain_chunks.split_large("\n".join(["x" * 1400] * 4))] == [2801, 2801]


def test_section_replacement():
    done = mutations.replaced_section("# A\nold\n## deep\nx\n# B\ny", " a ", "new")
    assert done == "# A\n\nnew\n\n# B\ny"
    with pytest.raises(ValueError):
        mutations.replaced_section("# A", "B", "x")
    with pytest.raises(ValueError):
        mutations.replaced_section("```\n# A\n```", "A", "x")


def test_where_and_filters(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "s string, n int")
    assert df.filter(filters.where_match(df, {"s": ""})).first().n == 2
    assert df.filter(filters.where_match(df, {"n": {"$in": ["1"]}, "other": {"$ne": "x"}})).first().s == "a"
    with pytest.raises(ValueError):
        filters.where_match(df, {"s": {"$gt": 1}})
    with pytest.raises(ValueError):
        filters.condition(F.col("s"), "like", 1)
    assert df.filter(filters.condition(F.col("s"), "ncontains", "a")).first().n == 2
    assert df.filter(filters.condition(F.col("s"), "regex", "[")).count() == 0


def test_upsert_and_delete(spark):
    old = spark.createDataFrame([("a/0", "a"), ("a/1", "a"), ("b/0", "b")], "chunk_id string, note_id string")
    new = spark.createDataFrame([("a/9", "a")], "chunk_id string, note_id string")
    once = mutations.upsert_notes(old, new)
    assert sorted(r.chunk_id for r in once.collect()) == ["a/9", "b/0"]
    assert sorted(r.chunk_id for r in mutations.upsert_notes(once, new).collect()) == ["a/9", "b/0"]
    assert [r.chunk_id for r in mutations.delete_notes(old, new).collect()] == ["b/0"]


def test_mmr_matches_a_plain_rendering(spark):
    r = random.Random(5)
    rows = [("q", f"c{i:02}", f"n{r.randrange(4)}", r.choice(["section", "list"]), r.choice(["", "h1", "h2"]), round(r.random(), 3)) for i in range(20)]
    got = search.mmr(spark.createDataFrame(rows, "qid string, chunk_id string, note_id string, chunk_type string, header_text string, final_score double"), 6)
    left, chosen = sorted(rows, key=lambda x: (-x[5], x[1])), []
    sim = lambda a, b: 0.5 * (a[2] == b[2]) + 0.2 * (a[3] == b[3]) + 0.1 * (a[4] != "" and a[4] == b[4])
    while len(chosen) < 6:
        best = left[0] if not chosen else max(left, key=lambda c: 0.7 * c[5] - 0.3 * max(sim(c, d) for d in chosen))
        left.remove(best)
        chosen.append(best)
    assert [x.chunk_id for x in got.orderBy("place").collect()] == [c[1] for c in chosen]


def test_stream_upsert(spark, tmp_path):
    schema = "note_id string, v int, changed_at int"
    src, table = str(tmp_path / "in"), f"file://{tmp_path}/table"
    spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 1)], schema).coalesce(1).write.parquet(src)
    typed = spark.read.parquet(src).schema
    feed.upsert_stream(feed.changes(spark, src, typed), table, str(tmp_path / "state"))
    spark.createDataFrame([("b", 9, 3), ("c", 1, 3)], schema).coalesce(1).write.mode("append").parquet(src)
    feed.upsert_stream(feed.changes(spark, src, typed), table, str(tmp_path / "state"))
    now = feed.current(spark, table)
    assert sorted((r.note_id, r.v) for r in now.collect()) == [("a", 2), ("b", 9), ("c", 1)]
    listed = spark.createDataFrame([("a",)], "note_id string")
    assert sorted(r.note_id for r in feed.deleted(now, listed).collect()) == ["b", "c"]


def _random_graph(spark, seed, n, m):
    import random

    r = random.Random(seed)
    pairs = sorted({(f"n{r.randrange(n):02d}", f"n{r.randrange(n):02d}") for _ in range(m)})
    return pairs, spark.createDataFrame(pairs, "src string, dst string")


def _depths(pairs, start):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    depth, level = {start: 0}, [start]
    while level:
        level = sorted({x for y in level for x in near.get(y, ()) if x not in depth})
        depth |= {x: max(depth.values()) + 1 for x in level}
    return depth


def test_deep_traversals_against_plain_search(spark):
    pairs, edges = _random_graph(spark, 3, 60, 55)
    start = pairs[0][0]
    want = _depths(pairs, start)
    got = graph.neighbors(edges, spark.createDataFrame([(start,), (start,)], "node string"), 5)
    assert {r.node: r.depth for r in got.collect()} == {n: k for n, k in want.items() if k <= 5}
    scans = got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    assert scans <= 4  # the edges of the last hop alone; levels are read as files
    for goal in sorted(want)[:4]:
        path = [r.node for r in graph.shortest_path(edges, start, goal, 6).orderBy("step").collect()]
        assert (len(path) - 1 == want[goal] and path[0] == start and path[-1] == goal) if want[goal] <= 6 else not path
        assert all((a, b) in pairs or (b, a) in pairs for a, b in zip(path, path[1:]))
    missing = graph.shortest_path(edges, start, "absent", 9)
    assert missing.columns == ["step", "node"] and missing.collect() == []


def test_components_and_common_neighbors(spark):
    pairs, edges = _random_graph(spark, 9, 70, 45)
    want = {}
    for a, b in pairs:
        for x in (a, b):
            want[x] = min(_depths(pairs, x))
    assert {r.node: r.component for r in graph.connected(edges).collect()} == want
    near = lambda x: {b if a == x else a for a, b in pairs if x in (a, b)}
    a, b = pairs[0]
    assert {r.node for r in graph.common_neighbors(edges, a, b).collect()} == near(a) & near(b)
    assert graph.connected(edges.limit(0)).collect() == []


def test_many_nearest_in_blocks(spark, monkeypatch):
    import random

    from noteloom.operators import pivots, search

    r = random.Random(1)
    rows = [(f"c{i:03d}", [float(r.randrange(3)) for _ in range(4)] if i % 9 else None) for i in range(120)]
    v = spark.createDataFrame(rows, "chunk_id string, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(i, e) for i, (_, e) in enumerate(rows) if i % 10 == 1], "qid long, embedding array<float>")
    monkeypatch.setattr(pivots, "QUERY_BLOCK", 5)
    for metric in ("l2", "cosine"):
        got = {}
        for x in search.knn_many(v, queries, 4, metric).collect():
            got.setdefault(x.qid, []).append((x.distance, x.chunk_id))
        for q in queries.collect():
            if q.embedding is None:
                assert q.qid not in got
                continue
            norm = lambda a: sum(x * x for x in a) ** 0.5
            far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b)) if metric == "l2" else 1 - (sum(x * y for x, y in zip(a, b)) / (norm(a) * norm(b)) if norm(a) * norm(b) else 0)
            want = sorted((round(far(q.embedding, e), 9), c) for c, e in rows if e)[:4]
            assert [(c, round(x, 6)) for x, c in sorted(got[q.qid])] == [(c, round(x, 6)) for x, c in want]
    assert search.knn_many(v, queries.limit(0), 4).collect() == []
