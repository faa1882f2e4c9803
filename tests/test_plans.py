"""Expressions and declarative views."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from noteloom.plans import base
from noteloom.plans.expr import Compiler, ExpressionError, parse, schema_resolver

NOW = datetime(2024, 1, 20, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def note(spark):
    return spark.createDataFrame([("Test", "active", 5, ["a", "b"], "2024-01-15", {"rating": "4"}, None, 0)], "title string, status string, priority int, tags array<string>, created string, frontmatter map<string,string>, nothing string, zero int")


@pytest.mark.parametrize(
    ("expr", "expected"),
    [
        ("42", 42), ("-2.5", -2.5), ("'x'", "x"), ("true", True), ("null", None), ("title", "Test"), ("missing", None), ("rating", "4"),
        ("priority + 3 * 2", 11.0), ("10 - 4 - 3", 3.0), ("7 / 2", 3.5), ("1 / zero", None), ("(0 - 7) % 3", 2.0), ("'a' + 'b'", "ab"),
        ("priority >= 5 && status == 'active'", True), ("!title && zero", False), ("!(title && zero)", True), ("priority == 'x'", False), ("nothing == null", True), ("title != null", True),
        ("priority > 3 ? 'high' : 'low'", "high"), ("zero ? 1 : priority ? 2 : 3", 2),
        ("coalesce(nothing, title)", "Test"), ("clamp(priority, 6, 9)", 6.0), ("clamp(nothing, 1, 9)", 1.0), ("upper(title)", "TEST"), ("lower(nothing)", ""), ("trim('  x\t')", "x"),
        ("concat(title, '-', priority)", "Test-5"), ("contains(title, 'es')", True), ("contains(tags, 'a')", True), ("contains(tags, 'x')", False), ("regexMatch(title, '^T')", True), ("regexMatch(title, '[')", False),
        ("daysSince(created)", 5), ("daysSince('junk')", 0), ("date('%d.%m.%Y', created)", "15.01.2024"), ("date('%Y', 'junk')", ""), ("len(tags) + len(title)", 6.0), ("len(nothing)", 0),
    ],
)
def test_expressions(note, expr, expected):
    made = Compiler(schema_resolver(note.schema), NOW)(parse(expr)).column
    assert note.select(made.alias("v")).first().v == expected


@pytest.mark.parametrize("bad", ["", "1 +", "(1", "f(1)", "a ? b", "'a' + 1", "title > 3", "1 2", "a $ b", "clamp(1)"])
def test_bad_expressions(note, bad):
    with pytest.raises(ExpressionError):
        Compiler(schema_resolver(note.schema), NOW)(parse(bad))


def definition(**changes):
    d = {"id": "b", "name": "B", "version": 1, "source": {"folders": ["/"]}, "computed": [], "views": [{"id": "v", "name": "V", "type": "table", "columns": [{"id": "t", "header": "T", "source": "title"}]}]}
    return d | changes


@pytest.mark.parametrize(
    "changes",
    [
        {"id": "Not Good"}, {"version": 0}, {"name": ""}, {"source": {"folders": []}}, {"source": {"folders": ["../x"]}}, {"source": {"folders": ["/"], "filters": [{"property": "a", "op": "like"}]}}, {"views": []},
        {"computed": [{"id": "x", "expr": "(1", "type": "number"}]}, {"computed": [{"id": "x", "expr": "1", "type": "blob"}]},
        {"computed": [{"id": "x", "expr": "y", "type": "number"}, {"id": "y", "expr": "x", "type": "number"}]},
        {"views": [{"id": "v", "name": "V", "type": "table", "columns": [{"id": "t", "header": "T", "source": "@none"}]}]},
        {"views": [{"id": "v", "name": "V", "type": "table", "columns": [{"id": "t", "header": "T", "source": "x", "format": "progress", "min": 2, "max": 1}]}]},
        {"views": [{"id": "v", "name": "V", "type": "table"}]},
    ],
)
def test_bad_definitions(changes):
    with pytest.raises(base.BaseError):
        base.validate(definition(**changes))


def test_json_and_yaml():
    d = definition()
    assert base.load(json.dumps(d)) == d
    pytest.importorskip("yaml")
    assert base.load("id: b\nversion: 1") == {"id": "b", "version": 1}
    with pytest.raises(base.BaseError):
        base.load("- a list")


def test_computed_fields_follow_their_uses(spark):
    d = definition(computed=[{"id": "late", "expr": "early + 5", "type": "number"}, {"id": "early", "expr": "p * 6", "type": "number"}])
    d["views"][0]["columns"] = [{"id": "out", "header": "O", "source": "@late"}]
    rows = spark.createDataFrame([(5,), (None,)], "p int")
    got = [r.out for r in base.Plan(base.validate(d), rows, NOW).table().collect()]
    assert sorted(got) == [5.0, 35.0]


def test_sort_nulls_and_groups(spark):
    d = definition()
    d["views"][0] |= {"sort": [{"by": "t", "dir": "asc", "nulls": "first"}], "group": {"by": "s", "order": ["z"]}}
    rows = spark.createDataFrame([("b", "a"), (None, None), ("a", "z")], "title string, s string")
    plan = base.Plan(base.validate(d), rows, NOW)
    assert [r.t for r in plan.table().collect()] == [None, "a", "b"]
    assert [(r.group, r.n) for r in plan.groups().orderBy("place").collect()] == [("z", 1), ("None", 1), ("a", 1)]
    d["views"][0]["group"] = {"by": "missing"}
    assert [r.group for r in base.Plan(base.validate(d), rows, NOW).groups().collect()] == ["Unknown"]


def test_empty_table(spark):
    assert base.Plan(base.validate(definition()), spark.createDataFrame([], "title string"), NOW).table().collect() == []


def test_public_syntax(spark):
    made = base.public_definition("My Base", [{"property": "a", "op": "in", "value": ["x", "y"]}, {"property": "b", "op": "exists"}], ["Books"])
    assert made["id"] == "my-base"
    assert made["filters"]["and"] == ['a == "x" || a == "y"', "b != null", 'file.folder == "Books"']
    rows = spark.createDataFrame([("x", 1), ("z", 1), ("y", None)], "a string, b int")
    test = base.filter_tree({"and": made["filters"]["and"][:2]}, Compiler(schema_resolver(rows.schema), NOW))
    assert [r.a for r in rows.filter(test).collect()] == ["x"]


def test_merging_and_graph_fields():
    assert base.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    d = base.with_graph_fields(definition())
    assert [c["id"] for c in d["computed"]] == ["link-count", "backlink-count", "connectivity-score", "has-tags"]
    assert base.with_graph_fields(d) == d
    base.validate(d)
    assert base.info(base.validate(d))["computed"] == 4


def test_filter_pushdown(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("title"), F.col("id").alias("other")).write.parquet(str(tmp_path / "t"))
    d = definition(source={"folders": ["/"], "filters": [{"property": "title", "op": "gt", "value": 5}]})
    plan = base.Plan(base.validate(d), spark.read.parquet(str(tmp_path / "t")), NOW).table()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(title,5)" in plan
    assert "other" not in plan.split("ReadSchema")[1]


def test_quoted_values_survive_public_filters():
    from noteloom.plans import base as bases

    assert bases.quoted("x\\y") == '"x\\y"' and bases.quoted('a"b') == "'a\"b'" and bases.quoted(3) == "3"
    both = bases.quoted("a\"b'c")
    assert parse(both).value == "concat" and "".join(a.value for a in parse(both).args) == "a\"b'c"
    assert bases.method_calls('title == "a.contains(b" && tags.contains("x")') == 'title == "a.contains(b" && contains(tags, "x")'


def test_chunks_are_made_once(spark):
    """Contexts come from windows over the chunks, not from a second making of them that is joined."""
    from noteloom.operators import sections, structure
    from noteloom.plans import index

    notes = spark.createDataFrame([("a", "# H\nsome words\n# I\nmore words here")], "note_id string, text string")
    once = structure.with_importance(sections.chunk_notes(notes))
    explodes = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Generate ")
    assert explodes(index.chunked(notes)) == explodes(once)


def test_sections_are_replaced_in_slices(spark):
    """Texts are changed a few at a time, whatever the batch holds."""
    from noteloom.operators import mutations

    rows = [(str(k), None if k % 7 == 0 else f"## A\nold {k}\n## B\nx" if k % 2 else "none") for k in range(3 * mutations.TEXTS + 5)]
    notes = spark.createDataFrame(rows, "note_id string, text string").coalesce(1)
    made = mutations.replace_sections(notes, "a", "new")
    assert "Pandas" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {r.note_id: r.text for r in made.collect()}
    assert got == {i: t if not t or t == "none" else "## A\n\nnew\n\n## B\nx" for i, t in rows}


def test_components_exchange_numbers(spark, monkeypatch):
    """Names meet the edges once; rounds hold numbers in the order of the names."""
    from noteloom.operators import graph

    kept, kinds = graph.written, {}
    monkeypatch.setattr(graph, "written", lambda df, name: kinds.setdefault(name, df.dtypes) and kept(df, name))
    edges = spark.createDataFrame([("b", "c"), ("d", "c"), ("x", "y"), ("z", "z"), ("y", "a")], "src string, dst string")
    assert {tuple(r) for r in graph.connected(edges).collect()} == {("b", "b"), ("c", "b"), ("d", "b"), ("a", "a"), ("x", "a"), ("y", "a"), ("z", "z")}
    assert all(t == "bigint" for name in ("stars", "least", "large", "low") for _, t in kinds[name])
