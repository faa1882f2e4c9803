"""Scalar functions against values worked out by hand."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from noteloom.functions import intent, scoring, text, timerange

NOW = datetime(2024, 5, 22, 15, 30, tzinfo=timezone.utc)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("a", "b", "expected"), [("health", "health", 0.5), ("", "", 0.0), ("a", "a", 1.0), ("a", "b", 0.0), ("a", "ab", 0.0)])
def test_fuzzy_string(spark, a, b, expected):
    assert value(spark, text.fuzzy_string(F.lit(a), F.lit(b))) == pytest.approx(expected)


def test_fuzzy_string_of_variants(spark):
    assert value(spark, text.fuzzy_string(F.lit("planet"), F.lit("planets"))) >= 0.2
    assert value(spark, text.fuzzy_string(F.lit(None).cast("string"), F.lit("x"))) == 0.0


@pytest.mark.parametrize(("entity", "tags", "expected"), [("health", ["para/area/health"], 0.9), ("planets", ["planets"], 1.0), ("plan", ["topic/planets"], 0.8), ("x", [], 0.0)])
def test_tag_relevance(spark, entity, tags, expected):
    column = F.array(*[F.lit(t) for t in tags]).cast("array<string>")
    assert value(spark, text.tag_relevance([entity], column)) == pytest.approx(expected)


@pytest.mark.parametrize(("relation", "depth", "expected"), [("parent", 0, 0.9), ("child", 1, 0.56), ("sibling", 2, 0.384), ("other", 0, 0.5), ("sequential_next", 5, 0.8 * 0.8**5)])
def test_relation_weight(spark, relation, depth, expected):
    assert value(spark, scoring.relation_weight(F.lit(relation), F.lit(depth))) == pytest.approx(expected)


def test_confidence(spark):
    none = F.lit(None).cast("double")
    assert value(spark, scoring.confidence(F.lit(0.3), none, none, F.lit(0))) == pytest.approx(0.7)
    assert value(spark, scoring.confidence(F.lit(0.3), F.lit(0.6), F.lit(0.7), F.lit(2))) == pytest.approx((0.7 + 0.6 + 0.7) / 3 + 0.05)
    assert value(spark, scoring.confidence(none, none, none, F.lit(0))) == 0.0


@pytest.mark.parametrize(
    ("question", "kind", "strategy"),
    [
        ("Show me notes tagged with planets", "categorical", "tag"),
        ("What links to Mars?", "relationship", "graph"),
        ("explain the concept", "semantic", "vector"),
        ("earth details", "semantic", "vector"),
        ("explain #mars", "categorical", "hybrid"),
    ],
)
def test_intent(spark, question, kind, strategy):
    made = intent.intent(F.lit(question))
    assert value(spark, made["intent_type"]) == kind
    assert value(spark, made["strategy"]) == strategy


def test_tag_entities(spark):
    assert value(spark, intent.tag_entities(F.lit("#mars and tag: earth"))) == ["mars", "earth"]


def test_complexity(spark):
    assert value(spark, intent.complexity(F.lit("how does A relate"))) == "complex"
    assert value(spark, intent.complexity(F.lit("define it"))) == "simple"
    assert value(spark, intent.complexity(F.lit("what? and then?"))) == "complex"


@pytest.mark.parametrize(
    ("phrase", "start", "end", "mode"),
    [
        ("last 3 days", datetime(2024, 5, 19, 15, 30), datetime(2024, 5, 22, 15, 30), "modified"),
        ("in the last 3 days", datetime(2024, 5, 19, 15, 30), datetime(2024, 5, 22, 15, 30), "modified"),
        ("created last week", datetime(2024, 5, 13), datetime(2024, 5, 20), "created"),
        ("last 2 weeks", datetime(2024, 5, 8, 15, 30), datetime(2024, 5, 22, 15, 30), "modified"),
        ("yesterday", datetime(2024, 5, 21), datetime(2024, 5, 22), "modified"),
        ("last year", datetime(2023, 1, 1), datetime(2024, 1, 1), "modified"),
        ("2024-02-03", datetime(2024, 2, 3), datetime(2024, 2, 4), "modified"),
        ("since 2024-01-01", datetime(2024, 1, 1), None, "modified"),
    ],
)
def test_time_ranges(phrase, start, end, mode):
    r = timerange.parse_range(phrase, NOW)
    plain = lambda t: t and t.replace(tzinfo=None)
    assert (plain(r.start), plain(r.end), r.mode) == (start, end, mode)


def test_time_range_without_meaning():
    assert timerange.parse_range("created", NOW) is None
    assert timerange.parse_range("whenever", NOW) is None
    assert timerange.parse_range(None, NOW) is None


def test_structured_ranges():
    assert timerange.structured_range({"last": 1, "unit": "month"}, datetime(2024, 3, 31)).start == datetime(2024, 2, 29, tzinfo=timezone.utc)
    for bad in ({}, {"last": 0, "unit": "day"}, {"last": 1, "unit": "eon"}, {"start": "2024-02-01", "end": "2024-01-01"}, {"start": "2024-01-01", "mode": "x"}):
        with pytest.raises(ValueError):
            timerange.structured_range(bad, NOW)


def test_timestamps(spark):
    read = lambda s: value(spark, timerange.timestamp_of(F.lit(s)))
    assert read("2024-01-02") == datetime(2024, 1, 2)
    assert read("2024-01-02T03:04:05Z") == datetime(2024, 1, 2, 3, 4, 5)
    assert read("1704164645") == datetime(2024, 1, 2, 3, 4, 5)
    assert read("no date") is None


@pytest.mark.parametrize(
    ("vault", "path", "header", "expected"),
    [
        ("/v/my vault", "/v/my vault/a b/c.md", "Complex Header #123!", "vault=my%20vault&file=a%20b/c.md#Complex%20Header%20%23123%21"),
        ("C:\\vaults\\mine", "C:\\vaults\\mine\\x\\y", "", "vault=mine&file=x/y.md"),
        ("mine", "note", None, "vault=mine&file=note.md"),
    ],
)
def test_chunk_uri(spark, vault, path, header, expected):
    made = text.chunk_uri(F.lit(vault), F.lit(path), F.lit(header).cast("string"), ("/v/my vault", "C:\\vaults\\mine"))
    assert value(spark, made) == "obsidian://open?" + expected


def test_cleaners(spark):
    assert value(spark, text.parse_delimited(F.lit(" a, ,b ,\t"))) == ["a", "b"]
    assert value(spark, text.parse_delimited(F.lit(None).cast("string"))) == []
    assert value(spark, text.header_context(F.lit('["A","B"]'))) == ["A", "B"]
    assert value(spark, text.header_context(F.lit("A > B"))) == ["A", "B"]
    assert value(spark, text.cleaned_items(F.lit("1. **Graph theory**.\n- tiny\n* Second thing!"), 5)) == ["Graph theory", "Second thing"]
    assert value(spark, text.split_tags(F.lit("'#a', b\n\"c\""))) == ["a", "b", "c"]
    assert value(spark, text.first_score(F.lit("score: 0.75 of 1"))) == pytest.approx(0.75)
    assert value(spark, text.first_score(F.lit("none"))) == 0.5
    assert value(spark, text.slug(F.lit("My Note_1!"))) == "my-note-1"
    assert value(spark, text.links(F.lit("[[A|b]] [[C#d]] [[E]]"))) == ["A", "C", "E"]
    assert value(spark, text.preview(F.lit("x" * 201))) == "x" * 200 + "..."
    assert value(spark, text.capitalised_phrases(F.lit("Old Town and Bob met Jane Doe"))) == ["Jane Doe", "Old Town"]


def test_recommendations(spark):
    made = scoring.recommendations(F.lit(0.9), F.lit("categorical"), F.lit(0), F.lit("open"))
    assert value(spark, made) == ["rephrase_question", "add_entities", "narrow_with_tag"]
    assert value(spark, scoring.recommendations(F.lit(0.1), F.lit("semantic"), F.lit(2), F.lit("open"))) == ["rephrase_question", "check_index_health"]
