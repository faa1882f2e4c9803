"""Scores as Columns: vectors, relations, importance, confidence, evaluation, recommendations."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from noteloom.functions.text import word_set
from noteloom.schema import CONFIDENCE_THRESHOLD, DEPTH_DECAY, OTHER_WEIGHT, RELATION_WEIGHTS, TYPE_BONUS


def l2_squared(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def relation_weight(relation: Column, depth: Column) -> Column:
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in RELATION_WEIGHTS.items()))
    return F.coalesce(F.try_element_at(table, relation), F.lit(OTHER_WEIGHT)) * F.pow(F.lit(DEPTH_DECAY), depth)


def importance(level: Column, place: Column, total: Column, kind: Column, n_links: Column, n_tags: Column, length: Column) -> Column:
    """Importance of chunk number ``place`` (from 0) of ``total``, clamped to 0..1."""
    ratio = place / F.greatest(total - 1, F.lit(1))
    bonus = F.lit(0.0)
    for name, v in TYPE_BONUS.items():
        bonus = F.when(kind == name, v).otherwise(bonus)
    score = (
        F.lit(0.5)
        + F.when(F.coalesce(level, F.lit(0)) > 0, (7 - level) * 0.1).otherwise(0.0)
        + F.when((ratio < 0.2) | (ratio > 0.8), 0.1).otherwise(0.0)
        + bonus
        + F.least(n_links * 0.05, F.lit(0.2))
        + F.least(n_tags * 0.03, F.lit(0.15))
        + F.when(length.between(200, 1000), 0.05).when(length < 100, -0.1).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def clamp01(c: Column) -> Column:
    """Null stays null (greatest and least would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def confidence(mean_distance: Column, completeness: Column, answer: Column, citations: Column) -> Column:
    """Mean of the signals that are there, 0.05 more from two citations on; none gives 0."""
    parts = F.filter(F.array(clamp01(1 - mean_distance), F.when(completeness > 0, clamp01(completeness)), F.when(answer > 0, clamp01(answer))), lambda x: x.isNotNull())
    mean = F.when(F.size(parts) == 0, 0.0).otherwise(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(parts), F.lit(1)))
    return clamp01(mean + F.when(citations >= 2, 0.05).otherwise(0.0))


def search_status(n_hits: Column, score: Column, fallback: Column) -> tuple[Column, Column]:
    """(confidence after the penalty for fallback embeddings, ok or degraded)."""
    c = F.when(fallback, F.greatest(F.lit(0.0), score - 0.1)).otherwise(score)
    return c, F.when((n_hits == 0) | (c < CONFIDENCE_THRESHOLD), "degraded").otherwise("ok")


def recommendations(mean_distance: Column, intent: Column, expansion_depth: Column, breaker: Column) -> Column:
    """Up to three codes of advice for a degraded answer."""
    rules = F.array(
        F.lit("rephrase_question"),
        F.when(F.coalesce(mean_distance, F.lit(1.0)) > 0.55, "add_entities"),
        F.when(intent.isin("categorical", "graph"), "narrow_with_tag"),
        F.when(expansion_depth < 1, "increase_k"),
        F.when(breaker.isin("open", "half_open"), "check_index_health"),
    )
    return F.slice(F.filter(rules, lambda x: x.isNotNull()), 1, 3)


def expansion_score(distance: Column, importance_score: Column, kind: Column, n_links: Column, header: Column, query: str) -> Column:
    """Worth of a hit as a source of expansion."""
    terms = [t for t in query.lower().split()]
    named = F.lit(False)
    for t in terms:
        named = named | F.lower(F.coalesce(header, F.lit(""))).contains(t)
    return (
        1 - distance
        + F.when(importance_score > 0.7, 0.1).otherwise(0.0)
        + F.when(kind.isin("section", "header"), 0.05).otherwise(0.0)
        + F.least(n_links * 0.02, F.lit(0.1))
        + F.when(named, 0.08).otherwise(0.0)
    )


# What two chunks have in common, and its weight.
SIMILARITY = {"note_id": 0.5, "chunk_type": 0.2, "header_text": 0.1}


def chunk_similarity(a: Column, b: Column) -> Column:
    """Of two chunk structs: same note, type and header; nulls and empty texts are not the same as anything."""
    return sum((F.when((a[f] != "") & (a[f] == b[f]), w).otherwise(0.0) for f, w in SIMILARITY.items()), F.lit(0.0))


def row_similarity(a: dict, b: dict) -> float:
    """The same of two rows in Python, where selection is sequential."""
    return sum(w for f, w in SIMILARITY.items() if a[f] and a[f] == b[f])


def word_f1(predicted: Column, expected: Column) -> Column:
    p, e = word_set(predicted), word_set(expected)
    both = F.size(F.array_intersect(p, e))
    return F.coalesce(F.try_divide(2.0 * both, F.size(p) + F.size(e)), F.lit(0.0))


def f1_with_context(predicted: Column, expected: Column, question: Column, context: Column) -> Column:
    """Word F1, and up to 0.2 for the share of the question's words in the context; at most 1."""
    q, c = word_set(question), word_set(context)
    bonus = F.coalesce(F.least(F.try_divide(F.size(F.array_intersect(q, c)), F.size(q)) * 0.2, F.lit(0.2)), F.lit(0.0))
    return F.least(word_f1(predicted, expected) + bonus, F.lit(1.0))


def word_jaccard(a: Column, b: Column) -> Column:
    x, y = word_set(a), word_set(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y))), F.lit(0.0))


def completeness(answer: Column) -> Column:
    """Words over fifty, 0.2 more with structure marks; at most 1."""
    n = F.size(F.filter(F.split(answer, r"\s+"), lambda x: x != ""))
    marks = answer.rlike(r"[.:\-*]")
    return F.when(F.coalesce(F.length(answer), F.lit(0)) == 0, 0.0).otherwise(F.least(F.least(n / 50, F.lit(1.0)) + F.when(marks, 0.2).otherwise(0.0), F.lit(1.0)))


def citation_quality(citations: Column) -> Column:
    """Share of citation strings longer than ten characters."""
    return F.coalesce(F.try_divide(F.size(F.filter(citations, lambda x: F.length(x) > 10)).cast("double"), F.size(citations)), F.lit(0.0))


def composite(semantic: Column, citation: Column, relevance: Column, complete: Column) -> Column:
    return semantic * 0.4 + citation * 0.2 + relevance * 0.2 + complete * 0.2
