"""Evaluation questions made from the collection itself: five kinds, each phrased in one of four ways."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.functions.text import capitalised_phrases

# Kinds with their expected intent, ideal answer and phrasings; {0} and {1} are what a question is about.
KINDS = {
    "header": ("semantic", "Information about {0}", ("What is {0}?", "Tell me about {0}", "Explain {0}", "What does the section on {0} cover?")),
    "link": ("graph", "Relationship between {0} and {1}", ("How is {0} related to {1}?", "What is the connection between {0} and {1}?", "Show me the relationship between {0} and {1}", "What links {0} to {1}?")),
    "tag": ("categorical", "Notes and content tagged with {0}", ("What notes are tagged with #{0}?", "Show me everything tagged #{0}", "Find notes with tag {0}", "What content is categorized as {0}?")),
    "concept": ("semantic", "Definition and explanation of {0}", ("What is {0}?", "Define {0}", "Explain the concept of {0}", "Tell me about {0}")),
    "factual": ("specific", "Specific information from {0}", ("What specific information is in {0}?", "What are the key points from {0}?", "Summarize the main ideas in {0}", "What details does {0} provide?")),
}
#: Capitalised words that are no concepts.
NO_CONCEPTS = ("The", "This", "That", "With", "From")


def _filled(pattern: str, about: list[Column]) -> Column:
    parts: list[Column] = []
    for piece in pattern.replace("{", "\0{").replace("}", "}\0").split("\0"):
        parts.append(about[int(piece[1:-1])] if piece.startswith("{") else F.lit(piece))
    return F.concat(*parts)


def phrased(rows: DataFrame, kind: str, key: Column, about: list[Column], chunk: Column) -> DataFrame:
    """(kind, key, question, ideal_answer, expected_intent, chunk_id): a question per row; the phrasing follows from the key, so a rerun asks the same."""
    intent, ideal, ways = KINDS[kind]
    said = [F.lower(about[0]), *about[1:]] if kind == "header" else about
    way = F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(len(ways))).cast("int")
    question = F.element_at(F.array(*[_filled(w, said) for w in ways]), way + 1)
    return rows.select(F.lit(kind).alias("kind"), key.cast("string").alias("key"), question.alias("question"), _filled(ideal, about).alias("ideal_answer"), F.lit(intent).alias("expected_intent"), chunk.alias("chunk_id"))


def examples(chunks: DataFrame, notes: DataFrame, edges: DataFrame, tags: DataFrame, per_kind: int = 10, kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """Up to ``per_kind`` questions of each kind: about headers of chunks, linked notes, tags, concepts in texts, and notes.

    chunks (chunk_id, note_id, header_text, content), notes (note_id, title), edges (src, dst), tags (note_id, tag).
    Of each kind the least keys are taken; the expected chunk is the least of its note's, or none.
    """
    first = chunks.groupBy("note_id").agg(F.min("chunk_id").alias("chunk_id"))
    few = lambda df, *by: df.orderBy(*by).limit(per_kind)
    named = notes.select("note_id", "title")
    col = F.col

    def header() -> DataFrame:
        rows = few(chunks.filter(F.coalesce("header_text", F.lit("")) != "").select("chunk_id", "header_text"), "chunk_id")
        return phrased(rows, "header", col("chunk_id"), [col("header_text")], col("chunk_id"))

    def link() -> DataFrame:
        rows = few(edges.filter("src <> dst").select("src", "dst").distinct(), "src", "dst")
        rows = rows.join(named.select(col("note_id").alias("src"), col("title").alias("a")), "src").join(named.select(col("note_id").alias("dst"), col("title").alias("b")), "dst")
        return phrased(rows.join(first.withColumnRenamed("note_id", "src"), "src", "left"), "link", F.concat_ws(">", "src", "dst"), [col("a"), col("b")], col("chunk_id"))

    def tag() -> DataFrame:
        rows = few(tags.groupBy("tag").agg(F.min("note_id").alias("note_id")), "tag").join(first, "note_id", "left")
        return phrased(rows, "tag", col("tag"), [col("tag")], col("chunk_id"))

    def concept() -> DataFrame:
        named_in = F.explode(capitalised_phrases(F.coalesce("content", F.lit("")), NO_CONCEPTS)).alias("concept")
        rows = few(chunks.select("chunk_id", named_in).groupBy("concept").agg(F.min("chunk_id").alias("chunk_id")), "concept")
        return phrased(rows, "concept", col("concept"), [col("concept")], col("chunk_id"))

    def factual() -> DataFrame:
        rows = few(named.filter(F.coalesce("title", F.lit("")) != ""), "note_id").join(first, "note_id", "left")
        return phrased(rows, "factual", col("note_id"), [col("title")], col("chunk_id"))

    of = {"header": header, "link": link, "tag": tag, "concept": concept, "factual": factual}
    return reduce(DataFrame.unionByName, [of[k]() for k in kinds])
