"""Notes: parsing, link resolution, tags and collection statistics, set at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions.text import body_tags, links, trimmed


def parse_notes(raw: DataFrame) -> DataFrame:
    """raw(note_id, vault, stem, body, fm_title, fm_tags) to notes with title, tags and links."""
    tags = F.array_sort(F.array_distinct(F.concat(body_tags(F.col("body")), F.coalesce(F.col("fm_tags"), F.array().cast("array<string>")))))
    return raw.select(
        "note_id", "vault", "stem",
        F.coalesce(F.nullif(F.col("fm_title"), F.lit("")), F.nullif(F.col("stem"), F.lit("")), F.lit("Untitled")).alias("title"),
        trimmed(F.col("body")).alias("text"), tags.alias("tags"), links(F.col("body")).alias("links"),
    )


def resolve_links(notes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(src, ord, dst): each link (by default of all notes, else of the notes ``of``) to the note whose title or stem equals it regardless of case; the least id wins."""
    wanted = (notes if of is None else of).select(F.col("note_id").alias("src"), F.posexplode("links").alias("ord", "link")).withColumn("key", F.lower("link"))
    keys = notes.select(F.explode(F.array(F.lower("title"), F.lower("stem"))).alias("key"), "note_id").groupBy("key").agg(F.min("note_id").alias("dst"))
    return wanted.join(keys, "key").select("src", "ord", "dst")


def names_of(notes: DataFrame) -> DataFrame:
    """(name): what links may call the notes, in lower case."""
    return notes.select(F.explode(F.array(F.lower("title"), F.lower("stem"))).alias("name")).filter("name is not null").distinct()


def linking_to(notes: DataFrame, names: DataFrame) -> DataFrame:
    """(note_id): notes with a link to one of ``names`` (name)."""
    return notes.select("note_id", F.explode("links").alias("link")).join(names, F.lower("link") == F.col("name"), "left_semi").select("note_id").distinct()


def backlinks(edges: DataFrame) -> DataFrame:
    """(note_id, backlinks, n): sorted sources of each target; self-links do not count."""
    return edges.filter("src <> dst").groupBy(F.col("dst").alias("note_id")).agg(F.array_sort(F.collect_set("src")).alias("backlinks")).withColumn("n", F.size("backlinks").cast("long"))


def note_tags(notes: DataFrame) -> DataFrame:
    return notes.select("note_id", F.explode("tags").alias("tag"))


def tag_counts(tags: DataFrame) -> DataFrame:
    """(tag, n), most frequent first, ties by name."""
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag")


def tag_hierarchy(tags: DataFrame) -> DataFrame:
    """(path, level, n): every tag counts at each prefix of its path."""
    parts = F.split("tag", "/")
    paths = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("path"), i.alias("level")))
    return tags.select(F.explode(paths).alias("p")).groupBy(F.col("p.path").alias("path"), F.col("p.level").alias("level")).agg(F.count(F.lit(1)).alias("n"))


def tag_neighbors(tags: DataFrame, note_id: Column) -> DataFrame:
    """(note_id, shared): other notes that share a tag with one note."""
    mine = tags.filter(F.col("note_id") == note_id).select("tag").distinct()
    return tags.filter(F.col("note_id") != note_id).join(mine, "tag").groupBy("note_id").agg(F.countDistinct("tag").alias("shared"))


def notes_by_tag(notes: DataFrame, tag: str) -> DataFrame:
    return notes.filter(F.array_contains("tags", tag)).select("note_id", "title")


def collection_stats(notes: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: notes, distinct tags, links, chunks."""
    n = notes.agg(F.countDistinct("note_id").alias("total_notes"), F.coalesce(F.sum(F.size("links")), F.lit(0)).cast("long").alias("total_links"))
    t = notes.select(F.explode("tags").alias("tag")).agg(F.countDistinct("tag").alias("total_tags"))
    return n.crossJoin(t).crossJoin(chunks.agg(F.count(F.lit(1)).alias("total_chunks")))  # one row each


def all_notes(notes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Notes with their chunk counts."""
    return notes.join(chunks.groupBy("note_id").agg(F.count(F.lit(1)).alias("chunk_count")), "note_id").select("note_id", "title", "chunk_count")


def resolve_note(notes: DataFrame, name: str) -> DataFrame:
    """At most one note: exact title, else exact stem, else part of the id; the least id wins."""
    rank = F.when(F.col("title") == name, 0).when(F.col("stem") == name, 1).when(F.col("note_id").contains(name), 2)
    return notes.withColumn("rank", rank).filter("rank is not null").orderBy("rank", "note_id").limit(1).select("note_id", "rank")


def read_note(notes: DataFrame, path: str, vaults: tuple[str, ...] = ("",)) -> DataFrame:
    """Notes at a path, as it is or under a vault."""
    return notes.filter(F.col("note_id").isin([path, *[f"{v.rstrip('/')}/{path}" for v in vaults if v]]))


def graph_metrics(edges: DataFrame) -> DataFrame:
    """(note_id, link_count, backlink_count, connectivity)."""
    both = edges.select(F.col("src").alias("note_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("note_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("note_id").agg(F.sum("o").alias("link_count"), F.sum("i").alias("backlink_count")).withColumn("connectivity", F.col("link_count") + F.col("backlink_count"))


def exists_in(candidates: DataFrame, notes: DataFrame) -> DataFrame:
    """Candidate titles that some note has, regardless of case."""
    return candidates.join(notes.select(F.lower("title").alias("key")), F.lower(candidates["title"]) == F.col("key"), "left_semi")


def most_linked(edges: DataFrame, n: int) -> DataFrame:
    """The ``n`` best connected notes."""
    return graph_metrics(edges).orderBy(F.desc("connectivity"), "note_id").limit(n)


def orphans(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """Notes at neither end of any edge."""
    ends = edges.select(F.col("src").alias("note_id")).union(edges.select("dst"))
    return notes.join(ends, "note_id", "left_anti")


def latest_per(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")
