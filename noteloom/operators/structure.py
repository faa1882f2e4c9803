"""Structure of chunk sequences: neighbours, header trees, importance, context; windows and equi-joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions.scoring import importance

#: Order in which a chunk's neighbours are listed.
RELATIONS = ("sequential_next", "sequential_prev", "parent", "child", "sibling")
SIBLING = "sibling"
LEVELS = 6


def _by_note():
    return Window.partitionBy("note_id").orderBy("seq")


def sequential_edges(chunks: DataFrame) -> DataFrame:
    """(src, dst, rel) to the next and the previous chunk of the note."""
    near = chunks.select("chunk_id", F.lead("chunk_id").over(_by_note()).alias("sequential_next"), F.lag("chunk_id").over(_by_note()).alias("sequential_prev"))
    return near.unpivot("chunk_id", ["sequential_next", "sequential_prev"], "rel", "dst").filter("dst is not null").select(F.col("chunk_id").alias("src"), "dst", "rel")


def with_parent(chunks: DataFrame) -> DataFrame:
    """Adds parent_seq, parent_id and parent_level: the nearest earlier chunk of a lesser header level (1 to 6)."""
    before = _by_note().rowsBetween(Window.unboundedPreceding, -1)
    last = [F.when(F.col("header_level") > k, F.last(F.when(F.col("header_level") == k, F.struct("seq", "chunk_id", "header_level")), ignorenulls=True).over(before)) for k in range(1, LEVELS)]
    return chunks.withColumn("__p", F.greatest(*last)).withColumn("parent_seq", F.col("__p.seq")).withColumn("parent_id", F.col("__p.chunk_id")).withColumn("parent_level", F.col("__p.header_level")).drop("__p")


def parent_edges(chunks: DataFrame) -> DataFrame:
    return with_parent(chunks).filter("parent_id is not null").select(F.col("chunk_id").alias("src"), F.col("parent_id").alias("dst"), F.lit("parent").alias("rel"))


def child_edges(chunks: DataFrame) -> DataFrame:
    """From a parent to the chunks exactly one level below it, up to the next chunk of its own level or less."""
    p = with_parent(chunks).filter("header_level = parent_level + 1")
    return p.select(F.col("parent_id").alias("src"), F.col("chunk_id").alias("dst"), F.lit("child").alias("rel"))


def _class_name():
    return F.concat_ws("|", F.lit(SIBLING), F.col("header_level").cast("string"), F.coalesce("parent_id", F.lit("")), "note_id")


def sibling_classes(chunks: DataFrame) -> DataFrame:
    """(class, chunk_id, note_id, header_level, parent_id, seq): chunks of one note with equal level and parent, a row each.

    The class is named after its parent and level, so it has no member's name.
    """
    p = with_parent(chunks).filter("header_level is not null")
    return p.select(_class_name().alias("class"), "chunk_id", "note_id", "header_level", "parent_id", "seq")


def sibling_edges(chunks: DataFrame) -> DataFrame:
    """Between chunks of one note with equal level and parent: all pairs, for small tables; ``sibling_classes`` says the same in a row for each chunk."""
    p = with_parent(chunks).filter("header_level is not null").select("note_id", "header_level", F.coalesce("parent_id", F.lit("")).alias("p"), "chunk_id")
    a, b = p.withColumnRenamed("chunk_id", "src"), p.withColumnRenamed("chunk_id", "dst")
    return a.join(b, ["note_id", "header_level", "p"]).filter("src <> dst").select("src", "dst", F.lit("sibling").alias("rel"))


def chunk_edges(chunks: DataFrame) -> DataFrame:
    """(src, dst, rel, ord): all relations, with the place of the relation in a chunk's list of neighbours; a few rows for each chunk.

    Siblings are not listed pair by pair: a row of relation ``sibling`` leads from a
    chunk to the class (``sibling_classes``) that it shares with its siblings.  ``graph.steps`` reads both kinds.
    """
    w = _by_note()
    rows = with_parent(chunks.select("chunk_id", "note_id", "seq", "header_level").withColumn("sequential_next", F.lead("chunk_id").over(w)).withColumn("sequential_prev", F.lag("chunk_id").over(w)))
    rows = rows.withColumn("class", F.when(F.col("header_level").isNotNull(), _class_name()))
    edge = lambda src, dst, rel: F.struct(src.alias("src"), F.col(dst).alias("dst"), F.lit(rel).alias("rel"))
    here = F.col("chunk_id")
    own = F.array(
        edge(here, "sequential_next", "sequential_next"), edge(here, "sequential_prev", "sequential_prev"), edge(here, "parent_id", "parent"),
        edge(F.when(F.col("header_level") == F.col("parent_level") + 1, F.col("parent_id")), "chunk_id", "child"), edge(here, "class", "sibling"),
    )
    every = rows.select(F.explode(F.filter(own, lambda e: e["src"].isNotNull() & e["dst"].isNotNull())).alias("e")).select("e.src", "e.dst", "e.rel")
    return every.withColumn("ord", F.array_position(F.array(*[F.lit(r) for r in RELATIONS]), F.col("rel")).cast("int"))


def header_path(chunks: DataFrame) -> DataFrame:
    """(chunk_id, path): headers above a chunk from the top, ' > ' between them.

    The last header of each lesser level counts if no header of a lesser level came after it.
    """
    before = _by_note().rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.col("header_level") == k, F.struct("seq", "header_text")), ignorenulls=True).over(before) for k in range(1, LEVELS)}
    df = chunks.select("chunk_id", "header_level", *[c.alias(f"h{k}") for k, c in last.items()])
    steps = []
    for k in range(1, LEVELS):
        ok = (F.col("header_level") > k) & F.col(f"h{k}").isNotNull()
        for j in range(1, k):
            ok = ok & (F.coalesce(F.col(f"h{j}.seq"), F.lit(-1)) < F.col(f"h{k}.seq"))
        steps.append(F.when(ok, F.col(f"h{k}.header_text")))
    return df.select("chunk_id", F.concat_ws(" > ", *steps).alias("path"))


def with_importance(chunks: DataFrame) -> DataFrame:
    """Adds importance_score from place, level, type, links, tags and length."""
    total = F.count(F.lit(1)).over(Window.partitionBy("note_id"))
    place = F.row_number().over(_by_note()) - 1
    score = importance(F.col("header_level"), place, total, F.col("chunk_type"), F.size("contains_links"), F.size("contains_tags"), F.length("content"))
    return chunks.withColumn("importance_score", score)


def with_context(chunks: DataFrame) -> DataFrame:
    """Adds preceding_context and following_context: neighbour's type and first hundred characters."""
    say = F.concat(F.col("chunk_type"), F.lit(": "), F.substring("content", 1, 100), F.lit("..."))
    return chunks.select("*", F.lag(say).over(_by_note()).alias("preceding_context"), F.lead(say).over(_by_note()).alias("following_context"))


def context_links(chunks: DataFrame) -> DataFrame:
    """(chunk_id, preceding_context, following_context) of ``with_context``."""
    return with_context(chunks).select("chunk_id", "preceding_context", "following_context")


def note_chunks(chunks: DataFrame) -> DataFrame:
    """(chunk_id, others): number of other chunks of the note."""
    return chunks.select("chunk_id", (F.count(F.lit(1)).over(Window.partitionBy("note_id")) - 1).alias("others"))
