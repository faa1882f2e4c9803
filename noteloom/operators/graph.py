"""Traversal of note and chunk graphs by frontier joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.operators.structure import RELATIONS, SIBLING
from noteloom.tables import discard, written

CONTENT_LINK = "content_link"


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def neighbors(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth): nodes within ``depth`` steps of the seeds (node), either direction, at their least depth; seeds at 0.

    Levels but the last are written, so each hop reads the edges once and expands
    only nodes that are new; it ends where there are none.
    """
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    level = _kept(seeds.select("node").distinct(), depth > 1)
    reached = level.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        step = both.join(level.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        level = _kept(step.join(reached.select("node"), "node", "left_anti"), d < depth)
        if d < depth and level.isEmpty():
            break
        reached = reached.unionByName(level.withColumn("depth", F.lit(d)))
    return reached


def _kept(level: DataFrame, again: bool) -> DataFrame:
    """A level of a traversal, written if another hop reads it."""
    return written(level, "level") if again else level


def subgraph_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Directed edges with both ends among ``nodes`` (node)."""
    inside = nodes.select("node")
    return edges.join(inside.withColumnRenamed("node", "src"), "src", "left_semi").join(inside.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def subgraph_stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: node_count, edge_count."""
    n = nodes.agg(F.countDistinct("node").alias("node_count"))
    return n.crossJoin(subgraph_edges(edges, nodes).agg(F.count(F.lit(1)).alias("edge_count")))  # one row each


def steps(edges: DataFrame, sources: DataFrame | None = None, per_class: int | None = None) -> DataFrame:
    """(src, dst, rel, ord): the relations of some chunks (src) or all, siblings spelled out; with ``per_class`` the first so many of each (by id).

    What is listed grows with the siblings of the chunks asked for, never with all pairs of a note.
    """
    own = edges if sources is None else edges.join(sources.select("src").distinct(), "src", "left_semi")
    shared = F.col("rel") == SIBLING
    members = edges.filter(shared).select(F.col("dst").alias("class"), F.col("src").alias("member"))
    if per_class is not None:  # one more, because a chunk is not its own sibling
        first = F.row_number().over(Window.partitionBy("class").orderBy("member"))
        members = members.withColumn("n", first).filter(F.col("n") <= per_class + 1).drop("n")
    siblings = own.filter(shared).select("src", F.col("dst").alias("class"), "rel", "ord").join(members, "class").filter("src <> member")
    return own.filter(~shared).select("src", "dst", "rel", "ord").unionByName(siblings.select("src", F.col("member").alias("dst"), "rel", "ord"))


def onward(edges: DataFrame, frontier: DataFrame, *best: Column) -> DataFrame:
    """(dst, rel, ord, and the columns of ``frontier``): where the chunks of ``frontier`` (src) lead, themselves included.

    A class of siblings is entered once, from the member that comes first by ``best``
    (then by id), so a flat note costs as many rows as it has chunks.
    """
    shared = F.col("rel") == SIBLING
    own = edges.join(frontier, "src")
    first = F.row_number().over(Window.partitionBy("dst").orderBy(*best, "src"))
    entered = own.filter(shared).withColumn("n", first).filter("n = 1").drop("n").withColumnRenamed("dst", "class")
    members = edges.filter(shared).select(F.col("dst").alias("class"), F.col("src").alias("dst"))
    return own.filter(~shared).unionByName(entered.join(members, "class").drop("class"))


def content_links(starts: DataFrame, chunks: DataFrame, notes: DataFrame, links: int = 3, per_note: int = 2) -> DataFrame:
    """(src, dst, rel, ord): from each start (chunk_id) to the first chunks of the first notes that its text links to.

    Links are resolved by title or stem, regardless of case, the least note id wins; only the linked notes' chunks are read.
    """
    named = chunks.join(starts.select("chunk_id").distinct(), "chunk_id", "left_semi").select(F.col("chunk_id").alias("src"), F.posexplode(F.slice("contains_links", 1, links)).alias("place", "link"))
    keys = notes.select(F.explode(F.array(F.lower("title"), F.lower("stem"))).alias("key"), "note_id").groupBy("key").agg(F.min("note_id").alias("note_id"))
    linked = named.join(keys, F.lower("link") == F.col("key")).select("src", "note_id").distinct()
    first = F.row_number().over(Window.partitionBy("note_id").orderBy("seq", "chunk_id"))
    heads = chunks.join(linked.select("note_id").distinct(), "note_id", "left_semi").select("note_id", F.col("chunk_id").alias("dst"), first.alias("n")).filter(F.col("n") <= per_note)
    return linked.join(heads, "note_id").filter("src <> dst").select("src", "dst", F.lit(CONTENT_LINK).alias("rel"), F.lit(len(RELATIONS) + 1).alias("ord"))


def chunk_neighbors(edges: DataFrame, chunks: DataFrame, sources: DataFrame | None = None, per_class: int | None = None) -> DataFrame:
    """Neighbours with their type, header and importance (0.5 where unknown), in listing order."""
    e = steps(edges, None if sources is None else sources.select(F.col("chunk_id").alias("src")), per_class)
    info = chunks.select(F.col("chunk_id").alias("dst"), "chunk_type", "header_text", "importance_score")
    joined = e.join(info, "dst", "left")
    return joined.select("src", "dst", "rel", "ord", F.coalesce("chunk_type", F.lit("")).alias("chunk_type"), F.coalesce("header_text", F.lit("")).alias("header_text"), F.coalesce("importance_score", F.lit(0.5)).alias("importance_score"))


def first_neighbors(listed: DataFrame, n: int) -> DataFrame:
    """The first ``n`` neighbours of each source in listing order."""
    return listed.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy("ord", "dst"))).filter(F.col("place") <= n)


def traverse(edges: DataFrame, start: DataFrame, depth: int, linked: DataFrame | None = None) -> DataFrame:
    """(chunk_id, depth, rel, via): first discovery of each chunk from the start chunks, by relation order, then source, on ties.

    ``linked`` (as from ``content_links``) holds relations that count from the start chunks only: links out of their notes.
    """
    seen = _kept(start.select("chunk_id", F.lit(0).alias("depth"), F.lit("start").alias("rel"), F.lit(None).cast("string").alias("via")), depth > 1)
    frontier = seen
    for d in range(1, depth + 1):
        step = onward(edges, frontier.select(F.col("chunk_id").alias("src"))).select("src", "dst", "rel", "ord")
        if linked is not None and d == 1:
            step = step.unionByName(linked.join(start.select(F.col("chunk_id").alias("src")), "src", "left_semi").select("src", "dst", "rel", "ord"))
        step = step.join(seen.select(F.col("chunk_id").alias("dst")), "dst", "left_anti")
        first = F.row_number().over(Window.partitionBy("dst").orderBy("ord", "src"))
        frontier = _kept(step.withColumn("n", first).filter("n = 1").select(F.col("dst").alias("chunk_id"), F.lit(d).alias("depth"), "rel", F.col("src").alias("via")), d < depth)
        if d < depth and frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def traverse_summary(found: DataFrame) -> DataFrame:
    return found.filter("depth > 0").groupBy("rel").agg(F.count(F.lit(1)).alias("n"), F.max("depth").cast("long").alias("deepest"))


def shortest_path(edges: DataFrame, start: str, goal: str, limit: int) -> DataFrame:
    """(step, node) of one shortest undirected path of at most ``limit`` steps; no rows if there is none.

    Each hop's new nodes are written with their parents; the search ends at the
    goal, and the way back joins one level a step.
    """
    spark = edges.sparkSession
    both = undirected(edges)
    levels = [spark.createDataFrame([(start, None)], "node string, parent string")]
    seen = levels[0].select("node")
    found = start == goal
    while not found and len(levels) <= limit:
        step = both.join(levels[-1].select(F.col("node").alias("src")), "src").join(seen.select(F.col("node").alias("dst")), "dst", "left_anti")
        levels.append(written(step.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent")), "level"))
        if levels[-1].isEmpty():
            break
        seen = seen.unionByName(levels[-1].select("node"))
        found = not levels[-1].filter(F.col("node") == goal).isEmpty()
    at = levels[-1].filter(F.col("node") == goal) if found else levels[0].limit(0)
    path = at.select(F.lit(len(levels) - 1).alias("step"), "node")
    for d in range(len(levels) - 2, -1, -1) if found else ():
        at = levels[d].join(at.select(F.col("parent").alias("node")), "node", "left_semi")
        path = path.unionByName(at.select(F.lit(d).alias("step"), "node"))
    return path


def common_neighbors(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node): what both notes are linked with, either direction."""
    both = undirected(edges)
    of = [both.filter(F.col("src") == x).select(F.col("dst").alias("node")) for x in (a, b)]
    return of[0].join(of[1], "node", "left_semi").distinct()


def _numbered(nodes: DataFrame) -> DataFrame:
    """(node, id): numbers in the order of the nodes (distinct), by a sort over ranges."""
    return written(nodes.orderBy("node").withColumn("id", F.monotonically_increasing_id()), "numbered")


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): each linked node and the least node reachable, by alternating star contraction.

    Nodes are numbered in their order first, so rounds exchange numbers and the least number is
    the least node.  A round points every larger neighbour of a node at the least of its
    neighbourhood, then every smaller one; rounds are written, aggregates combine
    map-side, and only two numbers a round reach the driver.
    """
    named = written(edges.select("src", "dst"), "links")
    ids = _numbered(named.select(F.col("src").alias("node")).distinct().union(named.select("dst").distinct()).filter("node is not null").distinct())
    of = lambda end, name: ids.select(F.col("node").alias(end), F.col("id").alias(name))
    pairs = named.join(of("src", "x"), "src").join(of("dst", "y"), "dst").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    stars, state = written(pairs.filter("a <> b").distinct(), "stars"), None
    discard(named)
    while True:
        after = tuple(stars.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())
        if after == state or not after[0]:
            break
        state = after
        both = stars.union(stars.select("b", "a"))
        least = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = written(large, "large")
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        moved = large.join(low, "a").filter("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        before, stars = stars, written(moved.union(low.select("a", "m")).filter("a <> b").distinct(), "stars")
        discard(before, least, large, low)
    root = ids.join(stars.select(F.col("a").alias("id"), F.col("b").alias("m")), "id", "left").groupBy("id", "node").agg(F.min("m").alias("m")).select("node", F.coalesce("m", "id").alias("m"))
    return root.join(ids.select(F.col("id").alias("m"), F.col("node").alias("component")), "m").select("node", "component")
