"""Retrieval: nearest vectors, fuzzy tags, graph and hybrid strategies, hydration, expansion, diversity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions.scoring import cosine_distance, expansion_score, l2_squared, relation_weight, row_similarity
from noteloom.functions.text import tag_relevance, text_relevance
from noteloom.operators.graph import chunk_neighbors, first_neighbors, onward
from noteloom.operators.pivots import celled, nearest
from noteloom.tables import written


def knn(vectors: DataFrame, query: list[float], k: int, metric: str = "l2", where: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``k`` nearest rows: chunk_id, distance and columns to ``keep``; ties by id.  Filters reach the scan; only k rows per task are kept."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dist = l2_squared(F.col("embedding"), q) if metric == "l2" else cosine_distance(F.col("embedding"), q)
    rows = vectors if where is None else vectors.filter(where)
    return rows.select("chunk_id", *keep, F.round(dist, 9).alias("distance")).orderBy("distance", "chunk_id").limit(k)


def knn_many(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", where: Column | None = None) -> DataFrame:
    """(qid, chunk_id, distance): the ``k`` nearest rows of every query (qid, embedding), ties by id.

    One pass over the rows whatever the number of queries (see ``pivots``).  Null vectors
    are neither found nor asked for; a vector of zeros has cosine distance 1 from all.
    """
    return nearest(celled(vectors, metric, where), queries, k)


def settled(hits: DataFrame) -> DataFrame:
    """A search's few hits as a local table, so that what uses them several times does not search again."""
    return hits.sparkSession.createDataFrame(hits.collect(), hits.schema)


def around(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of the hits' notes (hits with note_id).  Chunk relations never leave a note, so no others matter to an expansion."""
    return chunks.join(F.broadcast(hits.select("note_id").distinct()), "note_id", "left_semi")


def vector_of(vectors: DataFrame, chunk_id) -> list[float]:
    """One row's vector, to query with."""
    row = vectors.filter(F.col("chunk_id") == chunk_id).select("embedding").first()
    if row is None:
        raise KeyError(chunk_id)
    return list(row.embedding)


def fuzzy_tag_search(notes: DataFrame, entities: list[str], k: int, where: Column | None = None) -> DataFrame:
    """(note_id, score, distance): notes by how well their tags answer the entities; zero scores drop out."""
    scored = notes.withColumn("score", F.round(tag_relevance(entities, F.col("tags")), 9)).filter("score > 0")
    scored = scored if where is None else scored.filter(where)
    return scored.select("note_id", "score", (1 - F.col("score")).alias("distance")).orderBy(F.desc("score"), "note_id").limit(k)


def fetch_chunks(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks with the given ids (chunk_id), each once; empty and unknown ids drop out."""
    return chunks.join(ids.filter("chunk_id <> ''").select("chunk_id").distinct(), "chunk_id")


def hydrate(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with what the store knows; what a hit brings itself goes first."""
    s = chunks.select("chunk_id", *[F.col(c).alias(f"s_{c}") for c in ("note_id", "content", "chunk_type", "importance_score")])
    j = hits.join(s, "chunk_id", "left")
    own = lambda c: F.col(c) if c in hits.columns else F.lit(None)
    return j.select(*hits.columns, *[F.coalesce(own(c), F.col(f"s_{c}")).alias(c) for c in ("note_id", "content", "chunk_type", "importance_score") if c not in hits.columns])


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """Per chunk the hit of the best final_score (null as 0, the earlier on ties) with the relations of all, each once."""
    w = Window.partitionBy("chunk_id").orderBy(F.coalesce("final_score", F.lit(0.0)).desc(), "ord")
    best = hits.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n", "relationships")
    rels = hits.groupBy("chunk_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("relationships")))).alias("relationships"))
    return best.join(rels, "chunk_id")


def rank(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best by final_score, else 1 - distance, else 0."""
    key = F.coalesce("final_score", 1 - F.col("distance"), F.lit(0.0))
    return hits.withColumn("rank_score", key).orderBy(F.desc("rank_score"), "chunk_id").limit(k)


def graph_search(near: DataFrame, edges: DataFrame, chunks: DataFrame, per_hit: int = 3) -> DataFrame:
    """Vector hits and the first neighbours of each, scored by importance: (chunk_id, distance, final_score, retrieval_method, relationships, ord)."""
    direct = near.select("chunk_id", "distance", (1 - F.col("distance")).alias("final_score"), F.lit("vector_search").alias("retrieval_method"), F.array().cast("array<string>").alias("relationships"), F.lit(0).alias("ord"))
    listed = first_neighbors(chunk_neighbors(edges, chunks, near, per_hit), per_hit)
    around = listed.select(F.col("dst").alias("chunk_id"), (1 - F.col("importance_score")).alias("distance"), F.col("importance_score").alias("final_score"), F.lit("graph_traversal").alias("retrieval_method"), F.array("rel").alias("relationships"), F.col("ord"))
    return direct.unionByName(around)


def hybrid_search(near: DataFrame, tagged: DataFrame, edges: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Vector hits, the two best tag hits, and the first five neighbours of the nearest hit; deduplicated and ranked."""
    hits = graph_search(near.orderBy("distance", "chunk_id").limit(1), edges, chunks, 5).filter("retrieval_method = 'graph_traversal'")
    vec = near.select("chunk_id", "distance", (1 - F.col("distance")).alias("final_score"), F.lit("vector_search").alias("retrieval_method"), F.array().cast("array<string>").alias("relationships"), F.lit(0).alias("ord"))
    tag = tagged.orderBy(F.desc("score"), "chunk_id").limit(2).select("chunk_id", "distance", F.col("score").alias("final_score"), F.lit("tag_search").alias("retrieval_method"), F.array().cast("array<string>").alias("relationships"), F.lit(9).alias("ord"))
    return rank(dedupe_hits(vec.unionByName(tag).unionByName(hits)), k)


def related_minus_primary(related: DataFrame, primary: DataFrame) -> DataFrame:
    return related.join(primary.select("chunk_id"), "chunk_id", "left_anti")


def related_chunks(near: DataFrame, edges: DataFrame, chunks: DataFrame, least: float = 0.3, kinds: list[str] | None = None, n: int | None = 10) -> DataFrame:
    """Neighbours of the hits that matter, each once, most important first; the first ``n`` or, with None, all."""
    found = chunk_neighbors(edges, chunks, near).filter(F.col("importance_score") >= least)
    if kinds:
        found = found.filter(F.col("chunk_type").isin(kinds))
    found = found.groupBy(F.col("dst").alias("chunk_id")).agg(F.max("importance_score").alias("importance_score"), F.min("rel").alias("rel")).orderBy(F.desc("importance_score"), "chunk_id")
    return found if n is None else found.limit(n)


def chunk_context(edges: DataFrame, chunks: DataFrame, target: str, window: int = 2) -> DataFrame:
    """(chunk_id, role, distance): the target, up to ``window`` chunks either side in its note, parents and children."""
    here = chunks.filter(F.col("chunk_id") == target).select(F.col("note_id").alias("n"), F.col("seq").alias("s"))
    near = chunks.join(F.broadcast(here), F.col("note_id") == F.col("n")).filter(F.abs(F.col("seq") - F.col("s")) <= window)
    role = F.when(F.col("seq") == F.col("s"), "target").when(F.col("seq") < F.col("s"), "previous").otherwise("next")
    tree = edges.filter((F.col("src") == target) & F.col("rel").isin("parent", "child")).select(F.col("dst").alias("chunk_id"), F.col("rel").alias("role"), F.lit(0).cast("long").alias("distance"))
    return near.select("chunk_id", role.alias("role"), F.abs(F.col("seq") - F.col("s")).cast("long").alias("distance")).unionByName(tree)


def expansion_candidates(near: DataFrame, chunks: DataFrame, query: str, k: int) -> DataFrame:
    """The hits worth expanding, max(3, k // 2) of them: chunk_id, distance, score."""
    j = near.join(chunks.select("chunk_id", "importance_score", "chunk_type", "contains_links", "header_text"), "chunk_id")
    s = expansion_score(F.col("distance"), F.col("importance_score"), F.col("chunk_type"), F.size("contains_links"), F.col("header_text"), query)
    return j.select("chunk_id", "distance", s.alias("score")).orderBy(F.round("score", 9).desc(), "chunk_id").limit(max(3, k // 2))


def expand_rank(near: DataFrame, edges: DataFrame, chunks: DataFrame, query: str, k: int = 6, depth: int = 2, least: float = 0.3) -> DataFrame:
    """Two levels of weighted expansion from the candidates: (chunk_id, level, final_score, source, rel).

    A neighbour's score is 0.4 of its source's, 0.4 of its importance and 0.2 of
    the relation's weight at the source's depth; it must exceed 0.3.  Reached
    several times in a level, the best score counts (then relation order, then source).
    """
    level = expansion_candidates(near, chunks, query, k).select("chunk_id", F.lit(0).alias("level"), (1 - F.col("distance")).alias("score"), F.col("chunk_id").alias("source"), F.lit("direct").alias("rel"))
    level = seen = written(level, "level")
    info = chunks.select("chunk_id", "importance_score").withColumnRenamed("chunk_id", "dst")
    for d in range(depth):
        step = onward(edges, level.select(F.col("chunk_id").alias("src"), "score"), F.desc("score")).join(info, "dst").filter(F.coalesce("importance_score", F.lit(0.5)) >= least)
        step = step.join(seen.select(F.col("chunk_id").alias("dst")), "dst", "left_anti")
        step = step.withColumn("score", F.round(F.col("score") * 0.4 + F.coalesce("importance_score", F.lit(0.5)) * 0.4 + relation_weight(F.col("rel"), F.lit(d)) * 0.2, 12)).filter("score > 0.3")
        w = Window.partitionBy("dst").orderBy(F.desc("score"), "ord", "src")
        level = step.withColumn("n", F.row_number().over(w)).filter("n = 1").select(F.col("dst").alias("chunk_id"), F.lit(d + 1).alias("level"), "score", F.col("src").alias("source"), "rel")
        if d + 1 < depth:  # the next hop reads it, not what it was made from
            level = written(level, "level")
        seen = seen.unionByName(level)
    texts = chunks.select("chunk_id", "content")
    final = F.col("score") * F.when(F.col("level") == 0, 1.2).otherwise(1.0) + text_relevance(F.col("content"), query) * 0.1
    return seen.join(texts, "chunk_id").select("chunk_id", "level", final.alias("final_score"), "source", "rel")


MMR_SCHEMA = "qid string, chunk_id string, place int, mmr double"


def mmr(candidates: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """Per qid up to ``k`` candidates (chunk_id, note_id, chunk_type, header_text, final_score) by relevance against novelty.

    Selection is sequential by nature; each group holds only a query's candidates.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf.sort_values(["final_score", "chunk_id"], ascending=[False, True]).to_dict("records")
        chosen: list[dict] = []
        while left and len(chosen) < k:
            scores = [weight * c["final_score"] - (1 - weight) * max((row_similarity(c, d) for d in chosen), default=0.0) for c in left]
            best = 0 if not chosen else max(range(len(left)), key=lambda i: (scores[i], -i))
            chosen.append(left.pop(best) | {"mmr": scores[best]})
        return pd.DataFrame([(c["qid"], c["chunk_id"], i, c["mmr"]) for i, c in enumerate(chosen)], columns=["qid", "chunk_id", "place", "mmr"])

    return candidates.groupBy("qid").applyInPandas(pick, MMR_SCHEMA)
