"""Many questions answered in one plan: routed as Columns, one plan for each strategy, the best hits of each question.

What ``Engine.smart_search`` does for one question at the driver, this does for a
table (qid, question, embedding): no question's result reaches the driver, and
vectors, tags and relations are each read once whatever the number of questions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions import intent as intents
from noteloom.functions import scoring
from noteloom.functions.text import tag_match
from noteloom.operators.graph import chunk_neighbors
from noteloom.operators.pivots import nearest_within
from noteloom.operators.search import knn_many
from noteloom.tables import written

#: Neighbours of a hit that the graph strategy takes, of the nearest hit that the hybrid one takes; tagged hits of the hybrid one.
PER_HIT, OF_NEAREST, OF_TAGS = 3, 5, 2
#: Distinct tags that meet all entities at a time.
TAG_BLOCK = 4096
DIGITS = 9


def routed(questions: DataFrame) -> DataFrame:
    """``questions`` (qid, question) with intent_type, intent_confidence, strategy and entities; without tags in it, a question's entities are its first words."""
    made = intents.intent(F.col("question"))
    named = F.when(F.size(made["entities"]) > 0, made["entities"]).otherwise(intents.first_words(F.col("question")))
    return questions.withColumns({**made, "entities": named})


def _first(df: DataFrame, n: int | Column, *order: Column) -> DataFrame:
    """The first rows of each question."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy(*order))
    return df.withColumn("place", place).filter(F.col("place") <= n).drop("place")


def tagged(asked: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(qid, chunk_id, score): per question (qid, entities) the ``k`` chunks whose tags answer best; zero scores drop out.

    Entities and tags meet as distinct strings, tags in blocks; chunks of equal tags
    are one row until the end, because of each such set only the first ``k`` can be among the best.
    """
    sets = chunks.select("chunk_id", F.array_sort(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>")))).alias("tags")).withColumn("set", F.sha2(F.to_json("tags"), 256))
    heads = sets.withColumn("n", F.row_number().over(Window.partitionBy("set").orderBy("chunk_id"))).filter(F.col("n") <= k).select("set", "chunk_id", "tags")
    heads = written(heads, "heads")
    kinds = heads.groupBy("set").agg(F.any_value("tags").alias("tags"))
    in_set = kinds.select("set", F.explode("tags").alias("tag"))
    tags = written(in_set.select("tag").distinct(), "tags")
    blocks = F.ceil(F.count(F.lit(1)) / TAG_BLOCK).cast("int").alias("blocks")
    count = tags.agg(blocks).first().blocks
    wanted = asked.select("qid", F.size("entities").alias("many"), F.explode("entities").alias("entity"))
    # every entity is held against all tags, block by block
    entities = wanted.select("entity").distinct().withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(count, 1) - 1))))
    dealt = tags.withColumn("block", F.pmod(F.xxhash64("tag"), F.lit(max(count, 1))).cast("int"))
    match = written(entities.join(dealt, "block").select("entity", "tag", tag_match(F.col("entity"), F.col("tag")).alias("match")).filter("match > 0"), "match")
    best = match.join(in_set, "tag").groupBy("entity", "set").agg(F.max("match").alias("match"))
    scored = wanted.join(best, "entity").groupBy("qid", "many", "set").agg(F.sum("match").alias("total")).select("qid", "set", F.round(F.col("total") / F.col("many"), DIGITS).alias("score"))
    rank = F.rank().over(Window.partitionBy("qid").orderBy(F.desc("score")))
    near = scored.filter("score > 0").withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")
    return _first(near.join(heads.select("set", "chunk_id"), "set").select("qid", "chunk_id", "score"), k, F.desc("score"), F.col("chunk_id"))


def _as_hits(df: DataFrame, method: str, score: Column, ord_: int = 0) -> DataFrame:
    return df.select("qid", "chunk_id", "distance", score.alias("final_score"), F.lit(method).alias("retrieval_method"), F.array().cast("array<string>").alias("relationships"), F.lit(ord_).alias("ord"))


def _around(near: DataFrame, edges: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """The first ``n`` neighbours of each question's hits; each hit's neighbours are looked up once."""
    sources = near.select("chunk_id").distinct()
    listed = chunk_neighbors(edges, chunks, sources, n)
    listed = listed.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy("ord", "dst"))).filter(F.col("n") <= n)
    found = near.select("qid", F.col("chunk_id").alias("src")).join(listed, "src")
    return found.select("qid", F.col("dst").alias("chunk_id"), (1 - F.col("importance_score")).alias("distance"), F.col("importance_score").alias("final_score"), F.lit("graph_traversal").alias("retrieval_method"), F.array("rel").alias("relationships"), "ord")


def _deduped(hits: DataFrame) -> DataFrame:
    """Per question and chunk the hit of the best final_score (the earlier on ties) with the relations of all."""
    w = Window.partitionBy("qid", "chunk_id").orderBy(F.coalesce("final_score", F.lit(0.0)).desc(), "ord")
    best = hits.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n", "relationships")
    rels = hits.groupBy("qid", "chunk_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("relationships")))).alias("relationships"))
    return best.join(rels, ["qid", "chunk_id"])


def answered(questions: DataFrame, chunks: DataFrame, edges: DataFrame, k: int = 6) -> DataFrame:
    """(qid, chunk_id, place, rank_score, retrieval_method, relationships): the ``k`` best hits of each question (qid, question, embedding), by its own strategy.

    ``chunks`` have chunk_id, embedding, tags and importance; ``edges`` are ``structure.chunk_edges``.  A question without a
    vector is answered by its tags alone, or not at all.
    """
    q = written(routed(questions.select("qid", "question", "embedding")), "routed")
    few = max(3, k // 2)
    by_vector = q.filter("strategy <> 'tag'")
    near = written(knn_many(chunks.select("chunk_id", "embedding"), by_vector.select("qid", "embedding"), k, "cosine"), "near")
    near = near.join(q.select("qid", "strategy"), "qid")
    near = written(_first(near, F.when(F.col("strategy") == "vector", k).otherwise(few), F.col("distance"), F.col("chunk_id")), "near")
    tags = written(tagged(q.filter("strategy in ('tag', 'hybrid')").select("qid", "entities"), chunks, k).join(q.select("qid", "strategy"), "qid").withColumn("distance", 1 - F.col("score")), "tagged")
    of = lambda df, s: df.filter(F.col("strategy").isin(*s))
    hits = _as_hits(near, "vector_search", 1 - F.col("distance"))
    hits = hits.unionByName(_as_hits(of(tags, ["tag"]), "tag_search", F.col("score")))
    two = _first(of(tags, ["hybrid"]), OF_TAGS, F.desc("score"), F.col("chunk_id"))
    hits = hits.unionByName(_as_hits(two, "tag_search", F.col("score"), 9))
    hits = hits.unionByName(_around(of(near, ["graph"]), edges, chunks, PER_HIT))
    nearest = _first(of(near, ["hybrid"]), 1, F.col("distance"), F.col("chunk_id"))
    hits = hits.unionByName(_around(nearest, edges, chunks, OF_NEAREST))
    key = F.round(F.coalesce("final_score", 1 - F.col("distance"), F.lit(0.0)), DIGITS)
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rank_score"), "chunk_id"))
    ranked = _deduped(hits).withColumn("rank_score", key).withColumn("place", place).filter(F.col("place") <= k)
    return ranked.select("qid", "chunk_id", "place", "rank_score", "distance", "retrieval_method", "relationships")


#: Hits of a question for something specific, neighbours that a relationship question takes of each hit, and their distance.
SPECIFIC, OF_EACH, BESIDE = 4, 2, 0.5


def retrieved(questions: DataFrame, chunks: DataFrame, edges: DataFrame, k: int = 6) -> DataFrame:
    """(qid, chunk_id, distance): retrieval by intent for a table of questions (qid, question, embedding).

    Relationship questions take neighbours of their nearest chunks along, tag
    questions the nearest among chunks with one of their tags, specific ones fewer.
    """
    q = written(routed(questions.select("qid", "question", "embedding")), "routed")
    kind = F.col("intent_type")
    near = knn_many(chunks.select("chunk_id", "embedding"), q.filter(kind != "categorical").select("qid", "embedding"), k, "cosine").join(q.select("qid", "intent_type"), "qid")
    many = F.when(kind == "relationship", max(1, k // 2)).when(kind == "specific", min(k, SPECIFIC)).otherwise(k)
    near = written(_first(near, many, F.col("distance"), F.col("chunk_id")), "near")
    around = _around(near.filter(kind == "relationship"), edges, chunks, OF_EACH).select("qid", "chunk_id", F.lit(BESIDE).alias("distance"))
    # questions meet chunks by tag, in blocks, so only chunks that carry one are compared and no pair is exchanged
    wanted = q.filter(kind == "categorical").select("qid", F.explode("entities").alias("tag"))
    wanted = wanted.distinct().join(q.select("qid", "embedding").distinct(), "qid").withColumnRenamed("tag", "cell")
    tagged_ = nearest_within(chunks.select(F.explode("tags").alias("cell"), "chunk_id", "embedding"), wanted, k)
    every = near.select("qid", "chunk_id", "distance").unionByName(around).unionByName(tagged_)
    return _first(every.groupBy("qid", "chunk_id").agg(F.min("distance").alias("distance")), k, F.col("distance"), F.col("chunk_id"))


def statuses(questions: DataFrame, hits: DataFrame, fallback: bool = False) -> DataFrame:
    """(qid, confidence, status, advice): of every question, also of those without hits."""
    q = routed(questions.select("qid", "question")).select("qid", F.when(F.col("intent_type") == "relationship", "graph").otherwise(F.col("intent_type")).alias("kind"))
    row = hits.groupBy("qid").agg(F.avg("distance").alias("mean"), F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("double")
    j = q.join(row, "qid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    score, status = scoring.search_status(F.col("n"), scoring.confidence(F.col("mean"), none, none, F.lit(0)), F.lit(fallback))
    j = j.select("qid", "kind", "mean", score.alias("confidence"), status.alias("status"))
    advice = scoring.recommendations(F.col("mean"), F.col("kind"), F.lit(None).cast("int"), F.lit("closed"))
    return j.select("qid", "confidence", "status", F.when(F.col("status") == "degraded", advice).alias("advice"))
