"""Questions to answers: routing to a strategy, retrieval, hydration, status and advice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.functions import intent as intents
from noteloom.functions import scoring
from noteloom.functions.hooks import Answer, Embed, hashed_embedding, quoted_answer
from noteloom.functions.text import format_context
from noteloom.operators import search


@dataclass(frozen=True)
class Routed:
    """What a question wants."""

    intent: str
    confidence: float
    strategy: str
    entities: list[str]


@dataclass(frozen=True)
class Response:
    """Ranked hits, related chunks that are not among them, and one row of status."""

    hits: DataFrame
    related: DataFrame
    status: DataFrame
    routed: Routed


class Engine:
    """Searches over chunks (with embedding and tags) and their edges.

    A question's routing is decided at the driver; everything over the tables is
    a lazy plan that reads the vectors once and keeps k rows per task.
    """

    def __init__(self, chunks: DataFrame, edges: DataFrame, embed: Embed = hashed_embedding):
        self.chunks, self.edges, self.embed = chunks, edges, embed
        self.spark = chunks.sparkSession

    def route(self, question: str) -> Routed:
        made = intents.intent(F.lit(question))
        r = self.spark.range(1).select(*[v.alias(k) for k, v in made.items()], intents.first_words(F.lit(question)).alias("first")).first()
        return Routed(r.intent_type, r.intent_confidence, r.strategy, list(r.entities) or list(r.first))

    def near(self, question: str, k: int, where: Column | None = None) -> DataFrame:
        return search.settled(search.knn(self.chunks, self.embed([question])[0], k, "cosine", where))

    def tagged(self, entities: list[str], k: int, where: Column | None = None) -> DataFrame:
        rows = self.chunks if where is None else self.chunks.filter(where)
        return search.fuzzy_tag_search(rows.select(F.col("chunk_id").alias("note_id"), "tags"), entities, k).withColumnRenamed("note_id", "chunk_id")

    def _hits(self, question: str, routed: Routed, k: int, where: Column | None) -> DataFrame:
        plain = lambda df, method: df.select("chunk_id", "distance", (1 - F.col("distance")).alias("final_score"), F.lit(method).alias("retrieval_method"), F.array().cast("array<string>").alias("relationships"), F.lit(0).alias("ord"))
        few = max(3, k // 2)
        if routed.strategy == "tag":
            return plain(self.tagged(routed.entities, k, where), "tag_search")
        if routed.strategy == "graph":
            return search.graph_search(self.near(question, few, where), self.edges, self.chunks)
        if routed.strategy == "hybrid":
            found = search.hybrid_search(self.near(question, few, where), self.tagged(routed.entities, k, where), self.edges, self.chunks, k)
            return found.drop("rank_score")
        return plain(self.near(question, k, where), "vector_search")

    def smart_search(self, question: str, k: int = 6, vault: str | None = None) -> Response:
        """The routed search; a vault without hits is searched again without the filter by the caller's choice."""
        routed = self.route(question)
        where = None if vault is None else F.col("vault") == vault
        hits = search.rank(search.hydrate(search.dedupe_hits(self._hits(question, routed, k, where)), self.chunks), k)
        related = search.related_minus_primary(search.related_chunks(hits, self.edges, self.chunks), hits)
        row = hits.agg(F.avg("distance").alias("mean"), F.count(F.lit(1)).alias("n"))
        none = F.lit(None).cast("double")
        score, status = scoring.search_status(F.col("n"), scoring.confidence(F.col("mean"), none, none, F.lit(0)), F.lit(self.embed is hashed_embedding))
        # relationship questions go by the name 'graph' outside
        name = "graph" if routed.intent == "relationship" else routed.intent
        advice = scoring.recommendations(F.col("mean"), F.lit(name), F.lit(None).cast("int"), F.lit("closed"))
        return Response(hits, related, row.select(score.alias("confidence"), status.alias("status"), F.when(status == "degraded", advice).alias("advice")), routed)

    def search_notes(self, question: str, k: int = 6, vault: str | None = None, tag: str | None = None) -> DataFrame:
        """By tag if one is given, else by vector."""
        where = None if vault is None else F.col("vault") == vault
        return self.tagged([tag], k, where).select("chunk_id", "distance") if tag else self.near(question, k, where)

    def retrieve(self, question: str, k: int = 6) -> DataFrame:
        """Retrieval by intent: graph questions take neighbours along, tag questions tagged chunks, specific ones fewer."""
        r = self.route(question)
        if r.intent == "relationship":
            near = self.near(question, max(1, k // 2))
            around = search.graph_search(near, self.edges, self.chunks, 2).filter("retrieval_method = 'graph_traversal'").select("chunk_id", F.lit(0.5).alias("distance"))
            return near.unionByName(around).groupBy("chunk_id").agg(F.min("distance").alias("distance")).orderBy("distance", "chunk_id").limit(k)
        if r.intent == "categorical":
            return self.near(question, k, F.arrays_overlap("tags", F.array(*[F.lit(e) for e in r.entities])))
        return self.near(question, min(k, 4) if r.intent == "specific" else k)

    def expanded(self, question: str, k: int = 6) -> DataFrame:
        """Graph expansion, weighted ranking, then a diverse choice of k: chunk_id, place, mmr."""
        found = search.expand_rank(self.near(question, min(2 * k, 12)), self.edges, self.chunks, question, k)
        info = self.chunks.select("chunk_id", "note_id", "chunk_type", "header_text")
        return search.mmr(found.join(info, "chunk_id").withColumn("qid", F.lit("q")), k).drop("qid")

    def context(self, hits: DataFrame) -> str:
        """The hits' texts, best first; k rows."""
        rows = hits.orderBy(F.desc("rank_score"), "chunk_id").select("chunk_id", "retrieval_method", "content").collect()
        made = [(i + 1, r.chunk_id, r.retrieval_method, r.content or "") for i, r in enumerate(rows)]
        if not made:
            return ""
        df = self.spark.createDataFrame(made, "place int, title string, method string, content string")
        return "".join(r.c for r in df.select("place", format_context(F.col("place"), F.col("title"), F.col("method"), F.col("content")).alias("c")).orderBy("place").collect())

    def ask(self, question: str, k: int = 8, vault: str | None = None, answer: Answer = quoted_answer) -> dict:
        """An answer over the same hits that are shown; without any, without an answer."""
        r = self.smart_search(question, k, vault)
        context = self.context(r.hits)
        status = r.status.first().asDict()
        return {"question": question, "answer": answer(question, context) if context else "", "context": context, "intent": r.routed.intent, "agent": bool(self.spark.range(1).select(intents.wants_agent(F.lit(question)).alias("a")).first().a), **status}
