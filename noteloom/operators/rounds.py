"""Work in rounds over tables: answers whose context is widened until it is good enough, and enrichment that can be taken up again.

Both keep what a row has come to in a table, so a round touches only the rows that
are still open, rounds are bounded, and what they found survives a lost executor or driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteloom.functions.hooks import Classify
from noteloom.functions.text import trimmed
from noteloom.operators.graph import chunk_neighbors
from noteloom.store import Change, Store
from noteloom.tables import written

# --- the quality loop ----------------------------------------------------------------------------

#: Completeness above which a context is good enough, and rounds of widening at most.
ENOUGH, ROUNDS = 0.7, 2
#: (question, context) to a completeness from 0 to 1.
Assess = Callable[[Column, Column], Column]
#: (open questions with their hits so far, round) to more hits (qid, chunk_id), best first by ``rank_score``.
Widen = Callable[[DataFrame, int], DataFrame]


def coverage(question: Column, context: Column) -> Column:
    """Share of a question's distinct words (of more than two letters) that its context holds; 1 without such words."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(question, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2))
    held = F.split(F.lower(F.coalesce(context, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.when(F.size(words) == 0, 1.0).otherwise(F.size(F.array_intersect(words, held)) / F.size(words))


def assessor(assess: Callable[[list[str], list[str]], list[float]]) -> Assess:
    """A hook over batches (questions, contexts) as an assessment; null texts are ''."""

    @F.pandas_udf("double")
    def run(questions: pd.Series, contexts: pd.Series) -> pd.Series:
        return pd.Series(assess(questions.fillna("").tolist(), contexts.fillna("").tolist()), dtype=float)

    return run


def beside(edges: DataFrame, chunks: DataFrame) -> Widen:
    """More hits from the relations of the hits so far, most important first."""

    def more(hits: DataFrame, number: int) -> DataFrame:
        near = chunk_neighbors(edges, chunks, hits.select("chunk_id").distinct())
        found = hits.select("qid", F.col("chunk_id").alias("src")).join(near, "src")
        return found.groupBy("qid", F.col("dst").alias("chunk_id")).agg(F.max("importance_score").alias("rank_score"))

    return more


def _contexts(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, context): contents of the hits, in order; a question has 2 k hits at most."""
    held = hits.join(chunks.select("chunk_id", F.coalesce("content", F.lit("")).alias("content")), "chunk_id")
    parts = F.array_sort(F.collect_list(F.struct("round", "place", "chunk_id", "content")))
    return held.groupBy("qid").agg(F.array_join(F.transform(parts, lambda p: p["content"]), "\n").alias("context"))


def improved(questions: DataFrame, hits: DataFrame, chunks: DataFrame, widen: Widen, assess: Assess = coverage, k: int = 6, rounds: int = ROUNDS, enough: float = ENOUGH) -> tuple[DataFrame, DataFrame]:
    """(hits, states): the hits of each question (qid, question) widened in at most ``rounds`` rounds.

    Hits (qid, chunk_id, place) get a ``round``, 0 for those given.  A round assesses the open questions;
    those that are complete stop, the others get up to k // 2 hits that they do not have, and stop if there are none;
    a question has 2 k hits at most.  States: (qid, rounds, completeness), rounds being the assessments
    made, completeness the last one (before the last widening).
    """
    now = written(hits.select("qid", "chunk_id", F.col("place").cast("int").alias("place"), F.lit(0).alias("round")), "hits")
    open_ = written(questions.select("qid", "question"), "open")
    states = None
    for number in range(1, rounds + 1):
        own = now.join(open_.select("qid"), "qid", "left_semi")
        judged = open_.join(_contexts(own, chunks), "qid", "left").withColumn("completeness", assess(F.col("question"), F.coalesce("context", F.lit(""))))
        judged = written(judged.select("qid", "question", "completeness"), "judged")
        wanting = judged.filter(F.coalesce(F.col("completeness"), F.lit(0.0)) <= enough)
        short = own.join(wanting.select("qid"), "qid", "left_semi")
        new = widen(short, number).select("qid", "chunk_id", "rank_score").join(now.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rank_score"), "chunk_id"))
        have = short.groupBy("qid").agg(F.count(F.lit(1)).alias("have"))
        new = new.withColumn("place", place).join(have, "qid").filter((F.col("place") <= k // 2) & (F.col("place") + F.col("have") <= 2 * k))
        new = written(new.select("qid", "chunk_id", "place", F.lit(number).alias("round")), "hits")
        this = judged.select("qid", F.lit(number).alias("rounds"), "completeness")
        states = this if states is None else states.join(this.select("qid"), "qid", "left_anti").unionByName(this)
        now = now.unionByName(new)
        open_ = written(wanting.select("qid", "question").join(new.select("qid").distinct(), "qid", "left_semi"), "open")
        if open_.isEmpty():
            break
    return now, states


# --- enrichment that can be taken up again -------------------------------------------------------

#: Attempts at a note before it is left alone, notes that a hook sees at a time, and parts of a run, each kept as it is done.
ATTEMPTS, BATCH, PARTS = 3, 50, 4
STATE = "note_id string, mark string, seen string, class string, attempts int, error string"


def enrichment(spark: SparkSession, root: str, buckets: int = 64) -> Store:
    """The state of an enrichment job: what each note has come to."""
    return Store(spark, root, {"state": "note_id"}, buckets)


def pending(notes: DataFrame, state: DataFrame | None, mark: str, attempts: int = ATTEMPTS) -> DataFrame:
    """Notes (note_id, text) still to do, with ``tried``: those without text are skipped, and so is a note done under this mark with the same text.

    A note that failed is tried again, ``attempts`` times in all; another text or mark starts anew.
    """
    rows = notes.filter(trimmed(F.coalesce("text", F.lit(""))) != "").select("note_id", "text", F.sha2("text", 256).alias("seen"))
    if state is None:
        return rows.withColumn("tried", F.lit(0))
    known = state.filter(F.col("mark") == mark).select("note_id", "seen", F.col("class").isNotNull().alias("done"), F.col("attempts").alias("tried"))
    j = rows.join(known, ["note_id", "seen"], "left")
    return j.filter(~F.coalesce("done", F.lit(False)) & (F.coalesce("tried", F.lit(0)) < attempts)).select("note_id", "text", "seen", F.coalesce("tried", F.lit(0)).alias("tried"))


def _tried(rows: DataFrame, classify: Classify, mark: str, batch: int) -> DataFrame:
    def one(text: str) -> tuple[str | None, str | None]:
        try:
            return classify([text])[0], None
        except Exception as e:  # what a hook raises is that note's result
            return None, f"{type(e).__name__}: {e}"[:500]

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in pdfs:
            for at in range(0, len(whole), batch):
                pdf = whole.iloc[at : at + batch]
                texts = pdf["text"].tolist()
                try:
                    made = [(c, None) for c in classify(texts)]
                    if len(made) != len(texts):
                        raise ValueError("as many classes as notes are asked for")
                except Exception:  # one of the batch fails: each by itself
                    made = [one(t) for t in texts]
                yield pd.DataFrame({"note_id": pdf["note_id"].tolist(), "mark": mark, "seen": pdf["seen"].tolist(), "class": [c for c, _ in made], "attempts": (pdf["tried"] + 1).astype("int32").tolist(), "error": [e for _, e in made]}, dtype=object)

    return rows.mapInPandas(run, STATE)


def enrich(notes: DataFrame, state: Store, classify: Classify, mark: str, attempts: int = ATTEMPTS, batch: int = BATCH, parts: int = PARTS) -> int:
    """Classify the notes that are still to do; the number of notes tried.  Nothing is written where there are none.

    The work is cut into ``parts`` by a hash of the note; each is a version of the
    state when it is done, so a run that dies is taken up behind its last part.
    """
    before = state.read("state") if state.versions() else None
    todo = written(pending(notes, before, mark, attempts), "todo")
    if todo.isEmpty():
        return 0
    for part in range(parts):
        rows = todo.filter(F.pmod(F.xxhash64(F.lit("part"), "note_id"), F.lit(parts)) == part)
        if not rows.isEmpty():
            state.commit({"state": Change(fresh=_tried(rows, classify, mark, batch))})
    return todo.count()
