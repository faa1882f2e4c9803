"""Language-model scores: a text's probability over all its segmentations into vocabulary pieces.

``score`` is the dealt model: the pieces of a public byte-level rank file, weighted
by the vocabulary's own ranks, with its end piece closing each text.  A text's
probability is the sum over all segmentations, by forward recursion in log space (``lattice``);
pieces hold no space after their first byte, so it is the product over the words and the end.

``fitted_score`` beside it learns from the training rows: every training word is a piece
too, subword weights are re-estimated on all training words by forward-backward
sums, word weights are absolutely discounted counts, the discount's mass going to
the subword paths,

    P(w) = max(c(w) - D, 0) / N + (D * types / N) * sum over segmentations,

and P sums to 1 over words and the end.  The op1 query reports it as its score,
because that is to learn from the training rows.

Flow: (1) word counts, combined per task, then one exchange; (2) estimation and
word scores over the table of distinct words, task by task; only the bounded
piece table travels; (3) words with at least ``HEAVY`` of all tokens (at most
1 / HEAVY of them) are broadcast and summed map-side, the rest go through one
join with the word table.

Defined results: null or empty texts hold the end token alone; repeated rows
are scored each and counted each in training; without training rows every
known count is 0; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import LOWER, held_out, slices, texts_of, written
from noteloom.llm.lattice import PieceTable, expected_counts, log_marginals, read_pieces

#: Share of all tokens from which a word is broadcast; so at most 1 / HEAVY words are.
HEAVY = 5e-6
#: Rounds of re-estimation, and the count that each piece has besides.
ROUNDS, FLOOR = 2, 1e-3
#: Distinct words that a task counts or scores at a time.
WORDS = 200_000
LOG10 = math.log(10)


def words(text: str) -> list[bytes]:
    """A-Z lower-cased; runs without ASCII white space."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


@dataclass
class Totals:
    """Of the training tokens: all, distinct words, ends, and words that occur once and twice."""

    tokens: int
    types: int
    ends: int
    once: int
    twice: int

    @property
    def distinct(self) -> int:
        return self.types + (self.ends > 0)

    @property
    def discount(self) -> float:
        return min(0.95, max(0.05, self.once / (self.once + 2 * self.twice))) if self.once else 0.5

    @property
    def rest(self) -> float:
        """Mass of the subword paths."""
        return self.discount * self.types / self.tokens if self.types else 1.0

    @property
    def end_log10(self) -> float:
        return math.log10(max(self.ends, 0.5) / max(self.tokens, 1))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    train: Counter = Counter()
    other: set[bytes] = set()
    ends = 0

    def out():
        names = list(train) + [w for w in other if w not in train]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([train.get(w, 0) for w in names], pa.int64())], ["word", "c"])

    for part in slices(batches):
        for text, out_of in zip(part.column("text").to_pylist(), part.column("held_out").to_pylist()):
            if out_of:
                other.update(words(text))
            else:
                train.update(words(text))
                ends += 1
        if len(train) + len(other) > WORDS:
            yield out()
            train, other = Counter(), set()
    if ends:
        train[b" "] += ends  # no word holds a space: this row counts the ends
    yield out()


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words and counts, about WORDS at a time."""
    names: list[bytes] = []
    counts: list[np.ndarray] = []
    for b in batches:
        names += b.column("word").to_pylist()
        counts.append(b.column("c").to_numpy())
        if len(names) >= WORDS:
            yield names, np.concatenate(counts)
            names, counts = [], []
    if names:
        yield names, np.concatenate(counts)


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c) over ``rows`` (text, held_out): every word, c its training count; the row b' ' counts ends."""
    return rows.select("text", "held_out").mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def totals(counts: DataFrame) -> Totals:
    word = F.col("word") != F.lit(b" ")
    t = counts.agg(
        F.sum("c").alias("tokens"),
        F.count(F.when(word & (F.col("c") > 0), 1)).alias("types"),
        F.sum(F.when(~word, F.col("c"))).alias("ends"),
        F.count(F.when(word & (F.col("c") == 1), 1)).alias("once"),
        F.count(F.when(word & (F.col("c") == 2), 1)).alias("twice"),
    ).first()
    return Totals(t.tokens or 0, t.types, t.ends or 0, t.once, t.twice)


def rank_weights(table: PieceTable) -> np.ndarray:
    """Natural-log piece weights of the vocabulary alone, aligned with ``table.ids``.

    A rank file holds an order and no probabilities; merges are ranked by frequency,
    so by Zipf's law a piece of rank r weighs 1 / (r + 1).  The end piece follows the last rank.
    """
    weight = 1.0 / (table.ids + 1.0)
    return np.log(weight / (weight.sum() + 1.0 / (table.size + 1.0)))


def end_weight(table: PieceTable) -> float:
    """Natural log of the end piece's weight, beside ``rank_weights``."""
    return math.log(1.0 / (table.size + 1.0)) - math.log((1.0 / (table.ids + 1.0)).sum() + 1.0 / (table.size + 1.0))


def estimate(counts: DataFrame, pieces: list[bytes], rounds: int = ROUNDS) -> np.ndarray:
    """Natural-log piece weights, aligned with ``PieceTable(pieces).ids``: from ranks, then fitted to each training word once."""
    spark = counts.sparkSession
    table = PieceTable(pieces)
    shared = spark.sparkContext.broadcast(pieces)
    weight = 1.0 / (table.ids + 1.0)
    known = counts.filter((F.col("c") > 0) & (F.col("word") != F.lit(b" ")))
    for _ in range(rounds):
        logp = np.log(weight / weight.sum())
        sent = spark.sparkContext.broadcast(logp)

        def run(batches, sent=sent):
            tab = PieceTable(shared.value)
            total = np.zeros(len(tab.ids))
            for names, _ in _gather(batches):
                total += expected_counts([b" " + w for w in names], np.ones(len(names)), tab, sent.value)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "n"])

        got = known.mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        weight = np.full(len(table.ids), FLOOR)
        weight[got.column("piece").to_numpy()] += got.column("n").to_numpy()
    return np.log(weight / weight.sum())


def word_scores(counts: DataFrame, t: Totals, pieces: list[bytes], logp: np.ndarray) -> DataFrame:
    """(word, c, score, lattice): each distinct word's log10 probability over all its paths, under the model and by the vocabulary's own weights."""
    sc = counts.sparkSession.sparkContext
    shared, sent = sc.broadcast(pieces), sc.broadcast(logp)
    n, discount, rest = max(t.tokens, 1), t.discount, t.rest

    def run(batches):
        tab = PieceTable(shared.value)
        for names, c in _gather(batches):
            spelled = [b" " + w for w in names]
            sub = math.log(rest) + log_marginals(spelled, tab, sent.value)
            lattice = log_marginals(spelled, tab, rank_weights(tab)) / LOG10
            with np.errstate(divide="ignore"):
                whole = np.log(np.maximum(c - discount, 0.0) / n)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(c), pa.array(np.logaddexp(whole, sub) / LOG10), pa.array(lattice)], ["word", "c", "score", "lattice"])

    return counts.filter(F.col("word") != F.lit(b" ")).mapInArrow(run, "word binary, c long, score double, lattice double")


def lm_scores(docs: DataFrame, training: Column | None = None, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, fitted_score.

    ``score`` is the marginal of the words and the end by the vocabulary's own
    weights; ``fitted_score`` is that of the model fitted to the training rows.
    ``training`` says over doc_id which rows are learnt from; without it, those
    whose crc32 of the id as text is not 2 modulo 7.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out_of = held_out("doc_id", 7, 2) if training is None else ~F.coalesce(training, F.lit(False))
    rows = texts_of(docs, id_col, text_col).withColumn("held_out", out_of)
    counts = written(word_counts(rows), "words")
    t = totals(counts)
    pieces = read_pieces(vocabulary)
    scored = written(word_scores(counts, t, pieces, estimate(counts, pieces, rounds)), "scored")

    heavy = F.col("c") >= max(2, math.ceil(HEAVY * t.tokens))
    top = scored.filter(heavy).toArrow()
    c, s = top.column("c").to_numpy(), top.column("score").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast((top.column("word").to_pylist(), np.log10(c + 1.0), s, top.column("lattice").to_numpy()))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        names, lc, ls, ll = shared.value
        place = {w: i for i, w in enumerate(names)}
        n, first = 0, TaskContext.get().partitionId() << 40
        for part in slices(batches):
            row, word, tf = [], [], []
            tokens, known, base, score, lattice = [], [], [], [], []
            for k, text in enumerate(part.column("text").to_pylist()):
                w = words(text)
                at = np.fromiter((i for i in map(place.get, w) if i is not None), dtype=np.int64)
                tokens.append(len(w) + 1)
                known.append(len(at))
                base.append(float(lc[at].sum()))
                score.append(float(ls[at].sum()))
                lattice.append(float(ll[at].sum()))
                if len(at) < len(w):
                    light = Counter([x for x in w if x not in place])
                    row += [first + n + k] * len(light)
                    word += light.keys()
                    tf += light.values()
            m, r = part.num_rows, len(row)
            # a document's own sums travel under a word that no text holds, spread evenly
            own = [first + n + k for k in range(m)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(own + row, pa.int64()), pa.array([b" %d" % x for x in own] + word, pa.binary()), pa.array([0] * m + tf, pa.int64()),
                    pa.concat_arrays([part.column("doc_id"), pa.nulls(r, part.column("doc_id").type)]), pa.concat_arrays([part.column("held_out"), pa.nulls(r, pa.bool_())]),
                    pa.array(tokens + [0] * r, pa.int64()), pa.array(known + [0] * r, pa.int64()), pa.array(base + [0.0] * r), pa.array(score + [0.0] * r), pa.array(lattice + [0.0] * r),
                ],
                ["row", "word", "tf", "doc_id", "held_out", "n_tokens", "known", "base", "score", "lattice_score"],
            )
            n += m

    parts = rows.mapInArrow(run, f"row long, word binary, tf long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, lattice_score double")
    light = scored.filter(~heavy).select("word", "c", F.col("score").alias("word_score"), "lattice")
    met = parts.join(light, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    known_end = 1 if t.ends else 0
    return (
        met.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("held_out").alias("held_out"),
            F.sum("n_tokens").alias("n_tokens"),
            (F.sum(F.col("known") + F.when(F.col("c") > 0, F.col("tf")).otherwise(0)) + known_end).alias("n_known"),
            F.sum(F.col("base") + F.col("tf") * F.log10(F.col("c") + 1.0)).alias("base"),
            F.sum(F.col("score") + F.col("tf") * F.coalesce("word_score", F.lit(0.0))).alias("score"),
            F.sum(F.col("lattice_score") + F.col("tf") * F.coalesce("lattice", F.lit(0.0))).alias("lattice_score"),
        )
        .select(
            "doc_id", "held_out", "n_tokens", "n_known",
            F.lit(t.tokens).cast("long").alias("train_tokens"),
            (F.col("base") + math.log10(t.ends + 1) - F.col("n_tokens") * math.log10(t.tokens + t.distinct + 1)).alias("base_score"),
            (F.col("lattice_score") + end_weight(PieceTable(pieces)) / LOG10).alias("score"),
            (F.col("score") + t.end_log10).alias("fitted_score"),
        )
    )
