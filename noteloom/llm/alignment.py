"""Alignment of two tokenizers over the same texts, and how often their tokens meet.

1. ``encoded``: both token streams of every text, as packed ids, in a written table.
2. Per Arrow slice all texts stand in one byte space.  A running sum over token
   lengths gives the ends of A's and B's tokens; one ``bincount`` over both counts
   them: where it is 2, both end and the stream is cut into groups.  Between two
   neighbouring ends lies exactly one token of each side, and two tokens share
   one such stretch at most, so the stretches are the overlapping pairs.
   Segmented sums bring everything back to documents.
3. Pairs are counted per task, combined, and summed by one exchange.  At most
   HEAVY pairs, the most frequent, are broadcast and settle nearly all links
   where they lie; a link of a rarer pair is joined to its count by an ordinary exchange,
   whose keys are rare by choice.

Defined results: a null or empty text, and one whose tokens do not spell a space
and the text on both sides (a normalised character, a literal U+2581), has no tokens: zeros and ''.
Repeated rows are aligned each; a null id stays null; strings of special
tokens are ordinary text; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import slices, texts_of
from noteloom.tables import scratch, written

#: Bytes of text that are aligned at a time.
TEXT_SLICE = 1 << 20
#: Pairs that are broadcast, at most: some 20 MB.
HEAVY = 1 << 20
#: Pairs that a task holds before it hands them on.
HELD = 1 << 19
#: What the two sides' tokens spell before every text.
LEAD = " "


class Vocabularies(NamedTuple):
    """Side A: rank file and split pattern.  Side B: a sentence-piece model, which adds the leading space itself."""

    ranks: str
    pattern: str
    model: str


def default_vocabularies() -> Vocabularies:
    """The rank file with the ids of byte_bpe_50k.json, and piece_bpe_32k.model."""
    import public_tokenizers as p

    return Vocabularies(p.path("byte_bpe_50k.tiktoken"), p.PATTERN, p.path("piece_bpe_32k.model"))


class Side:
    """One tokenizer: texts to lists of ids, and the bytes of each id."""

    def __init__(self, encode, spelled: list[bytes]):
        self.encode, self.spelled = encode, spelled
        self.length = np.array([len(b) for b in spelled], dtype=np.int64)

    def spells(self, ids: list[int], text: bytes) -> bool:
        return b"".join(map(self.spelled.__getitem__, ids)) == text


@cache
def sides(v: Vocabularies) -> tuple[Side, Side]:
    """Both tokenizers, loaded once a worker."""
    import sentencepiece
    import tiktoken

    with open(v.ranks, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    a_bytes = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        a_bytes[rank] = piece
    ranked = tiktoken.Encoding("ranks", pat_str=v.pattern, mergeable_ranks=ranks, special_tokens={})
    model = sentencepiece.SentencePieceProcessor(model_file=v.model)
    piece_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i in range(model.get_piece_size()) for p in [model.id_to_piece(i)]]
    return (
        Side(lambda texts: [ranked.encode_ordinary(LEAD + t) for t in texts], a_bytes),
        Side(lambda texts: model.encode(texts, num_threads=1), piece_bytes),
    )


def packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u2" if not ids or max(ids) < 1 << 16 else "<u4").tobytes()


def unpacked(column: pa.Array, counts: np.ndarray) -> np.ndarray:
    """All ids of a column of packed lists, one after another."""
    parts = []
    for value, n in zip(column.to_pylist(), counts.tolist()):
        if n:
            parts.append(np.frombuffer(value, dtype="<u2" if len(value) == 2 * n else "<u4"))
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


class Aligned(NamedTuple):
    """A slice's tokens in one byte space."""

    cut_a: np.ndarray  # per A token: a group ends with it
    cut_b: np.ndarray
    groups: np.ndarray  # per document
    link_a: np.ndarray  # per link: places of its tokens
    link_b: np.ndarray
    links: np.ndarray  # per document


def align(length_a: np.ndarray, length_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> Aligned:
    """Cuts and links of documents of n_a and n_b tokens with these byte lengths; a document's two sums are equal."""
    end_a, end_b = np.cumsum(length_a), np.cumsum(length_b)
    total = int(end_a[-1]) if len(end_a) else 0
    ends = np.bincount(np.concatenate([end_a, end_b]), minlength=total + 1)
    cut_a, cut_b = ends[end_a] == 2, ends[end_b] == 2
    at = np.flatnonzero(ends)
    of_a = np.zeros(total + 1, dtype=bool)
    of_a[end_a] = True
    is_a = of_a[at]
    is_b = ~is_a | (ends[at] == 2)
    link_a, link_b = np.cumsum(is_a) - is_a, np.cumsum(is_b) - is_b
    # a document with tokens on one side has some on the other: both spell it
    last_a = np.concatenate([[0], np.cumsum(cut_a)])[np.cumsum(n_a)]
    groups = np.diff(last_a, prepend=0)
    return Aligned(cut_a, cut_b, groups, link_a, link_b, n_a + n_b - groups)


@cache
def _numerals(size: int, mark: str) -> np.ndarray:
    """'0,' '1,' ... and, from ``size`` on, the same numbers with ``mark`` instead."""
    return np.array([f"{i}," for i in range(size)] + [f"{i}{mark}" for i in range(size)], dtype=object)


def spelled_groups(a: np.ndarray, b: np.ndarray, al: Aligned, n_a: np.ndarray, n_b: np.ndarray, size: int) -> list[str]:
    """Per document its groups as ``a1,a2|b1;a3|b2,b3``."""
    group_a, group_b = np.cumsum(al.cut_a) - al.cut_a, np.cumsum(al.cut_b) - al.cut_b
    n_groups = int(al.groups.sum())
    per_a, per_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    out = np.empty(len(a) + len(b), dtype=object)
    # a group's A tokens stand behind all B tokens of earlier groups, its B tokens behind its A tokens too
    out[np.arange(len(a)) + (np.cumsum(per_b) - per_b)[group_a]] = _numerals(size, "|")[a + size * al.cut_a]
    out[np.arange(len(b)) + np.cumsum(per_a)[group_b]] = _numerals(size, ";")[b + size * al.cut_b]
    ends = np.cumsum(n_a + n_b).tolist()
    return ["".join(out[s:e].tolist())[:-1] for s, e in zip([0, *ends[:-1]], ends)]


ENCODED = "doc_id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a binary, b binary"


def encoded(docs: DataFrame, vocabularies: Vocabularies, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row both token streams (packed ids), their groups and their digest."""
    rows = texts_of(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b = sides(vocabularies)
        size = max(len(side_a.length), len(side_b.length))
        for part in slices(batches, limit=TEXT_SLICE):
            texts = part.column("text").to_pylist()
            lists_a, lists_b = side_a.encode(texts), side_b.encode(texts)
            for k, text in enumerate(texts):
                whole = (LEAD + text).encode()
                if not text or not side_a.spells(lists_a[k], whole) or not side_b.spells(lists_b[k], whole):
                    lists_a[k], lists_b[k] = [], []
            n_a, n_b = np.array([len(x) for x in lists_a], dtype=np.int64), np.array([len(x) for x in lists_b], dtype=np.int64)
            a = np.fromiter(chain.from_iterable(lists_a), dtype=np.int64, count=int(n_a.sum()))
            b = np.fromiter(chain.from_iterable(lists_b), dtype=np.int64, count=int(n_b.sum()))
            al = align(side_a.length[a], side_b.length[b], n_a, n_b)
            texts_of_groups = spelled_groups(a, b, al, n_a, n_b, size)
            digests = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in texts_of_groups]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_a, n_b, al.groups, al.links)), pa.array(digests, pa.string()), *(pa.array([packed(x) for x in lists], pa.binary()) for lists in (lists_a, lists_b))],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b"],
            )

    return rows.mapInArrow(run, ENCODED.format(id=rows.schema["doc_id"].dataType.simpleString()))


def _linked(part: pa.RecordBatch, side_a: Side, side_b: Side) -> tuple[np.ndarray, np.ndarray]:
    """(pair of each link as one number, number of links of each row)."""
    n_a, n_b = (part.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
    a, b = unpacked(part.column("a"), n_a), unpacked(part.column("b"), n_b)
    al = align(side_a.length[a], side_b.length[b], n_a, n_b)
    return a[al.link_a] * len(side_b.length) + b[al.link_b], al.links


def link_counts(rows: DataFrame, vocabularies: Vocabularies) -> DataFrame:
    """(b, pair, n, best): how many links of ``encoded`` rows each id pair has; best: no pair of the same B id has more.

    ``pair`` is A's id times the size of B's vocabulary plus B's id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b = sides(vocabularies)
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def made():
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])

        for part in slices(batches, "a", TEXT_SLICE):
            new, n = np.unique(_linked(part, side_a, side_b)[0], return_counts=True)
            every, place = np.unique(np.concatenate([pairs, new]), return_inverse=True)
            summed = np.zeros(len(every), np.int64)
            summed[place[: len(pairs)]] += counts
            summed[place[len(pairs) :]] += n
            pairs, counts = every, summed
            if len(pairs) > HELD:
                yield made()
                pairs, counts = pairs[:0], counts[:0]
        yield made()

    size_b = len(sides(vocabularies)[1].length)
    per = written(rows.select("n_a", "n_b", "a", "b").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair") % size_b), "pairs")
    most = per.groupBy("b").agg(F.max("n").alias("most"))  # a row for each id of B at most
    return per.join(F.broadcast(most), "b").select("b", "pair", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent(counts: DataFrame, limit: int = HEAVY) -> tuple[int, bool]:
    """(least count of the pairs to broadcast, whether all pairs are among them); at most ``limit`` pairs have that count.

    Counts are told apart by eighths of a power of two, so the table that decides has a few hundred rows.
    """
    step = F.floor(F.log2("n") * 8)
    found = sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("pairs"), F.min("n").alias("least")).collect(), key=lambda r: -r.step)
    held, least = 0, None
    for r in found:
        if held + r.pairs > limit:
            return (least if least is not None else found[0].least + (1 << 62)), False
        held, least = held + r.pairs, r.least
    return (least or 1), True


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabularies: Vocabularies | None = None, limit: int = HEAVY) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    v = vocabularies or default_vocabularies()
    spark = docs.sparkSession
    # ids are most of what is written: compressed more tightly than other tables
    path, made = scratch(spark, "encoded"), encoded(docs, v, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    made.write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(made.schema).parquet(path)
    counts = written(link_counts(rows, v), "links")
    least, whole = frequent(counts, limit)
    heavy = counts.filter(F.col("n") >= least).select("pair", "n", "best").toArrow()
    by_pair = np.argsort(heavy.column("pair").to_numpy())
    sent = spark.sparkContext.broadcast(tuple(heavy.column(c).to_numpy()[by_pair] for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b = sides(v)
        pair, n, best = sent.value
        for part in slices(batches, "a", TEXT_SLICE):
            links, per_row = _linked(part, side_a, side_b)
            place = np.minimum(np.searchsorted(pair, links), max(len(pair) - 1, 0))
            known = pair[place] == links if len(pair) else np.zeros(len(links), bool)
            of = np.repeat(np.arange(part.num_rows), per_row)
            add = lambda x: np.concatenate([[0], np.cumsum(x)])[np.cumsum(per_row)]
            per = lambda x: np.diff(add(x), prepend=0)
            counted = np.where(known, n[place], 0) if len(pair) else np.zeros(len(links), np.int64)
            is_best = known & best[place] if len(pair) else known
            rare = np.flatnonzero(~known)
            ends = np.concatenate([[0], np.cumsum(np.bincount(of[rare], minlength=part.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")), pa.array(per(is_best), pa.int64()), pa.array(per(counted), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(links[rare], pa.int64()))],
                ["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "rare"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    done = rows.mapInArrow(run, f"doc_id {kind}, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rare array<long>")
    if not whole:
        done = written(done, "settled")
        few = done.select("row", F.explode("rare").alias("pair")).groupBy("row", "pair").agg(F.count(F.lit(1)).alias("times"))
        few = few.join(counts.filter(F.col("n") < least).select("pair", "n", "best"), "pair")
        few = few.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
        done = done.join(few, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))})
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
