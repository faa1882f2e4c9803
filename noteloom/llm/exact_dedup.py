"""Exact deduplication with a heavy-hitter split; DataFrame operations only.

1. A Misra-Gries summary over the SHA-256 digests (``DataFrame.freqItems``: one
   bounded map of counters per task, merged) names every digest whose share of
   the rows exceeds ``support``, at most ``1 / support`` of them.
2. An aggregation over those candidates alone verifies their true counts and
   finds each one's row to keep.  These winners (bounded by ``1 / support``
   rows, whatever the input) are broadcast and settle the copies map-side.
3. The remaining digests go through one ordinary shuffle, combined map-side; those
   that repeat come back to their rows by a join that adaptive execution can
   split, or by broadcast where a count shows that they are few.

Defined results: a null text is ''; equal means equal UTF-8 bytes; the row
with the largest id stays (a null id is below all others); of rows equal in id
and text as well, one stays; an empty table gives an empty result.  Other
columns of the input are never read for the decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import few, fresh, texts_of, written

#: Share of the rows above which a digest counts as heavy.
SUPPORT = 1e-3


def _digest(col: str = "text"):
    return F.sha2(F.col(col).cast("binary"), 256)


def heavy_digests(digests: DataFrame, order: str, support: float = SUPPORT) -> DataFrame:
    """Verified heavy digests: (digest, n, top), top being the largest ``order``; at most 1 / support rows."""
    named = digests.freqItems(["digest"], support).select(F.explode(F.col("digest_freqItems")).alias("digest"))
    return (
        digests.join(F.broadcast(named), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.max(order).alias("top"))
        .filter("n > 1")
    )


def _repeated(rows: DataFrame, order: str, support: float) -> tuple[DataFrame, DataFrame]:
    """Digests that occur twice or more, as (digest, n, top): the heavy ones for a broadcast, and the rest."""
    winners = F.broadcast(written(heavy_digests(rows, order, support), "heavy"))
    light = rows.join(winners, "digest", "left_anti").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(order).alias("top")).filter("n > 1")
    return winners, few(written(light, "light"))


def duplicate_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = texts_of(docs, id_col, text_col).select("doc_id", _digest().alias("digest"))
    rows = written(rows.withColumn("place", F.struct("doc_id", F.monotonically_increasing_id().alias("row"))), "digests")
    winners, light = _repeated(rows, "place", support)
    heavy = rows.join(winners, "digest")
    single = rows.join(winners, "digest", "left_anti").join(light, "digest", "left").withColumns({"n": F.coalesce("n", F.lit(1).cast("long")), "top": F.coalesce("top", "place")})
    return heavy.unionByName(single).select(
        "doc_id",
        F.col("top.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("place") == F.col("top")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    mark, best = fresh(docs.columns, 2)
    ids = F.col(f"`{id_col}`")
    rows = written(texts_of(docs, id_col, text_col).select("doc_id", _digest().alias("digest")), "digests")
    per = written(rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"), "times")
    # structs, because a null id is a winner too where there is no other
    winners, light = _repeated(rows.withColumn("place", F.struct("doc_id")), "place", support)
    keyed = docs.withColumn(mark, F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary"), 256))
    own = [F.col(f"`{c}`") for c in docs.columns]

    def staying(keyed: DataFrame) -> DataFrame:
        named = [t.select(F.col("digest").alias(mark), F.col("top").alias(best)) for t in (winners, light)]
        heavy = keyed.join(F.broadcast(named[0]), mark)
        rest = keyed.join(F.broadcast(named[0]), mark, "left_anti").join(named[1], mark, "left")
        return heavy.unionByName(rest).filter(F.col(best).isNull() | ids.eqNullSafe(F.col(f"{best}.doc_id"))).select(*own, mark)

    out = staying(keyed)
    if per.isEmpty():
        return out.select(*own)
    again = few(written(per.select(F.col("digest").alias(mark)).distinct(), "again"))
    # of rows equal in id and text one stays: only these take another exchange
    return out.join(again, mark, "left_anti").select(*own).unionByName(out.join(again, mark, "left_semi").dropDuplicates([mark]).select(*own))
