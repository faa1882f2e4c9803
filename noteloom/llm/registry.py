"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``score`` is the model that learns from the training rows; the vocabulary's own marginal stands beside it."""
    from noteloom.llm.lm_score import lm_scores

    made = lm_scores(_table(spark, sf_dir, "documents"))
    return made.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", F.col("fitted_score").alias("score"), F.col("score").alias("vocabulary_score"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from noteloom.llm.suffix_dedup import repeat_report

    return repeat_report(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from noteloom.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from noteloom.llm.toxicity import toxicity_scores

    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from noteloom.llm.simhash import near_duplicate_report

    return near_duplicate_report(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from noteloom.llm.decontaminate import contamination_report

    return contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from noteloom.llm.exact_dedup import duplicate_report

    return duplicate_report(_table(spark, sf_dir, "documents"))


def op8_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from noteloom.llm.quality_crf import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from noteloom.llm.secret_scan import secret_report

    return secret_report(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from noteloom.llm.url_filter import url_verdicts

    return url_verdicts(_table(spark, sf_dir, "pages"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from noteloom.llm.conversation import repair_report

    return repair_report(_table(spark, sf_dir, "conversations"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from noteloom.llm.warc import archive_report

    return archive_report(_table(spark, sf_dir, "pages"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from noteloom.llm.alignment import aligned

    return aligned(_table(spark, sf_dir, "documents"))


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS key FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT row, s, n, array_to_string(w[s:s + n - 1], ' ') AS key FROM d, sizes, unnest(range(1, len(w) - n + 2)) t(s)),
found AS (SELECT row, s, n, item FROM places JOIN windows USING (n, key)),
hit AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT row, s, n FROM found) f, unnest(range(s, s + n)) t(p) GROUP BY row),
named AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM found) GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (row) LEFT JOIN named USING (row)
"""


OP12_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, row_number() OVER () AS r FROM pages),
o AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s, first_value(page_id) OVER w AS top, row_number() OVER w AS k FROM p WINDOW w AS (PARTITION BY h ORDER BY page_id DESC NULLS LAST, r))
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform([1, 11, 21, 31], lambda x: translate(to_base(concat('0x', substr(s, x, 10))::BIGINT, 32, 8), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')), '') AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN top END AS refers_to
FROM o
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_score, op2_suffix_dedup, op3_packing, op4_toxicity, op5_simhash, op6_decontamination, op7_exact_dedup, op8_quality_crf, op9_secret_scan, op10_url_filter, op11_conversation_repair, op12_warc, op13_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op6_decontamination": OP6_SQL, "op7_exact_dedup": OP7_SQL, "op12_warc": OP12_SQL}
