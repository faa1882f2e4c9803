"""The engine's tables read off the relational test tables, and the same as SQL.

documents become notes, embeddings their vectors with ten chunks to a note,
conversations chunk sequences, supplier-part pairs a link graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.operators import structure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    tags = F.array(F.concat(F.lit("lang/"), "lang"), F.concat(F.lit("source/"), "lang", F.lit("/"), "source"), F.concat(F.lit("quality/"), F.col("quality").cast("string")))
    path = F.concat("source", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    return d.select("doc_id", path.alias("note_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("title"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("stem"), F.col("lang").alias("vault"), "source", "text", "quality", F.filter(tags, lambda t: t.isNotNull()).alias("tags"))


NOTES = """notes AS (
  SELECT d.doc_id, source || '/doc-' || d.doc_id || '.md' AS note_id, 'doc-' || d.doc_id AS title, lang AS vault, source, text, quality,
         list_filter(['lang/' || lang, 'source/' || lang || '/' || source, 'quality/' || quality], lambda t: t IS NOT NULL) AS tags
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id))"""
NOTE_TAGS = NOTES + ", note_tags AS (SELECT note_id, unnest(tags) AS tag FROM notes)"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): each supplier to the parts it delivers."""
    pairs = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()  # numbers are exchanged, not names
    return pairs.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))


LINKS = "links AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, a note per conversation and a chunk per turn."""
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "system", "frontmatter").when(F.col("role") == "user", "section").otherwise("paragraph")
    note = F.concat(F.lit("conv-"), F.col("conv_id").cast("string"))
    chunks = c.select(
        F.concat(note, F.lit("/chunk_"), F.col("turn").cast("string")).alias("chunk_id"), note.alias("note_id"), F.col("turn").alias("seq"), kind.alias("chunk_type"), F.coalesce("text", F.lit("")).alias("content"),
        (1 + F.col("turn") % 3).cast("int").alias("header_level"), F.split_part(F.coalesce("text", F.lit("")), F.lit(" "), F.lit(1)).alias("header_text"),
        F.array().cast("array<string>").alias("contains_tags"), F.array().cast("array<string>").alias("contains_links"),
    )
    return structure.with_importance(chunks)


_IMPORTANCE = """greatest(0.0, least(1.0, 0.5 + (7 - header_level) * 0.1
    + CASE WHEN place / greatest(total - 1, 1)::DOUBLE < 0.2 OR place / greatest(total - 1, 1)::DOUBLE > 0.8 THEN 0.1 ELSE 0 END
    + CASE chunk_type WHEN 'section' THEN 0.1 WHEN 'frontmatter' THEN -0.2 ELSE 0 END
    + CASE WHEN length(content) BETWEEN 200 AND 1000 THEN 0.05 WHEN length(content) < 100 THEN -0.1 ELSE 0 END))::DOUBLE AS importance_score"""

TURNS = f"""turns0 AS (
  SELECT 'conv-' || conv_id || '/chunk_' || turn AS chunk_id, 'conv-' || conv_id AS note_id, turn AS seq,
         CASE role WHEN 'system' THEN 'frontmatter' WHEN 'user' THEN 'section' ELSE 'paragraph' END AS chunk_type,
         coalesce(text, '') AS content, (1 + turn % 3)::INT AS header_level, split_part(coalesce(text, ''), ' ', 1) AS header_text
  FROM conversations),
chunks AS (SELECT * EXCLUDE (place, total), {_IMPORTANCE} FROM (
  SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY seq) - 1 AS place, count(*) OVER (PARTITION BY note_id) AS total FROM turns0))"""


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with vectors, ten to a note; contents are the documents of the same number."""
    e = table(spark, sf_dir, "embeddings")
    d = notes(spark, sf_dir).select("doc_id", "text", "source", "tags")
    chunks = e.join(d, e["vec_id"] == d["doc_id"], "left").select(
        F.concat(F.lit("vec-"), F.col("vec_id").cast("string")).alias("chunk_id"), F.concat(F.lit("note-"), F.floor(F.col("vec_id") / 10).cast("string")).alias("note_id"), F.col("vec_id").alias("seq"),
        F.when(F.col("label") % 2 == 0, "section").otherwise("paragraph").alias("chunk_type"), F.coalesce("text", F.lit("")).alias("content"), (1 + F.col("vec_id") % 3).cast("int").alias("header_level"),
        F.coalesce("source", F.lit("")).alias("header_text"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.array().cast("array<string>").alias("contains_tags"), F.array().cast("array<string>").alias("contains_links"), "embedding", "label",
    )
    return structure.with_importance(chunks)


PASSAGES = (
    NOTES
    + f""", passages0 AS (
  SELECT 'vec-' || vec_id AS chunk_id, 'note-' || (vec_id // 10) AS note_id, vec_id AS seq, CASE WHEN label % 2 = 0 THEN 'section' ELSE 'paragraph' END AS chunk_type,
         coalesce(n.text, '') AS content, (1 + vec_id % 3)::INT AS header_level, coalesce(n.source, '') AS header_text, coalesce(n.tags, []) AS tags, embedding, label
  FROM embeddings e LEFT JOIN notes n ON n.doc_id = e.vec_id),
chunks AS (SELECT * EXCLUDE (place, total), {_IMPORTANCE} FROM (
  SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY seq) - 1 AS place, count(*) OVER (PARTITION BY note_id) AS total FROM passages0))"""
)

#: Relations between chunks, over a CTE ``chunks``.
EDGES = """parents AS (
  SELECT c.*, (SELECT max(p.seq) FROM chunks p WHERE p.note_id = c.note_id AND p.seq < c.seq AND p.header_level < c.header_level) AS parent_seq FROM chunks c),
tree AS (SELECT c.*, p.chunk_id AS parent_id, p.header_level AS above FROM parents c LEFT JOIN chunks p ON p.note_id = c.note_id AND p.seq = c.parent_seq),
near AS (SELECT chunk_id, lead(chunk_id) OVER w AS nxt, lag(chunk_id) OVER w AS prv FROM chunks WINDOW w AS (PARTITION BY note_id ORDER BY seq)),
edges AS (
  SELECT chunk_id AS src, nxt AS dst, 'sequential_next' AS rel, 1 AS ord FROM near WHERE nxt IS NOT NULL
  UNION ALL SELECT chunk_id, prv, 'sequential_prev', 2 FROM near WHERE prv IS NOT NULL
  UNION ALL SELECT chunk_id, parent_id, 'parent', 3 FROM tree WHERE parent_id IS NOT NULL
  UNION ALL SELECT parent_id, chunk_id, 'child', 4 FROM tree WHERE parent_id IS NOT NULL AND header_level = above + 1
  UNION ALL SELECT a.chunk_id, b.chunk_id, 'sibling', 5 FROM tree a JOIN tree b ON a.note_id = b.note_id AND a.header_level = b.header_level AND a.parent_id IS NOT DISTINCT FROM b.parent_id AND a.chunk_id <> b.chunk_id)"""

#: The eight passages nearest to vec-7, over ``chunks``.
NEAR = """near8 AS (
  SELECT chunk_id, round(pow(list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 2), 9) AS distance
  FROM chunks ORDER BY distance, chunk_id LIMIT 8)"""
