"""Line classes, runs and headers of texts, and chunks of a fixed number of characters (see ``sections`` for semantic ones)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions.text import trimmed
from noteloom.schema import CHUNK_OVERLAP, CHUNK_SIZE


def lines_of(docs: DataFrame, id_col: str = "note_id", text_col: str = "text") -> DataFrame:
    """(note_id, line, content): lines from 0."""
    return docs.select(F.col(id_col).alias("note_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line", "content"))


def line_type(line: Column) -> Column:
    s = trimmed(line)
    return (
        F.when(s == "", "empty")
        .when(s.startswith("#"), "header")
        .when(s.startswith("```"), "code_fence")
        .when(s.startswith(">"), "quote")
        .when(s.rlike(r"^(?:[-*+]|\d+\.)\s+"), "list_item")
        .when(s.startswith("|") & s.endswith("|"), "table_row")
        .when(s.rlike(r"^[-= ]+$"), "separator")
        .otherwise("text")
    )


def line_types(docs: DataFrame, id_col: str = "note_id", text_col: str = "text") -> DataFrame:
    return lines_of(docs, id_col, text_col).withColumn("line_type", line_type(F.col("content")))


def block_runs(typed: DataFrame) -> DataFrame:
    """(note_id, line_type, start_line, end_line): maximal runs of one line type."""
    w = Window.partitionBy("note_id").orderBy("line")
    new = F.when(F.col("line_type").eqNullSafe(F.lag("line_type").over(w)), 0).otherwise(1)
    run = F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return typed.withColumn("new", new).withColumn("run", run).groupBy("note_id", "run", "line_type").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line")).drop("run")


def headers(typed: DataFrame) -> DataFrame:
    """(note_id, line, level, header_text): header lines outside code fences."""
    w = Window.partitionBy("note_id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fences = F.sum(F.when(F.col("line_type") == "code_fence", 1).otherwise(0)).over(w)
    pattern = r"^(#{1,6})\s+(.+)$"
    found = typed.withColumn("fences", fences).filter((F.col("fences") % 2 == 0) & F.col("content").rlike(pattern))
    return found.select("note_id", "line", F.length(F.regexp_extract("content", pattern, 1)).alias("level"), trimmed(F.regexp_extract("content", pattern, 2)).alias("header_text"))


def _spans(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at + size < len(text):
        room = text[at : at + size]
        blank = max(map(room.rfind, " \n"))
        stop = at + (blank if blank > 0 else size)
        yield at, stop
        at = max(at + 1, stop - overlap)
    yield at, len(text)


def split_characters(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[str]:
    """Windows of ``size`` characters, ended at their last space or newline, each next one ``overlap`` before that; blank ones drop out."""
    if len(text) <= size:
        return [text]
    return [piece for a, b in _spans(text, size, overlap) if (piece := text[a:b].strip())]


def character_chunks(docs: DataFrame, id_col: str = "note_id", text_col: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(note_id, chunk_id, seq, content)."""
    rows = docs.select(F.col(id_col).cast("string").alias("note_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A text at a time, so that a task holds the chunks of one."""
        for batch in batches:
            for note, text in zip(batch.column("note_id"), batch.column("text")):
                name, parts = note.as_py(), split_characters(text.as_py(), size, overlap)
                ids = [None if name is None else f"{name}#chunk={k}" for k in range(len(parts))]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(parts), pa.string()), pa.array(ids, pa.string()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], ["note_id", "chunk_id", "seq", "content"])

    return rows.mapInArrow(run, "note_id string, chunk_id string, seq int, content string")
