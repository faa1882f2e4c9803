"""Schemas of notes, chunks and edges, and the constants of indexing and search."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
_SA = T.ArrayType(_S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


NOTES = _struct(
    note_id=_S, vault=_S, path=_S, stem=_S, title=_S, text=_S, tags=_SA, links=_SA, frontmatter=T.MapType(_S, _S),
    file=_struct(name=_S, path=_S, ext=_S, size=_L, mtime=T.TimestampType()), text_length=_I,
)
CHUNKS = _struct(
    chunk_id=_S, note_id=_S, position=_I, seq=_I, chunk_type=_S, content=_S, header_text=_S, header_level=_I, parent_headers=_SA, start_line=_I, end_line=_I,
    contains_tags=_SA, contains_links=_SA, importance_score=_D, preceding_context=_S, following_context=_S,
)

# Fixed values of indexing and search.
EXTENSIONS = (".md", ".markdown", ".txt", ".excalidraw", ".base")
CHUNK_SIZE, CHUNK_OVERLAP = 1800, 200
MAX_CHUNK, MERGE_BELOW, LEAST_PARAGRAPH = 3000, 200, 50
CONFIDENCE_THRESHOLD = 0.55
DEEP_LINK = "obsidian://open"  # scheme of links that open a note
ARCHIVE_FOLDER = "Archive"
INBOX_FOLDER = "00 Inbox"
RELATION_WEIGHTS = {"sequential_next": 0.8, "sequential_prev": 0.8, "parent": 0.9, "child": 0.7, "sibling": 0.6, "content_link": 0.9}
OTHER_WEIGHT, DEPTH_DECAY = 0.5, 0.8
TYPE_BONUS = {"section": 0.1, "frontmatter": -0.2, "code_block": 0.05, "table": 0.05}
