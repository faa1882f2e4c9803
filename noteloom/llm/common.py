"""What the training-data operators share: column views, scratch tables, Arrow slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.tables import discard, written  # noqa: F401

#: Bytes of text that a Python worker holds as objects at a time.
SLICE_BYTES = 4 << 20
#: Rows of a table of keys that is broadcast rather than exchanged, at most (each takes some 200 bytes).
BROADCAST_ROWS = 200_000


def few(df: DataFrame) -> DataFrame:
    """``df`` (a written table of keys) marked for broadcast if it has BROADCAST_ROWS rows at most; else as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def fresh(columns: list[str], n: int) -> list[str]:
    """``n`` column names that none of ``columns`` is equal to, whatever their case."""
    used = {c.lower() for c in columns}
    free = (f"own_{k}" for k in range(len(columns) + n))
    return [c for c in free if c not in used][:n]


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns whatever else ``docs`` holds: doc_id as it is, text with null as ''."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def held_out(id_col: str, mod: int, at: int):
    """crc32 of the id as text, mod ``mod``, equals ``at``; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod == at


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of each piece stay near ``limit`` bytes (one text may be longer)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


#: For bytes.translate: A-Z to a-z.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
