"""A full index of a vault as one plan: files to notes, edges and scored chunks, then written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteloom import tables
from noteloom.operators import chunking, sections, structure
from noteloom.operators.mutations import archived_path, unclashed, upsert_notes
from noteloom.operators.notes import linking_to, names_of, note_tags, resolve_links
from noteloom.schema import ARCHIVE_FOLDER
from noteloom.sources import vault
from noteloom.store import BUCKETS, Change, Store
from noteloom.tables import written


@dataclass(frozen=True)
class Index:
    """Tables of an indexed vault; all lazy until written."""

    notes: DataFrame
    tags: DataFrame
    edges: DataFrame
    chunks: DataFrame
    chunk_edges: DataFrame

    def write(self, path: str) -> None:
        """A new version of the index, a folder per table; readers see it once it is complete.

        The version before stays, because this index may still be read from it.
        """
        spark = self.notes.sparkSession
        number = max(tables.versions(spark, path), default=-1) + 1
        for name, df in vars(self).items():
            vault.write_index(df, f"{path}/v{number}/{name}")
        tables.completed(spark, f"{path}/v{number}")
        tables.expired(spark, path)


def chunked(notes: DataFrame, strategy: str = "semantic") -> DataFrame:
    """Chunks of non-blank notes with importance and context; ``strategy`` is semantic or character."""
    full = notes.filter(F.coalesce(F.col("text"), F.lit("")) != "")
    if strategy == "character":
        return chunking.character_chunks(full)
    if strategy != "semantic":
        raise ValueError(f"unknown chunk strategy {strategy!r}")
    front = F.when(F.size("frontmatter") > 0, F.array_join(F.transform(F.map_entries("frontmatter"), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("null")))), "\n"))
    rows = sections.chunk_notes(full.withColumn("front", front) if "frontmatter" in full.columns else full, front_col="front" if "frontmatter" in full.columns else None)
    # in the partitioning by note that the rows have; a join by chunk would make them twice and move every text again
    return structure.with_context(structure.with_importance(rows))


def build(spark: SparkSession, root: str, name: str, strategy: str = "semantic") -> Index:
    """Everything that searches need of a vault."""
    notes = vault.notes(spark, root, name)
    chunks = chunked(notes, strategy)
    tree = structure.chunk_edges(chunks) if strategy == "semantic" else None
    return Index(notes, note_tags(notes), resolve_links(notes), chunks, tree if tree is not None else spark.createDataFrame([], "src string, dst string, rel string, ord int"))


def read(spark: SparkSession, path: str) -> Index:
    """The newest complete version of a written index."""
    done = tables.versions(spark, path)
    if not done:
        raise FileNotFoundError(f"no complete index in {path}")
    return Index(*[spark.read.parquet(f"{path}/v{done[-1]}/{n}") for n in ("notes", "tags", "edges", "chunks", "chunk_edges")])


def refreshed(index: Index, fresh: DataFrame) -> Index:
    """Some notes replaced: their chunks anew, and all edges, so that links from and to them stay right."""
    notes = upsert_notes(index.notes, fresh.select(index.notes.columns))
    chunks = upsert_notes(index.chunks, chunked(fresh).select(index.chunks.columns))
    return Index(notes, note_tags(notes), resolve_links(notes), chunks, structure.chunk_edges(chunks))


# --- the index as a store that is changed note by note -------------------------------------------

#: What the rows of each table are dealt by: their note.
KEYS = {"notes": "note_id", "tags": "note_id", "edges": "src", "chunks": "note_id", "chunk_edges": "regexp_extract(src, '^(.*)/chunk_[0-9]+$', 1)"}


def store(spark: SparkSession, root: str, buckets: int = BUCKETS) -> Store:
    return Store(spark, root, KEYS, buckets)


def put(to: Store, index: Index) -> int:
    """A whole index as a version of the store."""
    before = {n: to.read(n).select(F.expr(KEYS[n]).alias("key")) for n in KEYS} if to.versions() else {}
    return to.commit({n: Change(before.get(n), df) for n, df in vars(index).items()})


def get(of: Store, version: int | None = None) -> Index:
    """The index as of a version, by default the newest."""
    return Index(*[of.read(n, version=version) for n in KEYS])


def refresh(to: Store, fresh: DataFrame | None = None, gone: DataFrame | None = None) -> int:
    """Notes replaced or added (``fresh``), and notes deleted (``gone``: note_id), as one version over all tables.

    Links are resolved anew for the fresh notes and for those whose links name one of
    the notes concerned, as it was or as it is; only the buckets of these are written.
    """
    notes = to.read("notes")
    fresh = to.spark.createDataFrame([], notes.schema) if fresh is None else written(fresh.select(notes.columns), "fresh")
    ids = fresh.select(F.col("note_id").alias("key"))
    ids = written((ids if gone is None else ids.unionByName(gone.select(F.col("note_id").alias("key")))).distinct(), "changed")
    rest = notes.join(ids, notes["note_id"] == ids["key"], "left_anti")
    old = notes.join(ids, notes["note_id"] == ids["key"], "left_semi")
    touched = written(linking_to(rest, names_of(old.select("title", "stem").unionByName(fresh.select("title", "stem")))), "touched")
    after = rest.unionByName(fresh)
    sources = fresh.unionByName(rest.join(touched, "note_id", "left_semi").select(notes.columns))
    chunks = written(chunked(fresh).select(to.read("chunks").columns), "chunks")
    return to.commit({
        "notes": Change(ids, fresh),
        "tags": Change(ids, note_tags(fresh)),
        "edges": Change(ids.unionByName(touched.select(F.col("note_id").alias("key"))), resolve_links(after, sources)),
        "chunks": Change(ids, chunks),
        "chunk_edges": Change(ids, structure.chunk_edges(chunks)),
    })


def archive(to: Store, ids: DataFrame, folder: str = ARCHIVE_FOLDER, stamp: str = "archived") -> int:
    """Notes (note_id) moved to the archive folder: path, tags, chunks and the links of and to them change together or not at all.

    Where a path is taken already, also by another note that moves, the name gets a stamp or a number.
    """
    notes = to.read("notes")
    moving = written(notes.join(ids.select("note_id").distinct(), "note_id", "left_semi").select(notes.columns), "moving")
    named = moving.select(F.col("note_id").alias("old"), archived_path(F.col("note_id"), folder).alias("path"))
    staying = notes.join(moving.select("note_id"), "note_id", "left_anti").select(F.col("note_id").alias("path"))
    named = unclashed(named, staying, stamp)
    again = F.row_number().over(Window.partitionBy("path").orderBy("old"))
    named = named.withColumn("again", again).select("old", F.when(F.col("again") > 1, F.regexp_replace("path", F.lit(r"^(.*?)(\.[^./]*)?$"), F.concat(F.lit("$1 "), F.col("again").cast("string"), F.lit("$2")))).otherwise(F.col("path")).alias("new"))
    fresh = moving.join(named, moving["note_id"] == named["old"]).withColumns({"note_id": F.col("new"), **({"path": F.col("new")} if "path" in notes.columns else {})})
    return refresh(to, fresh.select(notes.columns), moving.select("note_id"))
