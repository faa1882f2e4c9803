"""Changes to notes and chunks as functions from tables to tables."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.functions.text import safe_title, trimmed
from noteloom.schema import ARCHIVE_FOLDER, INBOX_FOLDER

# Fixed values of the metadata sanitiser.
STRING_LIMIT, LIST_LIMIT, KEY_LIMIT, CUT_MARK = 50_000, 100, 100, "...[truncated]"
#: Texts that a Python worker holds changed at a time.
TEXTS = 128


def upsert_notes(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """All chunks of the fresh notes replaced."""
    return chunks.join(fresh.select("note_id").distinct(), "note_id", "left_anti").select(fresh.columns).unionByName(fresh)


def delete_notes(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids.select("note_id"), "note_id", "left_anti")


def sanitized_number(c: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def sanitized_string(c: Column, limit: int = STRING_LIMIT) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(CUT_MARK))).otherwise(c)


def sanitized_list(c: Column, limit: int = LIST_LIMIT) -> Column:
    return F.array_join(F.slice(c, 1, limit), ",")


def sanitized_map(c: Column) -> Column:
    return F.to_json(c)


def merge_properties(old: Column, new: Column, merge: bool = True) -> Column:
    """New properties over old ones, or instead of them."""
    if not merge:
        return new
    kept = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(kept, new)


def add_content(text: Column, extra: Column, at_end: bool = True) -> Column:
    return F.concat(text, F.lit("\n\n"), extra) if at_end else F.concat(extra, F.lit("\n\n"), text)


def archived_path(path: Column, folder: str = ARCHIVE_FOLDER) -> Column:
    return F.concat(F.lit(folder + "/"), F.regexp_extract(path, r"([^/]+)$", 1))


def created_note(title: Column, content: Column, tags: Column, folder: str | None = None, para_type: Column | None = None) -> dict[str, Column]:
    """Path, title, tags (ordered, without '#', each once) and text of a new note."""
    name = F.coalesce(F.nullif(safe_title(title), F.lit("")), F.lit("Untitled"))
    plain = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.regexp_replace(trimmed(t), "^#+", ""))
    every = plain if para_type is None else F.when(para_type.isNotNull(), F.concat(plain, F.array(F.concat(F.lit("para/"), para_type)))).otherwise(plain)
    return {"path": F.concat(F.lit(f"{folder or INBOX_FOLDER}/"), name, F.lit(".md")), "title": title, "tags": F.array_distinct(F.filter(every, lambda t: t != "")), "text": content}


def unclashed(notes: DataFrame, taken: DataFrame, stamp: str) -> DataFrame:
    """Notes (path); a path already taken gets the stamp before its suffix."""
    hit = taken.select("path", F.lit(True).alias("hit")).distinct()
    return notes.join(hit, "path", "left").withColumn("path", F.when(F.col("hit"), F.regexp_replace("path", r"\.md$", f" {stamp}.md")).otherwise(F.col("path"))).drop("hit")


def replaced_section(text: str, heading: str, content: str, level: int | None = None) -> str:
    """The section's body replaced; it ends at the next header of its level or less.  Fenced lines are no headers."""
    plain = lambda s: re.sub(r"\s+", " ", s).strip().lower()
    lines, fenced, begin, own = text.split("\n"), False, None, 0
    end = len(lines)
    for i, line in enumerate(lines):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        m = None if fenced else re.match(r"^(#{1,6})\s+(.+?)\s*$", line)
        if not m:
            continue
        if begin is None:
            if plain(m[2]) == plain(heading) and level in (None, len(m[1])):
                begin, own = i, len(m[1])
        elif len(m[1]) <= own:
            end = i
            break
    if begin is None:
        raise ValueError(f"no section {heading!r}")
    tail = lines[end:]
    return "\n".join([*lines[: begin + 1], "", content.strip("\n"), *([""] if tail else []), *tail])


def replace_sections(notes: DataFrame, heading: str, content: str, level: int | None = None) -> DataFrame:
    """Every note (note_id, text) that has the section, with it replaced; others as they are."""
    rows = notes.select("note_id", "text")

    def changed(text: str | None) -> str | None:
        try:
            return replaced_section(text or "", heading, content, level)
        except ValueError:
            return text

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                part = batch.slice(k, TEXTS)
                texts = pa.array([changed(t.as_py()) for t in part.column("text")], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("note_id"), texts], ["note_id", "text"])

    return rows.mapInArrow(run, rows.schema)


def enrich_tags(tags: Column, para_type: Column, category: Column) -> Column:
    """Tags with para/{type} and para/{type}/{category}, sorted, each once."""
    slugged = F.regexp_replace(F.lower(category), r"[ _]+", "-")
    more = F.filter(F.array(F.concat(F.lit("para/"), para_type), F.concat(F.lit("para/"), para_type, F.lit("/"), slugged)), lambda t: t.isNotNull())
    return F.array_sort(F.array_union(F.coalesce(tags, F.array().cast("array<string>")), more))
