"""Files of a vault as tables: notes, drawings and base definitions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions.text import body_tags, links, trimmed
from noteloom.schema import EXTENSIONS

FRONT = re.compile(r"\A---\s*\n(.*?)\n---\s*(?:\n|\Z)", re.DOTALL)
#: Front-matter keys that are not kept as properties.
SKIPPED = {"title", "tags", "content", "body", "text", "description", "summary", "abstract"}
LONGEST_VALUE, MOST_ITEMS, LONGEST_ITEM = 500, 20, 100


def files(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, recursive: bool = True) -> DataFrame:
    """(path, rel, name, ext, size, mtime, content): files by extension (any case), none below a dotted folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root)
    rel = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), "^" + re.escape(re.sub(r"^\w+:/*", "/", root.rstrip("/"))) + "/+", "")
    rows = raw.withColumn("rel", F.url_decode(F.replace(rel, F.lit("+"), F.lit("%2B")))).withColumn("name", F.regexp_extract("rel", r"([^/]+)$", 1)).withColumn("ext", F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1)))
    return rows.filter(F.col("ext").isin(list(extensions)) & ~F.exists(F.split("rel", "/"), lambda p: p.startswith("."))).select("path", "rel", "name", "ext", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


def _value(v: object) -> str | None:
    if v is None:
        return None
    if isinstance(v, (list, tuple)):
        return ", ".join(str(x)[:LONGEST_ITEM] for x in v[:MOST_ITEMS])
    if isinstance(v, dict):
        return f"[dict with {len(v)} items]"
    s = v.isoformat() if hasattr(v, "isoformat") else str(v)
    return s if len(s) <= LONGEST_VALUE else s[: LONGEST_VALUE - 3] + "..."


def _simple_yaml(block: str) -> dict:
    """Flat keys, inline and block lists: what notes use, for where no YAML parser is installed."""
    out: dict = {}
    key = None
    plain = lambda s: s.strip().strip("'\"")
    for line in block.split("\n"):
        if m := re.match(r"^([\w .-]+):\s*(.*)$", line):
            key, rest = m[1].strip(), m[2].strip()
            out[key] = [plain(x) for x in rest[1:-1].split(",") if x.strip()] if rest.startswith("[") and rest.endswith("]") else plain(rest) if rest else None
        elif (m := re.match(r"^\s*-\s+(.*)$", line)) and key:
            out[key] = [*(out[key] if isinstance(out[key], list) else []), plain(m[1])]
    return out


def front_matter(text: str) -> tuple[dict, str]:
    """(properties, body); text whose block cannot be read is body as a whole."""
    m = FRONT.match(text)
    if not m:
        return {}, text
    try:
        import yaml

        data = yaml.safe_load(m[1])
    except ImportError:
        data = _simple_yaml(m[1])
    except Exception:
        return {}, text
    return (data, text[m.end() :]) if isinstance(data, dict) else ({}, text)


def _tags(v: object) -> list[str]:
    items = re.split(r"[,\s]+", v) if isinstance(v, str) else [str(x) for x in v] if isinstance(v, (list, tuple)) else []
    return [t.lstrip("#") for t in items if t.lstrip("#")]


_READ = "rel string, name string, ext string, size long, mtime timestamp, title string, fm_tags array<string>, frontmatter map<string,string>, body string"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            data, body = front_matter(bytes(r.content).decode("utf-8", "ignore"))
            kept = {str(k): _value(v) for k, v in data.items() if k not in SKIPPED}
            rows.append((r.rel, r.name, r.ext, r.size, r.mtime, None if data.get("title") is None else str(data["title"]), _tags(data.get("tags")), kept, body))
        yield pd.DataFrame(rows, columns=["rel", "name", "ext", "size", "mtime", "title", "fm_tags", "frontmatter", "body"])


def notes(spark: SparkSession, root: str, vault: str) -> DataFrame:
    """Notes of a vault (see ``schema.NOTES``); ids are paths relative to it."""
    found = files(spark, root).filter(F.col("ext") != ".base")
    drawn = F.concat_ws("\n", F.filter(F.from_json(F.decode("content", "UTF-8"), "elements array<struct<text:string>>")["elements"]["text"], lambda t: t.isNotNull()))
    stem = F.regexp_replace("name", r"\.[^.]+$", "")
    text = found.filter(F.col("ext") != ".excalidraw").select("rel", "name", "ext", "size", "mtime", "content").mapInPandas(_read, _READ)
    drawings = found.filter(F.col("ext") == ".excalidraw").select("rel", "name", "ext", "size", "mtime", F.lit(None).cast("string").alias("title"), F.array().cast("array<string>").alias("fm_tags"), F.create_map().cast("map<string,string>").alias("frontmatter"), F.coalesce(F.nullif(drawn, F.lit("")), stem).alias("body"))
    rows = text.unionByName(drawings).withColumn("stem", stem)
    return rows.select(
        F.col("rel").alias("note_id"), F.lit(vault).alias("vault"), F.col("rel").alias("path"), "stem",
        F.coalesce(F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("stem"), F.lit("")), F.lit("Untitled")).alias("title"),
        trimmed(F.col("body")).alias("text"), F.array_sort(F.array_distinct(F.concat(body_tags(F.col("body")), "fm_tags"))).alias("tags"), links(F.col("body")).alias("links"), "frontmatter",
        F.struct("name", F.col("rel").alias("path"), "ext", "size", "mtime").alias("file"), F.length(trimmed(F.col("body"))).alias("text_length"),
    )


def bases(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(name, rel, size, mtime, definition) of base files, by name."""
    return files(spark, root, (".base",), recursive).select("name", "rel", "size", "mtime", F.decode("content", "UTF-8").alias("definition")).orderBy("name", "rel")


def base_exists(listed: DataFrame, base_id: str) -> DataFrame:
    """(name, exact): the base itself, or those with a like name."""
    stem = F.regexp_replace("name", r"\.base$", "")
    return listed.select("name", (stem == base_id).alias("exact"), F.lower(stem).contains(base_id.lower()).alias("like")).filter("exact or like").select("name", "exact")


def write_index(chunks: DataFrame, path: str) -> None:
    """A full index, replacing what is there, partitioned for pruning by vault where chunks carry one."""
    writer = chunks.write.mode("overwrite")
    (writer.partitionBy("vault") if "vault" in chunks.columns else writer).parquet(path)
