"""Semantic chunks of notes as one plan over lines: sections, blocks and paragraphs by windows, packing and merging as folds.

Lines go through one exchange, by note; everything after it keeps that partitioning.
A section that fits is one chunk; of a longer one (and of what stands before the
first header) each fenced block, list, quote and table is a chunk, and so is each
paragraph between them, split where it is too long.  Short neighbours of one kind are merged.

Fences that are never closed are ordinary lines; headers inside fences are none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.schema import LEAST_PARAGRAPH, MAX_CHUNK, MERGE_BELOW

# What headers, blocks, rules, tags and links look like.
FENCE = "```"
HEADER = r"(?dU)^(#{1,6})\s+(.+)$"
KINDS = (("list", r"(?U)^\s*(?:[-*+]|\d+\.)\s+"), ("quote", r"(?U)^\s*>"), ("table", r"(?dU)^\s*\|.*\|\s*$"))
RULE = r"\n(?:---|___|\*\*\*)\n"
TAG, LINK = r"#([\p{L}\p{N}_][\p{L}\p{N}_/-]+)", r"\[\[([^\]]+)\]\]"
LEVELS = 6


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def packed(parts: Column, joint: str, size: int = MAX_CHUNK) -> Column:
    """Parts of an array joined in order while they fit, each stripped; one that is too long stands alone."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))
    full = lambda a, p: (a["held"] != "") & (F.length(a["held"]) + F.length(p) + len(joint) > size)
    step = lambda a, p: F.struct(
        F.when(full(a, p), F.concat(a["out"], F.array(_stripped(a["held"])))).otherwise(a["out"]).alias("out"),
        F.when(full(a, p) | (a["held"] == ""), p).otherwise(F.concat(a["held"], F.lit(joint), p)).alias("held"),
    )
    done = lambda a: F.when(_stripped(a["held"]) != "", F.concat(a["out"], F.array(_stripped(a["held"])))).otherwise(a["out"])
    return F.aggregate(parts, start, step, done)


def split_large(text: Column, size: int = MAX_CHUNK) -> Column:
    """An array: the text itself if it fits, else cut at rules, at blank lines, or at line ends, in order of preference.

    What lies between rules holds no further rule (a rule needs a line break of its own on both sides), so one level is enough.
    """

    def without_rules(t: Column) -> Column:
        paragraphs = F.split(t, "\n\n")
        cut = F.when(F.size(paragraphs) > 1, packed(paragraphs, "\n\n", size)).otherwise(packed(F.split(t, "\n"), "\n", size))
        return F.when(F.length(t) <= size, F.array(t)).otherwise(cut)

    rules = F.split(text, RULE)
    between = F.flatten(F.transform(F.filter(F.transform(rules, _stripped), lambda r: r != ""), without_rules))
    return F.when(F.length(text) <= size, F.array(text)).when(F.size(rules) > 1, between).otherwise(without_rules(text))


def _kind(line: Column) -> Column:
    return F.coalesce(*[F.when(line.rlike(p), name) for name, p in KINDS])


def lines_in_sections(notes: DataFrame, id_col: str = "note_id", text_col: str = "text") -> DataFrame:
    """(note_id, line, content, section, head, level, title): every line with the number of its section, 0 before the first header."""
    rows = notes.select(F.col(id_col).cast("string").alias("note_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line", "content"))
    so_far = Window.partitionBy("note_id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = F.sum(F.col("content").startswith(FENCE).cast("int")).over(so_far) % 2 == 1
    found = rows.repartition("note_id").withColumn("head", ~open_ & F.col("content").rlike(HEADER))
    level = F.when(F.col("head"), F.length(F.regexp_extract("content", HEADER, 1)))
    title = F.when(F.col("head"), _stripped(F.regexp_extract("content", HEADER, 2)))
    return found.withColumns({"section": F.sum(F.col("head").cast("int")).over(so_far).cast("int"), "level": level, "title": title})


def sections(lines: DataFrame) -> DataFrame:
    """(note_id, section, start_line, end_line, size, level, title, above): sections with the headers above them from the top."""
    per = lines.groupBy("note_id", "section").agg(
        F.min("line").alias("start_line"), F.max("line").alias("end_line"), (F.sum(F.length("content") + 1) - 1).alias("size"), F.max("level").alias("level"), F.max_by("title", F.col("head").cast("int")).alias("title"),
    )
    before = Window.partitionBy("note_id").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.col("level") == k, F.struct("section", "title")), ignorenulls=True).over(before) for k in range(1, LEVELS)}
    per = per.withColumns({f"h{k}": c for k, c in last.items()})
    steps = []
    for k in range(1, LEVELS):  # a header counts until one of its level or less comes after it
        stands = (F.col("level") > k) & F.col(f"h{k}").isNotNull()
        for j in range(1, k):
            stands = stands & (F.coalesce(F.col(f"h{j}.section"), F.lit(-1)) < F.col(f"h{k}.section"))
        steps.append(F.when(stands, F.col(f"h{k}.title")))
    return per.withColumn("above", F.filter(F.array(*steps), lambda t: t.isNotNull())).drop(*last and [f"h{k}" for k in last])


def blocks(body: DataFrame) -> DataFrame:
    """(note_id, section, kind, start_line, end_line, text) of lines of bodies: code, lists, quotes, tables and the paragraphs between."""
    part = Window.partitionBy("note_id", "section")
    so_far = part.orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fence = F.col("content").startswith(FENCE)
    rows = body.withColumns({"fences": F.sum(fence.cast("int")).over(so_far), "all": F.sum(fence.cast("int")).over(part)})
    closed = F.col("fences") <= F.col("all") - F.col("all") % 2
    code = closed & ((F.col("fences") % 2 == 1) | fence)
    rows = rows.withColumn("kind", F.when(code, "code_block").otherwise(F.coalesce(_kind(F.col("content")), F.lit("paragraph"))))
    mark = F.struct("kind", F.when(code, F.ceil(F.col("fences") / 2)))
    rows = rows.withColumn("mark", mark).withColumn("new", F.when(F.col("mark").eqNullSafe(F.lag("mark").over(part.orderBy("line"))), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("new").over(so_far))
    inside = F.when((F.col("kind") != "code_block") | ~fence, F.struct("line", "content"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(inside)), lambda x: x["content"]), "\n")
    return rows.groupBy("note_id", "section", "run", "kind").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), text.alias("text"))


def _merged(chunks: DataFrame, below: int) -> DataFrame:
    """Neighbours of one note, kind and header folded while both are short; chunks have ``place``, their order in the note."""
    row = F.struct("place", *[c for c in chunks.columns if c not in ("note_id", "place")])
    per = chunks.groupBy("note_id").agg(F.array_sort(F.collect_list(row)).alias("c"))
    key = lambda x: F.struct(x["chunk_type"], x["header_level"], x["header_text"])
    start = F.struct(F.array().cast("array<int>").alias("groups"), F.lit(-1).alias("group"), F.lit(0).alias("held"), F.lit(None).cast("struct<chunk_type:string,header_level:int,header_text:string>").alias("key"))

    def step(a: Column, x: Column) -> Column:
        alike = a["key"].isNotNull() & a["key"].eqNullSafe(key(x)) & (a["held"] < below) & (F.length(x["content"]) < below)
        group = F.when(alike, a["group"]).otherwise(a["group"] + 1)
        held = F.length(x["content"]) + F.when(alike, a["held"] + 2).otherwise(0)
        return F.struct(F.concat(a["groups"], F.array(group)).alias("groups"), group.alias("group"), held.alias("held"), key(x).cast("struct<chunk_type:string,header_level:int,header_text:string>").alias("key"))

    rows = per.select("note_id", "c", F.aggregate("c", start, step, lambda a: a["groups"]).alias("g")).select("note_id", F.explode(F.arrays_zip("c", "g")).alias("z")).select("note_id", F.col("z.g").alias("seq"), "z.c.*")
    first = lambda c: F.min_by(c, "place").alias(c)
    both = lambda c: F.when(F.count(F.lit(1)) == 1, F.min_by(c, "place")).otherwise(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))).alias(c)
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "content"))), lambda x: x["content"]), "\n\n")
    return rows.groupBy("note_id", "seq").agg(
        F.min("place").alias("position"), first("chunk_type"), content.alias("content"), first("header_text"), first("header_level"), first("parent_headers"), first("start_line"), F.max_by("end_line", "place").alias("end_line"),
        both("contains_tags"), both("contains_links"),
    )


def chunk_notes(notes: DataFrame, id_col: str = "note_id", text_col: str = "text", front_col: str | None = None, size: int = MAX_CHUNK, below: int = MERGE_BELOW) -> DataFrame:
    """Semantic chunks of each note, without scores (see ``structure.with_importance``).  Note ids are to be distinct."""
    lines = lines_in_sections(notes, id_col, text_col)
    heads = sections(lines)
    own = lines.join(heads.select("note_id", "section", "size", F.col("level").alias("section_level"), F.col("title").alias("section_title"), "above"), ["note_id", "section"])
    fits = (F.col("section") > 0) & (F.col("size") <= size)
    about = ["note_id", "section", F.col("section_level").alias("header_level"), F.col("section_title").alias("header_text"), F.col("above").alias("parent_headers")]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), "\n")
    whole = own.filter(fits).groupBy("note_id", "section", "section_level", "section_title", "above").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), text.alias("content"))
    whole = whole.select(*about, F.lit("section").alias("chunk_type"), "content", "start_line", "end_line", F.lit(0).alias("cut"))
    pieces = blocks(own.filter(~fits & ~F.col("head")).select("note_id", "section", "line", "content"))
    gap = F.col("kind") == "paragraph"
    text = F.when(gap, _stripped(F.col("text"))).otherwise(F.col("text"))
    pieces = pieces.withColumn("text", text).filter(~gap | (F.length("text") > LEAST_PARAGRAPH))
    cuts = F.when(gap, split_large(F.col("text"), size)).otherwise(F.array("text"))
    pieces = pieces.select("note_id", "section", "kind", "start_line", "end_line", F.posexplode(cuts).alias("cut", "content"))
    info = heads.select("note_id", "section", F.col("level").alias("header_level"), F.col("title").alias("header_text"), F.col("above").alias("parent_headers"))
    pieces = pieces.join(info, ["note_id", "section"]).select("note_id", "section", "header_level", "header_text", "parent_headers", F.col("kind").alias("chunk_type"), "content", "start_line", "end_line", "cut")
    found = whole.unionByName(pieces)
    if front_col:
        front = notes.select(F.col(id_col).cast("string").alias("note_id"), F.coalesce(F.col(front_col), F.lit("")).alias("content")).filter("content <> ''")
        none = lambda kind: F.lit(None).cast(kind)
        found = found.unionByName(front.select("note_id", F.lit(-1).alias("section"), none("int").alias("header_level"), none("string").alias("header_text"), F.array().cast("array<string>").alias("parent_headers"), F.lit("frontmatter").alias("chunk_type"), "content", F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.lit(0).alias("cut")))
    place = F.row_number().over(Window.partitionBy("note_id").orderBy("section", "start_line", "cut")) - 1
    found = found.withColumns({"place": place, "contains_tags": F.regexp_extract_all("content", F.lit(TAG), F.lit(1)), "contains_links": F.regexp_extract_all("content", F.lit(LINK), F.lit(1))}).drop("section", "cut")
    made = _merged(found, below)
    return made.select(
        F.concat("note_id", F.lit("/chunk_"), F.col("position").cast("string")).alias("chunk_id"), "note_id", F.col("position").cast("int").alias("position"), F.col("seq").cast("int").alias("seq"), "chunk_type", "content", "header_text",
        F.col("header_level").cast("int").alias("header_level"), "parent_headers", "start_line", "end_line", "contains_tags", "contains_links",
    )
