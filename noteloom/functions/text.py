"""String functions as Columns: splitting, similarity, relevance, cleaning, extraction, links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from noteloom.schema import DEEP_LINK

LINK = r"\[\[([^\]]+)\]\]"
#: Words of one ASCII capital and small letters, in sequence, bounded as in Unicode text.
CAPITALISED = r"(?<![\p{L}\p{N}_])[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*(?![\p{L}\p{N}_])"
TAG = r"(?U)#(\w[\w/-]+)"


def trimmed(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def parse_delimited(c: Column) -> Column:
    """Comma-separated text to its non-empty trimmed parts; null gives none."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), trimmed), lambda x: x != "")


def header_context(c: Column) -> Column:
    """A JSON list, or parts between '>' signs."""
    parts = F.transform(F.split(c, ">"), trimmed)
    return F.filter(F.when(c.startswith("["), F.from_json(c, "array<string>")).otherwise(parts), lambda x: x != "")


def links(text: Column) -> Column:
    """Targets of [[wiki links]] in order, without alias and anchor."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LINK), F.lit(1)), lambda x: trimmed(F.regexp_replace(x, r"[|#].*$", "")))


def body_tags(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TAG), F.lit(1))


def bigrams(c: Column) -> Column:
    """Distinct character pairs; none for fewer than two characters."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(2)))
    return F.when(F.length(c) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def fuzzy_string(a: Column, b: Column) -> Column:
    """Half of 0.7 bigram Jaccard plus 0.3 length similarity; 0 for empty strings."""
    x, y = bigrams(a), bigrams(b)
    shared = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    near = 1 - F.abs(F.length(a) - F.length(b)) / F.greatest(F.length(a), F.length(b))
    return (
        F.when((F.length(a) == 0) | (F.length(b) == 0) | a.isNull() | b.isNull(), F.lit(0.0))
        .when((F.length(a) < 2) & (F.length(b) < 2), (a == b).cast("double"))
        .when((F.length(a) < 2) | (F.length(b) < 2), F.lit(0.0))
        .otherwise((shared * 0.7 + near * 0.3) * 0.5)
    )


def tag_match(entity: str | Column, tag: Column) -> Column:
    """How well one tag answers to one entity, 0 to 1."""
    e, t = F.lower(F.lit(entity)), F.lower(tag)
    parts = F.split(t, "/")
    tree = t.contains("/")
    partial = F.when(tree & F.exists(parts, lambda p: p.contains(e) | e.contains(p)), 0.7).otherwise(0.0)
    within = F.when(t.contains(e), 0.8).when(e.contains(t), 0.6).otherwise(0.0)
    return F.when(t == e, 1.0).when(tree & F.array_contains(parts, e), 0.9).otherwise(F.greatest(partial, within, fuzzy_string(e, t)))


def tag_relevance(entities: list[str], tags: Column) -> Column:
    """Mean over entities of the best match among an array of tags."""
    if not entities:
        return F.lit(0.0)


    def best_of(entity: str) -> Column:
        return F.coalesce(F.array_max(F.transform(tags, lambda t: tag_match(entity, t))), F.lit(0.0))

    best = [best_of(e) for e in entities]
    return reduce(lambda a, b: a + b, best) / len(entities)


def terms_of(query: str) -> list[str]:
    return [t for t in query.lower().split() if len(t) > 2]


def text_relevance(text: Column, query: str) -> Column:
    """Non-overlapping term counts over text length in hundreds plus terms, at most 1."""
    terms = terms_of(query)
    if not terms:
        return F.lit(0.0)
    low = F.lower(text)
    found = reduce(lambda a, b: a + b, [(F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t) for t in terms])
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0.0).otherwise(F.least(found / (F.length(text) / 100 + len(terms)), F.lit(1.0)))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[ _]", "-"), r"(?U)[^\p{L}\p{N}-]", "")


def safe_title(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, r"(?U)[^\p{L}\p{N} _-]", ""))


def preview(c: Column, n: int = 200) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def percent_encoded(c: Column, keep_slash: bool) -> Column:
    out = F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))
    out = F.replace(out, F.lit("*"), F.lit("%2A"))
    return F.replace(out, F.lit("%2F"), F.lit("/")) if keep_slash else out


def chunk_uri(vault: Column, path: Column, header: Column, roots: tuple[str, ...] = ()) -> Column:
    """Deep link to a note, with its header as anchor; paths under ``roots`` become relative, '.md' is the default suffix."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    for root in roots:
        base = root.replace("\\", "/").rstrip("/") + "/"
        p = F.when(p.startswith(base), F.substring(p, len(base) + 1, 1 << 30)).otherwise(p)
    p = F.regexp_replace(p, "^/+", "")
    p = F.when((p != "") & ~p.rlike(r"[^/.][^/]*\.[^/.]+$"), F.concat(p, F.lit(".md"))).otherwise(p)
    anchor = F.regexp_replace(F.regexp_replace(trimmed(F.coalesce(header, F.lit(""))), r"\s+", " "), r"[\x00-\x1F]", "")
    name = F.regexp_extract(vault, r"([^/\\]*)[/\\]*$", 1)
    tail = F.when(anchor == "", "").otherwise(F.concat(F.lit("#"), percent_encoded(anchor, False)))
    return F.concat(F.lit(f"{DEEP_LINK}?vault="), percent_encoded(name, False), F.lit("&file="), percent_encoded(p, True), tail)


def headings(text: Column, n: int = 3) -> Column:
    return F.slice(F.regexp_extract_all(text, F.lit(r"(?m)^#+\s+(.+)$"), F.lit(1)), 1, n)


def list_items(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?m)^\s*[-*+]\s+.+$"))


def dates(text: Column, n: int = 3) -> Column:
    return F.slice(F.regexp_extract_all(text, F.lit(r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}/\d{4}\b"), F.lit(0)), 1, n)


def capitalised_phrases(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct capitalised word sequences of more than three characters, sorted."""
    found = F.regexp_extract_all(text, F.lit(CAPITALISED), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: (F.length(x) > 3) & ~x.isin(list(stop)) if stop else F.length(x) > 3)))


def sentences_with(text: Column, words: list[str], every: bool, n: int = 2) -> Column:
    """The first ``n`` sentences (between full stops) that hold every word, or any."""
    keep = lambda s: reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), [F.lower(s).contains(w.lower()) for w in words])
    return F.concat_ws(". ", F.slice(F.transform(F.filter(F.split(text, r"\."), keep), trimmed), 1, n))


def cleaned_items(c: Column, n: int, longer_than: int = 5) -> Column:
    """Lines of a listing without numbering, markup and end punctuation, long enough, the first ``n``."""
    lines = F.split(F.coalesce(c, F.lit("")), r"[\n,;]")
    item = lambda x: trimmed(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^\s*(?:\d+[.)]|[-*+])\s*", ""), r"[*_`\[\]#\"]", ""), r"[.:!?]+\s*$", ""))
    return F.slice(F.filter(F.transform(lines, item), lambda x: F.length(x) > longer_than), 1, n)


def split_tags(c: Column) -> Column:
    """Existing tags listed by line or comma, quotes and '#' removed."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[\n,]"), lambda x: trimmed(F.regexp_replace(x, r"[#'\"]", ""))), lambda x: x != "")


def first_score(c: Column, default: float = 0.5) -> Column:
    """First number in a text."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(c, r"(\d+(?:\.\d+)?)", 1), F.lit("")), F.lit("999999999.999999")).cast("double"), F.lit(default))


def protected_path(path: Column, names: tuple[str, ...]) -> Column:
    return F.exists(F.split(path, "/"), lambda p: p.isin(list(names)))


def format_context(rank: Column, title: Column, method: Column, text: Column) -> Column:
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] "), title, F.lit(" (via "), method, F.lit(")\n"), text, F.lit("\n"))


def word_set(c: Column) -> Column:
    """Distinct lower-cased words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda x: x != ""))
