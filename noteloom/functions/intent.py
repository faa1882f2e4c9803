"""What a question wants: intent, strategy, entities and complexity, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from noteloom.functions.text import CAPITALISED

# Patterns and scores of the intents, in order of preference on ties.
TAG_PATTERN = r"#(\w+)|tag[s]?\s*[:=]\s*(\w+)|tagged\s+with\s+(\w+)"
INTENTS = (
    ("categorical", 0.8, TAG_PATTERN, "tag"),
    ("relationship", 0.7, r"link[s]?\s+to|connect[s]?\s+to|related\s+to|references?|mentions?|backlink[s]?|graph|network", "graph"),
    ("specific", 0.6, r"in\s+note\s+|from\s+file\s+|in\s+\w+\s+document|in\s+document|specific[ally]*|exact[ly]*", "vector"),
    ("semantic", 0.6, r"about|concept|idea|topic|understand|explain|meaning|definition", "vector"),
)
DEFAULT_SEMANTIC = 0.8

# Marks of complex and of simple questions, and patterns that call for an agent.
COMPLEX_MARKS = (
    "how", "why", "compare", "relationship", "connect", "between", "influence", "impact", "lead to", "result in", "because", "analyze", "explain the difference",
    "what's the connection", "trace", "follow", "sequence", "evolution", "development",
)
SIMPLE_MARKS = ("what is", "define", "list", "show me", "find", "when was", "who is", "where is")
AGENT_PATTERNS = (
    r"how.*(?:relate|connect|influence|lead|cause)",
    r"what.*(?:relationship|connection|difference|similarity)",
    r"explain.*(?:why|how|relationship|connection)",
    r"compare.*(?:and|with|to|between)",
    r"trace.*(?:development|evolution|history|progression)",
    r"analyze.*(?:impact|effect|influence|relationship)",
)


def tag_entities(query: Column) -> Column:
    """What stands behind '#', 'tag:' and 'tagged with', in order."""
    found = F.regexp_extract_all(query, F.lit(f"(?iU)(?:{TAG_PATTERN})"), F.lit(0))
    return F.transform(found, lambda m: F.regexp_extract(m, r"(?U)(\w+)$", 1))


def first_words(query: Column, n: int = 3) -> Column:
    """Entities of a question without tags: its first words of more than two characters."""
    return F.slice(F.filter(F.split(query, r"\s+"), lambda w: F.length(w) > 2), 1, n)


def intent(query: Column) -> dict[str, Column]:
    """intent_type, intent_confidence, strategy and entities of a question."""
    hit = {name: query.rlike(f"(?iU)(?:{pattern})") for name, _, pattern, _ in INTENTS}
    none = ~reduce(lambda a, b: a | b, hit.values())
    score = {name: F.when(hit[name], s).otherwise(0.0) for name, s, _, _ in INTENTS}
    score["semantic"] = F.when(none, DEFAULT_SEMANTIC).otherwise(score["semantic"])
    best = F.greatest(*score.values())
    name = F.coalesce(*[F.when(score[n] == best, n) for n, *_ in INTENTS])
    plain = F.coalesce(*[F.when(score[n] == best, s) for n, _, _, s in INTENTS])
    entities = tag_entities(query)
    return {
        "intent_type": name,
        "intent_confidence": best,
        "strategy": F.when((best < 0.6) | ((F.size(entities) > 0) & (score["semantic"] > 0.4)), "hybrid").otherwise(plain),
        "entities": entities,
    }


def complexity(question: Column) -> Column:
    low = F.lower(question)
    count = lambda marks: F.size(F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: low.contains(m)))
    names = F.regexp_count(question, F.lit(r"(?<![\p{L}\p{N}_])[A-Z][a-z]+(?![\p{L}\p{N}_])")) > 2
    inner = F.substring(question, 1, 1 << 30).rlike(r"(?s)\?.")
    return F.when((count(COMPLEX_MARKS) > count(SIMPLE_MARKS)) | names | inner, "complex").otherwise("simple")


def wants_agent(question: Column) -> Column:
    low = F.lower(question)
    pattern = reduce(lambda a, b: a | b, [low.rlike(p) for p in AGENT_PATTERNS])
    names = F.regexp_count(question, F.lit(CAPITALISED)) > 2
    return pattern | names | (F.regexp_count(question, F.lit(r"\?")) > 1) | low.contains(" and ")
