"""Steps that a language model may take, as callables with deterministic defaults.

A hook is a plain function over a batch of texts, applied partition by
partition; no result of the engine depends on one unless it is given.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.functions.text import capitalised_phrases, cleaned_items

#: A batch of texts to as many vectors.
Embed = Callable[[list[str]], list[list[float]]]
#: (question, context) to an answer.
Answer = Callable[[str, str], str]
#: A batch of note texts to as many class names.
Classify = Callable[[list[str]], list[str]]

# Characters of a note that are shown to a classifier and to a concept extractor.
CLASSIFY_CHARS, CONCEPT_CHARS = 1000, 1500
_WORD = re.compile(r"\w+")


def hashed_embedding(texts: list[str], size: int = 64) -> list[list[float]]:
    """Words hashed to signed buckets, at unit length: the fallback where no model is given."""
    out = []
    for t in texts:
        v = [0.0] * size
        for w in _WORD.findall(t.lower()):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % size] += 1.0 if h >> 32 & 1 else -1.0
        n = math.sqrt(sum(x * x for x in v))
        out.append([x / n for x in v] if n else v)
    return out


def with_embeddings(df: DataFrame, text_col: str, embed: Embed = hashed_embedding, name: str = "embedding") -> DataFrame:
    """Adds a vector per row, batch by batch."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(embed(texts.fillna("").tolist()))

    return df.withColumn(name, run(F.col(text_col)))


def with_class(notes: DataFrame, classify: Classify, name: str = "para_type") -> DataFrame:
    """Adds a class per note from its first characters."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series(classify(p.fillna("").str[:CLASSIFY_CHARS].tolist()))

    return notes.withColumn(name, run(F.col("text")))


def concepts(text: Column, listing: Column | None = None, n: int = 5) -> Column:
    """Concepts of a note: a model's listing, cleaned, or capitalised phrases."""
    found = F.slice(capitalised_phrases(F.substring(text, 1, CONCEPT_CHARS)), 1, n)
    return found if listing is None else F.coalesce(F.nullif(cleaned_items(listing, n), F.array().cast("array<string>")), found)


def quoted_answer(question: str, context: str) -> str:
    """The context's sentences that share most words with the question, three at most, in order."""
    asked = {w for w in _WORD.findall(question.lower()) if len(w) > 2}
    parts = [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n", context) if s.strip()]
    scored = sorted(range(len(parts)), key=lambda i: (-len(asked & set(_WORD.findall(parts[i].lower()))), i))[:3]
    hits = [i for i in sorted(scored) if asked & set(_WORD.findall(parts[i].lower()))]
    return " ".join(parts[i] for i in hits)
