"""The filter operators of declarative views, and the store's where matcher."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _has(c: Column, v: Any) -> Column:
    return F.coalesce(F.lower(c.cast("string")).contains(str(v).lower()), F.lit(False))


def _regex(c: Column, v: str) -> Column:
    try:
        re.compile(v)
    except re.error:
        return F.lit(False)
    return F.coalesce(c.cast("string").rlike(v), F.lit(False))


def _list(v: Any) -> list:
    return v if isinstance(v, list) else [] if v is None else [v]


OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "eq": lambda c, v: c == v,
    "neq": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(_list(v)),
    "nin": lambda c, v: ~c.isin(_list(v)),
    "contains": _has,
    "ncontains": lambda c, v: ~_has(c, v),
    "exists": lambda c, v: c.isNotNull(),
    "nexists": lambda c, v: c.isNull(),
    "regex": _regex,
}


def condition(column: Column, op: str, value: Any = None) -> Column:
    if op not in OPERATORS:
        raise ValueError(f"unknown filter operator {op!r}")
    return OPERATORS[op](column, value)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def in_folders(path: Column, folders: list[str], subfolders: bool = True) -> Column:
    """Paths in one of the folders, or below it."""
    tests = []
    for folder in folders:
        prefix = folder.replace("\\", "/").strip("/") + "/"
        inside = path.startswith(prefix)
        tests.append(inside if subfolders else inside & ~F.substring(path, len(prefix) + 1, 1 << 30).contains("/"))
    return any_of(tests) if tests else F.lit(True)


_WHERE: dict[str, Callable[[Column, Any], Column]] = {
    "$eq": lambda s, v: s == str(v),
    "$ne": lambda s, v: s != str(v),
    "$contains": lambda s, v: s.contains(str(v)),
    "$in": lambda s, v: s.isin([str(x) for x in v]),
}


def where_match(df: DataFrame, where: dict[str, Any]) -> Column:
    """Conditions on the text of values, a missing one being ''; unknown operators are an error."""
    tests = []
    for key, rule in where.items():
        text = F.coalesce(df[key].cast("string"), F.lit("")) if key in df.columns else F.lit("")
        for op, value in (rule if isinstance(rule, dict) else {"$eq": rule}).items():
            if op not in _WHERE:
                raise ValueError(f"unknown where operator {op!r}")
            tests.append(_WHERE[op](text, value))
    return all_of(tests)
