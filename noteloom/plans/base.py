"""Declarative views: definitions to validated objects, and these to DataFrame plans."""

from __future__ import annotations

import copy
import json
import re
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.operators.filters import OPERATORS, all_of, any_of, condition, in_folders
from noteloom.plans.expr import Compiler, ExpressionError, Typed, as_number, as_text, parse, schema_resolver, truthy

ID = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")
FORMATS = ("text", "number", "date", "datetime", "progress", "badge", "url")
COMPUTED_TYPES = ("string", "number", "boolean", "date", "datetime")


class BaseError(ValueError):
    pass


@dataclass(frozen=True)
class Computed:
    id: str
    expr: str
    type: str


@dataclass(frozen=True)
class View:
    id: str
    name: str
    type: str
    columns: list[dict] = field(default_factory=list)
    card: dict = field(default_factory=dict)
    group: dict | None = None
    sort: list[dict] = field(default_factory=list)
    page_size: int | None = None


@dataclass(frozen=True)
class Base:
    id: str
    name: str
    version: int
    folders: list[str]
    subfolders: bool
    filters: list[dict]
    computed: list[Computed]
    views: list[View]
    description: str | None = None


def _need(ok: Any, why: str) -> None:
    if not ok:
        raise BaseError(why)


def load(text: str) -> dict:
    """JSON, else YAML where a parser is installed."""
    try:
        data = json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError:
            raise BaseError("neither JSON nor, without a YAML parser, readable") from None
        try:
            data = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise BaseError(f"neither JSON nor YAML: {e}") from e
    _need(isinstance(data, dict), "a definition is a mapping")
    return data


def _view(v: dict, computed: set[str]) -> View:
    _need(ID.fullmatch(v.get("id", "")), f"bad view id {v.get('id')!r}")
    _need(v.get("name"), "a view needs a name")
    _need(v.get("type") in ("table", "card"), f"unknown view type {v.get('type')!r}")
    columns = v.get("columns") or []
    _need(v["type"] != "table" or columns, "a table needs columns")
    for c in columns:
        _need(ID.fullmatch(c.get("id", "")) and c.get("header") and c.get("source"), f"bad column {c!r}")
        _need(c.get("format") in (None, *FORMATS), f"unknown format {c.get('format')!r}")
        _need(not c["source"].startswith("@") or c["source"][1:] in computed, f"unknown computed field {c['source']}")
        if c.get("format") == "progress":
            _need(c.get("min") is not None and c.get("max") is not None and c["min"] < c["max"], "progress needs min below max")
    card = v.get("card") or {}
    for ref in (card.get(k) for k in ("title", "subtitle", "image", "footer")):
        _need(not ref or not ref.startswith("@") or ref[1:] in computed, f"unknown computed field {ref}")
    for s in v.get("sort") or []:
        _need(s.get("by") and s.get("dir", "asc") in ("asc", "desc") and s.get("nulls", "last") in ("first", "last"), f"bad sort {s!r}")
    size = v.get("pageSize")
    _need(size is None or 1 <= size <= 1000, "pageSize lies between 1 and 1000")
    return View(v["id"], v["name"], v["type"], columns, card, v.get("group"), v.get("sort") or [], size)


def validate(data: dict) -> Base:
    """A definition as objects; raises BaseError with what is wrong."""
    _need(ID.fullmatch(data.get("id", "")), f"bad id {data.get('id')!r}")
    _need(data.get("name"), "a name is needed")
    _need(isinstance(data.get("version"), int) and data["version"] >= 1, "version is 1 or more")
    source = data.get("source") or {}
    folders = [f.replace("\\", "/") for f in source.get("folders") or []]
    _need(folders and not any(".." in f for f in folders), "folders are needed, without '..'")
    filters = source.get("filters") or []
    for f in filters:
        _need(f.get("property") and f.get("op") in OPERATORS, f"bad filter {f!r}")
    computed = [Computed(c.get("id", ""), c.get("expr", ""), c.get("type", "")) for c in data.get("computed") or []]
    for c in computed:
        _need(ID.fullmatch(c.id) and c.type in COMPUTED_TYPES, f"bad computed field {c.id!r}")
        try:
            parse(c.expr)
        except ExpressionError as e:
            raise BaseError(f"computed field {c.id!r}: {e}") from e
    ids = {c.id for c in computed}
    views = [_view(v, ids) for v in data.get("views") or []]
    _need(views, "a view is needed")
    for group in ([data["id"], *[c.id for c in computed], *[v.id for v in views]], *[[c["id"] for c in v.columns] for v in views]):
        _need(len(group) == len(set(group)), f"ids repeat in {group}")
    order([c for c in computed])
    return Base(data["id"], data["name"], data["version"], folders, source.get("includeSubfolders", True), filters, computed, views, data.get("description"))


def order(computed: list[Computed]) -> list[Computed]:
    """Fields after those that they use; a cycle is an error."""
    by_id = {c.id: c for c in computed}
    uses = {c.id: {n.lstrip("@") for n in parse(c.expr).names()} & set(by_id) for c in computed}
    out: list[Computed] = []
    while uses:
        free = [k for k in uses if not uses[k] & set(uses)]
        if not free:
            raise BaseError(f"computed fields use each other: {sorted(uses)}")
        for k in free:
            out.append(by_id[k])
            del uses[k]
    return out


def coerced(x: Typed, kind: str) -> Typed:
    if kind == "number":
        return Typed(as_number(x), "num")
    if kind == "boolean":
        return Typed(truthy(x), "bool")
    if kind == "string":
        return Typed(as_text(x), "str")
    return Typed(x.column.cast("timestamp" if kind == "datetime" else "date"), "date") if x.kind in ("date", "null") else Typed(x.column.try_cast("date" if kind == "date" else "timestamp"), "date")


class Plan:
    """A base over a table of notes: filters, computed fields, then a view's order and shape.

    Everything is one lazy plan; filters on stored columns reach the scan.
    """

    def __init__(self, base: Base, notes: DataFrame, now: datetime, path_col: str | None = None):
        self.base, self.now = base, now
        resolve = schema_resolver(notes.schema)
        tests = []
        for f in base.filters:
            c = resolve(f["property"])
            tests.append(condition(c.column if c else F.lit(None).cast("string"), f["op"], f.get("value")))
        if path_col:
            tests.append(in_folders(F.col(path_col), base.folders, base.subfolders))
        self.rows = notes.filter(all_of(tests)) if tests else notes
        self.extra: dict[str, Typed] = {}
        for c in order(base.computed):
            value = coerced(Compiler(schema_resolver(notes.schema, self.extra), now)(parse(c.expr)), c.type)
            self.rows = self.rows.withColumn(f"@{c.id}", value.column)
            self.extra[c.id] = self.extra[f"@{c.id}"] = Typed(F.col(f"`@{c.id}`"), value.kind)
        self.resolve = schema_resolver(notes.schema, self.extra)

    def view(self, view_id: str | None = None) -> View:
        for v in self.base.views:
            if view_id in (None, v.id):
                return v
        raise BaseError(f"no view {view_id!r}")

    def value(self, source: str) -> Column:
        x = self.resolve(source)
        return x.column if x else F.lit(None).cast("string")

    def keys(self, view: View) -> list[Column]:
        """The view's order; column ids stand for their sources."""
        sources = {c["id"]: c["source"] for c in view.columns}
        out = []
        for s in view.sort:
            c = self.value(sources.get(s["by"], s["by"]))
            out.append(getattr(c, f"{s.get('dir', 'asc')}_nulls_{s.get('nulls', 'last')}")())
        return out

    def ordered(self, view: View, tie: str | None = None) -> DataFrame:
        keys = self.keys(view) + ([F.col(tie)] if tie else [])
        return self.rows.orderBy(*keys) if keys else self.rows

    def table(self, view_id: str | None = None, tie: str | None = None, limit: int | None = None, page: int = 0) -> DataFrame:
        v = self.view(view_id)
        df = self.ordered(v, tie)
        if limit is not None:
            df = df.limit(limit)
        elif v.page_size and page:
            df = df.offset((page - 1) * v.page_size).limit(v.page_size)
        return df.select(*[self.value(c["source"]).alias(c["id"]) for c in v.columns])

    def cards(self, view_id: str, tie: str | None = None) -> DataFrame:
        v = self.view(view_id)
        text = lambda k: self.value(v.card[k]).cast("string") if v.card.get(k) else F.lit(None).cast("string")
        badges = F.array(*[self.value(b).cast("string") for b in v.card.get("badges", [])])
        return self.ordered(v, tie).select(*[text(k).alias(k) for k in ("title", "subtitle", "image")], F.filter(badges, lambda b: b.isNotNull()).alias("badges"), text("footer").alias("footer"))

    def group_key(self, view: View) -> Column:
        c = self.resolve(view.group["by"])
        return F.coalesce(c.column.cast("string"), F.lit("None")) if c else F.lit("Unknown")

    def groups(self, view_id: str | None = None) -> DataFrame:
        """(group, n, place): groups in the view's own order, then by name."""
        v = self.view(view_id)
        n = self.rows.groupBy(self.group_key(v).alias("group")).agg(F.count(F.lit(1)).alias("n"))
        listed = F.array(*[F.lit(x) for x in v.group.get("order") or []]).cast("array<string>")
        at = F.array_position(listed, F.col("group"))
        return n.withColumn("place", F.row_number().over(Window.orderBy(F.when(at == 0, 1 << 30).otherwise(at), "group")))  # a row per group

    def grouped(self, view_id: str | None = None, tie: str | None = None, limit: int | None = None) -> DataFrame:
        """The view's rows under their groups: group, place (of the group), n (rows of the group), then the view's columns; in order of group and view.

        With ``limit`` the first rows of the view are taken, and the groups are those of these rows.
        """
        v = self.view(view_id)
        df = self.rows if limit is None else self.ordered(v, tie).limit(limit)
        own = copy.copy(self)
        own.rows = df
        named = df.withColumn("__group", self.group_key(v))
        sizes = own.groups(view_id).withColumnRenamed("group", "__group").withColumnsRenamed({"n": "__n", "place": "__place"})
        keys = self.keys(v) + ([F.col(tie)] if tie else [])
        rows = named.join(sizes, "__group").orderBy("__place", *keys)
        return rows.select(F.col("__group").alias("group"), F.col("__place").alias("place"), F.col("__n").alias("n"), *[self.value(c["source"]).alias(c["id"]) for c in v.columns])

    def counts(self) -> DataFrame:
        return self.rows.agg(F.count(F.lit(1)).alias("filtered_count"))


def filter_tree(node: Any, compile_text: Compiler) -> Column:
    """The public syntax's filters: a condition, or and / or / not over a list."""
    if isinstance(node, str):
        return truthy(compile_text(parse(method_calls(node))))
    if not isinstance(node, dict) or len(node) != 1 or next(iter(node)) not in ("and", "or", "not"):
        raise BaseError(f"bad filter {node!r}")
    (op, parts), = node.items()
    tests = [filter_tree(p, compile_text) for p in parts]
    return all_of(tests) if op == "and" else any_of(tests) if op == "or" else ~any_of(tests)


def method_calls(text: str) -> str:
    """``a.contains("x")`` as ``contains(a, "x")``; what stands in quotes stays."""
    call = r"""("[^"]*"|'[^']*')|([A-Za-z_][\w-]*(?:\.[A-Za-z_][\w-]*)*)\.contains\("""
    return re.sub(call, lambda m: m[1] or f"contains({m[2]}, ", text)


def quoted(value: Any) -> str:
    """A literal of the expression language, which has no escapes: text with both kinds of quotes is put together."""
    if not isinstance(value, str):
        return json.dumps(value)
    if '"' not in value:
        return f'"{value}"'
    if "'" not in value:
        return f"'{value}'"
    return "concat(" + ", ".join(f'"{part}"' if '"' not in part else f"'{part}'" for part in re.split(r"""("+)""", value) if part) + ")"


def public_filter(f: dict) -> str:
    """One filter as a condition of the public syntax."""
    p, op, v = f["property"], f["op"], f.get("value")
    q = quoted
    values = v if isinstance(v, list) else [v]
    sign = {"eq": "==", "neq": "!=", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}
    if op in sign:
        return f"{p} {sign[op]} {q(v)}"
    if op in ("in", "nin"):
        any_ = " || ".join(f"{p} == {q(x)}" for x in values)
        return any_ if op == "in" else f"!({any_})"
    if op in ("contains", "ncontains"):
        return f"{'!' if op == 'ncontains' else ''}{p}.contains({q(v)})"
    if op in ("exists", "nexists"):
        return f"{p} {'!=' if op == 'exists' else '=='} null"
    return f"regexMatch({p}, {q(v)})"


def slug_id(name: str) -> str:
    return re.sub(r"-+", "-", re.sub(r"[^a-z0-9-]", "", re.sub(r"[ _]", "-", name.lower()))).strip("-")


def public_definition(name: str, filters: list[dict] | None = None, folders: list[str] | None = None) -> dict:
    """A new definition in the public syntax."""
    tests = [public_filter(f) for f in filters or []]
    if folders:
        tests.append(" || ".join(f"file.folder == {quoted(f)}" for f in folders))
    return {"id": slug_id(name), **({"filters": {"and": tests}} if tests else {}), "views": [{"type": "table", "name": name}]}


def merged(base: dict, updates: dict) -> dict:
    """Updates laid over a definition, mappings merged at every depth."""
    out = dict(base)
    for k, v in updates.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def from_notes(name: str, note_ids: list[str]) -> dict:
    """A base of some notes, as a table."""
    columns = [{"id": i, "header": h, "source": s} for i, h, s in (("title", "Title", "title"), ("path", "Path", "note_id"), ("tags", "Tags", "tags"))]
    return {"id": slug_id(name), "name": name, "version": 1, "source": {"folders": ["/"], "filters": [{"property": "note_id", "op": "in", "value": note_ids}]}, "views": [{"id": f"{slug_id(name)}-table", "name": name, "type": "table", "columns": columns}]}


def with_graph_fields(data: dict) -> dict:
    """The four graph fields added to a definition."""
    new = [
        {"id": "link-count", "expr": "len(links)", "type": "number"},
        {"id": "backlink-count", "expr": "len(backlinks)", "type": "number"},
        {"id": "connectivity-score", "expr": "len(links) + len(backlinks)", "type": "number"},
        {"id": "has-tags", "expr": "len(tags) > 0", "type": "boolean"},
    ]
    have = {c["id"] for c in data.get("computed", [])}
    return data | {"computed": [*data.get("computed", []), *[c for c in new if c["id"] not in have]]}


def info(base: Base) -> dict:
    return {"id": base.id, "name": base.name, "views": len(base.views), "filters": len(base.filters), "computed": len(base.computed)}
