"""The computed-field language: text to a syntax tree, and the tree to a Spark Column.

Precedence, loosest first: ?:, ||, &&, comparison, + -, * / %, unary ! and -.
Binary operators associate to the left.  Types are settled from the schema when
an expression is compiled: comparing different types is false (and != true),
adding text to a number is an error; null propagates.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteloom.functions.text import trimmed

TOKENS = re.compile(
    r"""\s*(?:(?P<str>"[^"]*"|'[^']*')|(?P<num>\d+(?:\.\d+)?)|(?P<name>@?[A-Za-z_][\w-]*(?:\.[A-Za-z_][\w-]*)*)|(?P<op>&&|\|\||==|!=|>=|<=|[-+*/%<>!(),?:]))"""
)
LEVELS = (("||",), ("&&",), ("==", "!=", ">", ">=", "<", "<="), ("+", "-"), ("*", "/", "%"))
WORDS = {"true": True, "false": False, "null": None, "none": None}
#: strftime to Spark's date patterns.
DATE_PATTERNS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%B": "MMMM", "%b": "MMM", "%A": "EEEE", "%a": "EEE", "%j": "DDD"}


class ExpressionError(ValueError):
    pass


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKENS.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected {text[at:].strip()[:1]!r} at {at} in {text!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


@dataclass(frozen=True)
class Node:
    """kind: literal, name, call, unary, binary or ternary."""

    kind: str
    value: object = None
    args: tuple[Node, ...] = ()

    def names(self) -> set[str]:
        own = {self.value} if self.kind == "name" else set()
        return own.union(*(a.names() for a in self.args))


class _Parser:
    def __init__(self, text: str):
        self.text, self.items, self.at = text, tokens(text), 0

    def peek(self) -> str | None:
        return self.items[self.at][1] if self.at < len(self.items) and self.items[self.at][0] == "op" else None

    def take(self, op: str) -> None:
        if self.peek() != op:
            raise ExpressionError(f"{op!r} expected in {self.text!r}")
        self.at += 1

    def parse(self) -> Node:
        node = self.ternary()
        if self.at != len(self.items):
            raise ExpressionError(f"unexpected {self.items[self.at][1]!r} in {self.text!r}")
        return node

    def ternary(self) -> Node:
        test = self.binary(0)
        if self.peek() != "?":
            return test
        self.take("?")
        yes = self.ternary()
        self.take(":")
        return Node("ternary", None, (test, yes, self.ternary()))

    def binary(self, level: int) -> Node:
        if level == len(LEVELS):
            return self.unary()
        node = self.binary(level + 1)
        while self.peek() in LEVELS[level]:
            op = self.items[self.at][1]
            self.at += 1
            node = Node("binary", op, (node, self.binary(level + 1)))
        return node

    def unary(self) -> Node:
        if (op := self.peek()) in ("!", "-"):
            self.at += 1
            return Node("unary", op, (self.unary(),))
        return self.primary()

    def primary(self) -> Node:
        if self.at >= len(self.items):
            raise ExpressionError(f"{self.text!r} ends too soon")
        kind, value = self.items[self.at]
        self.at += 1
        if kind == "str":
            return Node("literal", value[1:-1])
        if kind == "num":
            return Node("literal", float(value) if "." in value else int(value))
        if kind == "name":
            if value.lower() in WORDS:
                return Node("literal", WORDS[value.lower()])
            if self.peek() == "(":
                return Node("call", value, self.arguments())
            return Node("name", value)
        if value == "(":
            node = self.ternary()
            self.take(")")
            return node
        raise ExpressionError(f"unexpected {value!r} in {self.text!r}")

    def arguments(self) -> tuple[Node, ...]:
        self.take("(")
        out: list[Node] = []
        while self.peek() != ")":
            if out:
                self.take(",")
            out.append(self.ternary())
        self.take(")")
        return tuple(out)


def parse(text: str) -> Node:
    if not text.strip():
        raise ExpressionError("empty expression")
    return _Parser(text).parse()


@dataclass(frozen=True)
class Typed:
    """A Column with the kind of its values: num, str, bool, date, list or null."""

    column: Column
    kind: str


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "num"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return {"string": "str", "boolean": "bool", "void": "null"}.get(t.simpleString(), "list" if isinstance(t, T.ArrayType) else "other")


def truthy(x: Typed) -> Column:
    """Null, 0, '' and empty lists are false."""
    test = {"num": lambda c: c != 0, "str": lambda c: c != "", "bool": lambda c: c, "list": lambda c: F.size(c) > 0, "null": lambda c: F.lit(False)}.get(x.kind, lambda c: c.isNotNull())
    return F.coalesce(test(x.column), F.lit(False))


def as_text(x: Typed) -> Column:
    if x.kind == "list":
        return F.coalesce(F.array_join(x.column, ","), F.lit(""))
    return F.coalesce(x.column.cast("string"), F.lit(""))


def as_number(x: Typed) -> Column:
    if x.kind in ("num", "bool"):
        return F.coalesce(x.column.cast("double"), F.lit(0.0))
    return F.coalesce(x.column.try_cast("double"), F.lit(0.0)) if x.kind == "str" else F.lit(0.0)


def _as_date(x: Typed) -> Column:
    if x.kind == "date":
        return x.column.cast("timestamp")
    if x.kind != "str":
        return F.lit(None).cast("timestamp")
    return F.coalesce(*[F.try_to_timestamp(x.column, F.lit(p)) for p in ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd")])


def _pattern(x: Node) -> str:
    if x.kind != "literal" or not isinstance(x.value, str):
        raise ExpressionError("a literal text is needed")
    return x.value


def _regex_match(c: Compiler, a: tuple[Node, ...]) -> Typed:
    pattern = _pattern(a[1])
    try:
        re.compile(pattern)
    except re.error:
        return Typed(F.lit(False), "bool")
    return Typed(as_text(c(a[0])).rlike(pattern), "bool")


def _date(c: Compiler, a: tuple[Node, ...]) -> Typed:
    spark = "".join(DATE_PATTERNS.get(p, f"'{p}'" if p.isalpha() else p) for p in re.findall(r"%[A-Za-z]|[^%]", _pattern(a[0])))
    return Typed(F.coalesce(F.date_format(_as_date(c(a[1])), spark), F.lit("")), "str")


def _contains(c: Compiler, a: tuple[Node, ...]) -> Typed:
    hay, needle = c(a[0]), c(a[1])
    if hay.kind == "list":
        return Typed(F.coalesce(F.array_contains(hay.column, as_text(needle)), F.lit(False)), "bool")
    return Typed(as_text(hay).contains(as_text(needle)), "bool")


def _coalesce(c: Compiler, a: tuple[Node, ...]) -> Typed:
    parts = [c(x) for x in a]
    kinds = {p.kind for p in parts} - {"null"}
    if len(kinds) > 1:
        return Typed(F.coalesce(*[F.when(p.column.isNotNull(), as_text(p)) for p in parts]), "str")
    return Typed(F.coalesce(*[p.column for p in parts]), next(iter(kinds), "null"))


def _clamp(c: Compiler, a: tuple[Node, ...]) -> Typed:
    x, lo, hi = (as_number(c(n)) for n in a)
    return Typed(F.greatest(lo, F.least(x, hi)), "num")


def _length(c: Compiler, a: tuple[Node, ...]) -> Typed:
    x = c(a[0])
    n = {"str": F.length, "list": F.size}.get(x.kind)
    return Typed(F.coalesce(n(x.column), F.lit(0)) if n else F.lit(0), "num")


#: Name to (least and most arguments, builder).
FUNCTIONS: dict[str, tuple[int, int | None, Callable]] = {
    "coalesce": (1, None, _coalesce),
    "clamp": (3, 3, _clamp),
    "lower": (1, 1, lambda c, a: Typed(F.lower(as_text(c(a[0]))), "str")),
    "upper": (1, 1, lambda c, a: Typed(F.upper(as_text(c(a[0]))), "str")),
    "trim": (1, 1, lambda c, a: Typed(trimmed(as_text(c(a[0]))), "str")),
    "concat": (0, None, lambda c, a: Typed(F.concat_ws("", *[as_text(c(x)) for x in a]), "str")),
    "contains": (2, 2, _contains),
    "regexMatch": (2, 2, _regex_match),
    "daysSince": (1, 1, lambda c, a: Typed(F.coalesce(F.datediff(F.lit(c.now).cast("date"), _as_date(c(a[0])).cast("date")), F.lit(0)), "num")),
    "now": (0, 0, lambda c, a: Typed(F.lit(c.now), "date")),
    "date": (2, 2, _date),
    "len": (1, 1, _length),
}


class Compiler:
    """Compiles trees over a schema.  ``resolve`` maps a property to a Typed column, or None if there is none."""

    def __init__(self, resolve: Callable[[str], Typed | None], now: datetime):
        self.resolve, self.now = resolve, now

    def __call__(self, node: Node) -> Typed:
        return getattr(self, f"_{node.kind}")(node)

    def _literal(self, node: Node) -> Typed:
        kind = {bool: "bool", str: "str", type(None): "null"}.get(type(node.value), "num")
        return Typed(F.lit(node.value), kind)

    def _name(self, node: Node) -> Typed:
        return self.resolve(node.value) or Typed(F.lit(None), "null")

    def _call(self, node: Node) -> Typed:
        if node.value not in FUNCTIONS:
            raise ExpressionError(f"unknown function {node.value!r}")
        least, most, build = FUNCTIONS[node.value]
        if len(node.args) < least or most is not None and len(node.args) > most:
            raise ExpressionError(f"{node.value} takes another number of arguments")
        return build(self, node.args)

    def _unary(self, node: Node) -> Typed:
        x = self(node.args[0])
        return Typed(~truthy(x), "bool") if node.value == "!" else Typed(-as_number(x), "num")

    def _ternary(self, node: Node) -> Typed:
        test, yes, no = (self(a) for a in node.args)
        kinds = {yes.kind, no.kind} - {"null"}
        if len(kinds) > 1:
            return Typed(F.when(truthy(test), as_text(yes)).otherwise(as_text(no)), "str")
        return Typed(F.when(truthy(test), yes.column).otherwise(no.column), next(iter(kinds), "null"))

    def _binary(self, node: Node) -> Typed:
        op = node.value
        a, b = (self(x) for x in node.args)
        if op in ("&&", "||"):
            return Typed(truthy(a) & truthy(b) if op == "&&" else truthy(a) | truthy(b), "bool")
        alike = a.kind == b.kind or "null" in (a.kind, b.kind)
        if op in ("==", "!="):
            if a.kind == "null" or b.kind == "null":
                same = a.column.isNull() if b.kind == "null" else b.column.isNull()
            else:
                same = a.column == b.column if alike else F.lit(False)
            return Typed(same if op == "==" else ~same, "bool")
        if op in (">", ">=", "<", "<="):
            if not alike:
                raise ExpressionError(f"{a.kind} {op} {b.kind}")
            return Typed({">": a.column > b.column, ">=": a.column >= b.column, "<": a.column < b.column, "<=": a.column <= b.column}[op], "bool")
        if op == "+" and a.kind == b.kind == "str":
            return Typed(F.concat(a.column, b.column), "str")
        if {a.kind, b.kind} - {"num", "bool", "null"}:
            raise ExpressionError(f"{a.kind} {op} {b.kind}")
        x, y = a.column.cast("double"), b.column.cast("double")
        if op == "%":
            whole = F.nullif(y, F.lit(0.0))
            return Typed(x - F.floor(x / whole) * y, "num")
        return Typed({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y)}[op](), "num")


def schema_resolver(schema: T.StructType, extra: Mapping[str, Typed] | None = None, bag: str = "frontmatter") -> Callable[[str], Typed | None]:
    """Names to columns: ``extra`` (computed fields, as '@id' or by id), columns, nested fields, then the property map."""

    def resolve(name: str) -> Typed | None:
        for key in (name, name.lstrip("@")) if extra else ():
            if key in extra:
                return extra[key]
        head, *rest = name.lstrip("@").split(".")
        if head in schema.names:
            t, c = schema[head].dataType, F.col(f"`{head}`")
            for r in rest:
                if not isinstance(t, T.StructType) or r not in t.names:
                    return None
                t, c = t[r].dataType, c[r]
            return Typed(c, kind_of(t))
        if bag in schema.names and isinstance(schema[bag].dataType, T.MapType):
            return Typed(F.try_element_at(F.col(bag), F.lit(name)), "str")
        return None

    return resolve
