"""Templates with double braces as column expressions.

A template is read once, on the driver, into a tree; the tree becomes one expression over a struct, by the struct's type:
`each` is a transform and a join, `if` and `unless` are conditions, and names are resolved while the expression is made. So a
user's template runs where Spark's own functions run, and no row passes through Python.

Known are values ({{a.b}}, also with three braces; nothing is escaped for HTML), each, if, else, else if, unless, with, block
parameters (as |item index|), this, ../, @root, @index, @first, @last, @key, `length` of arrays, comments, ~ next to braces, and
the comparisons of CALLS in parentheses or in conditions. Tags of blocks and comments that stand alone on a line leave no line.
Names that the struct doesn't have, and nulls, are empty and false.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TAG = re.compile(r"\\?\{\{(?:(~?)!--(?P<long>.*?)--(~?)\}\}|\{(?P<triple>[^{}]*)\}\}\}|(?P<left>~?)(?P<inner>[^{}]*?)(?P<right>~?)\}\})", re.DOTALL)
_WORD = re.compile(r"\"[^\"]*\"|'[^']*'|[()]|(?:\[[^\]]*\]|[^\s()\[])+")


class TemplateError(ValueError):
    """A template that can't be read, with the line."""


@dataclass
class Node:
    """kind: text, value, each, if, unless or with; inner: the text or the words of the expression."""

    kind: str
    inner: object
    names: list[str] = field(default_factory=list)
    body: list[Node] = field(default_factory=list)
    other: list[Node] = field(default_factory=list)


@dataclass(frozen=True)
class Value:
    """A column and its type; neither if there is nothing of that name."""

    column: Column | None = None
    kind: T.DataType | None = None


@dataclass(frozen=True)
class Scope:
    this: Value
    index: Column | None = None
    size: Column | None = None
    key: Column | None = None
    names: tuple[tuple[str, Value], ...] = ()


def parse(template: str) -> list[Node]:
    root: list[Node] = []
    # Open blocks: their node, what is being filled, and how many blocks their end closes (an `else if` opens one more).
    open_: list[tuple[Node, list[Node], int]] = []
    at, trim, into = 0, False, root

    def fail(place: int, what: str) -> TemplateError:
        return TemplateError(f"line {template.count(chr(10), 0, place) + 1}: {what}")

    def put(text: str) -> None:
        if text:
            into.append(Node("text", text))

    for m in _TAG.finditer(template):
        text, begin, end = template[at : m.start()], m.start(), m.end()
        if m[0].startswith("\\"):
            put((text.lstrip() if trim else text) + m[0][1:])
            at, trim = end, False
            continue
        inner = (m["inner"] if m["inner"] is not None else m["triple"] or "").strip()
        comment = m["long"] is not None or inner.startswith("!")
        block = comment or inner[:1] in ("#", "/", "^") or re.match(r"else\b", inner) is not None
        if m["triple"] is not None:
            block = comment = False
        left, right = (m[1] or m["left"]) == "~", (m[3] or m["right"]) == "~"
        line = template.rfind("\n", 0, begin) + 1
        rest = re.compile(r"[ \t]*(?:\r?\n|\Z)").match(template, end)
        if block and rest and not template[line:begin].strip(" \t") and line >= at - (at == 0):
            text, end = template[at:line] if line > at else "", rest.end()
        text = text.lstrip() if trim else text
        put(text.rstrip() if left else text)
        at, trim = end, right
        if comment:
            continue
        words = _WORD.findall(inner.lstrip("#/^& "))
        if inner.startswith("#"):
            if not words or words[0] not in ("each", "if", "unless", "with"):
                raise fail(begin, f"no block {words[0] if words else ''}")
            names = re.search(r"\bas\s*\|([^|]*)\|\s*$", inner)
            node = Node(words[0], _WORD.findall(inner[1 : names.start()] if names else inner[1:])[1:], names[1].split() if names else [])
            into.append(node)
            open_.append((node, into, 1))
            into = node.body
        elif inner.startswith("/"):
            if not open_:
                raise fail(begin, f"{inner} closes nothing")
            closes = open_[-1][2]
            first = open_[-closes]
            if words[:1] != [first[0].kind]:
                raise fail(begin, f"{inner} closes {first[0].kind}")
            into = first[1]
            del open_[-closes:]
        elif inner == "^" or re.match(r"else\b", inner):
            if not open_:
                raise fail(begin, "else without a block")
            node, _, closes = open_[-1]
            into = node.other
            if words[1:]:
                if words[1] not in ("if", "unless", "each", "with"):
                    raise fail(begin, f"no block {words[1]}")
                more = Node(words[1], words[2:])
                into.append(more)
                open_.append((more, into, closes + 1))
                into = more.body
        elif inner[:1] in (">", "*"):
            raise fail(begin, "partials and decorators aren't known")
        elif not words:
            raise fail(begin, "an empty tag")
        else:
            into.append(Node("value", words))
    if open_:
        raise TemplateError(f"{open_[-1][0].kind} isn't closed")
    put(template[at:].lstrip() if trim else template[at:])
    return root


def shown(v: Value) -> Column:
    """A value as text: numbers and booleans as JSON has them, arrays in brackets, structs by a mark."""
    if v.column is None or isinstance(v.kind, T.NullType):
        return F.lit("")
    if isinstance(v.kind, T.ArrayType):
        kind = v.kind.elementType
        return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(v.column, lambda x: shown(Value(x, kind))), ", "), F.lit("]")), F.lit(""))
    if isinstance(v.kind, (T.StructType, T.MapType)):
        return F.when(v.column.isNull(), "").otherwise("[object]")
    return F.coalesce(v.column.cast("string"), F.lit(""))


def holds(v: Value, zero: bool = False) -> Column:
    """Whether a condition takes a value as true: not null, false, 0 (unless asked for), empty."""
    if v.column is None or isinstance(v.kind, T.NullType):
        return F.lit(False)
    if isinstance(v.kind, T.BooleanType):
        found = v.column
    elif isinstance(v.kind, T.NumericType):
        found = v.column.isNotNull() if zero else (v.column != 0) & ~F.isnan(v.column.cast("double"))
    elif isinstance(v.kind, (T.ArrayType, T.MapType)):
        found = F.size(v.column) > 0
    elif isinstance(v.kind, T.StructType):
        found = v.column.isNotNull()
    else:
        found = v.column.cast("string") != ""
    return F.coalesce(found, F.lit(False))


def _order(test: Callable[[Column, Column], Column]) -> Callable[[Value, Value], Column]:
    def of(a: Value, b: Value) -> Column:
        if a.column is None or b.column is None:
            return F.lit(False)
        if isinstance(a.kind, T.NumericType) != isinstance(b.kind, T.NumericType):
            return F.lit(False)
        return F.coalesce(test(a.column, b.column), F.lit(False))

    return of


def _same(a: Value, b: Value) -> Column:
    if a.column is None or b.column is None:
        return F.lit(a.column is None and b.column is None)
    if isinstance(a.kind, T.NumericType) and isinstance(b.kind, T.NumericType):
        return a.column.eqNullSafe(b.column)
    return F.lit(False) if type(a.kind) is not type(b.kind) else a.column.eqNullSafe(b.column)


#: What can be called, in parentheses or as a condition.
CALLS: dict[str, Callable[..., Column]] = {
    "eq": _same,
    "ne": lambda a, b: ~_same(a, b),
    "lt": _order(lambda a, b: a < b),
    "lte": _order(lambda a, b: a <= b),
    "gt": _order(lambda a, b: a > b),
    "gte": _order(lambda a, b: a >= b),
    "and": lambda *vs: F.lit(True) if not vs else holds(vs[0]) & CALLS["and"](*vs[1:]),
    "or": lambda *vs: F.lit(False) if not vs else holds(vs[0]) | CALLS["or"](*vs[1:]),
    "not": lambda v: ~holds(v),
}


def step(v: Value, name: str) -> Value:
    """A field, an element by number, or an array's length."""
    if v.column is None:
        return Value()
    if isinstance(v.kind, T.StructType):
        found = {f.name: f.dataType for f in v.kind.fields}
        return Value(v.column.getField(name), found[name]) if name in found else Value()
    if isinstance(v.kind, T.MapType):
        return Value(F.element_at(v.column, F.lit(name).cast(v.kind.keyType)), v.kind.valueType)
    if isinstance(v.kind, T.ArrayType) and name == "length":
        return Value(F.when(v.column.isNotNull(), F.size(v.column)), T.IntegerType())
    if isinstance(v.kind, T.ArrayType) and name.isdigit():
        return Value(F.get(v.column, F.lit(int(name))), v.kind.elementType)
    return Value()


def look_up(path: str, scopes: list[Scope]) -> Value:
    data = path.startswith("@")
    path = path[1:] if data else path
    if data and re.match(r"root\b", path):
        scopes, path, data = scopes[:1], path[4:].lstrip("./"), False
    while path == ".." or path.startswith("../"):
        path = path[3:]
        if len(scopes) == 1:
            return Value()
        scopes = scopes[:-1]
    if data:
        here = next((s for s in reversed(scopes) if s.index is not None or s.key is not None), None)
        if here is None:
            return Value()
        number = T.IntegerType()
        known = {"key": Value(here.key, T.StringType()) if here.key is not None else Value()}
        if here.index is not None:
            known |= {"index": Value(here.index, number), "first": Value(here.index == 0, T.BooleanType()), "last": Value(here.index == here.size - 1, T.BooleanType())}
        return known.get(path, Value())
    parts = [a or b for a, b in re.findall(r"\[([^\]]*)\]|([^./\[\]]+)", re.sub(r"^\./", "", path))]
    found = scopes[-1].this
    if parts[:1] == ["this"]:
        parts = parts[1:]
    elif parts:
        named = next((v for s in reversed(scopes) for k, v in s.names if k == parts[0]), None)
        if named is not None:
            found, parts = named, parts[1:]
    for name in parts:
        found = step(found, name)
    return found


def literal(word: str) -> Value | None:
    if word[0] in "\"'":
        return Value(F.lit(word[1:-1]), T.StringType())
    if word in ("true", "false"):
        return Value(F.lit(word == "true"), T.BooleanType())
    if word in ("null", "undefined"):
        return Value()
    if re.fullmatch(r"-?\d+", word):
        return Value(F.lit(int(word)), T.LongType())
    if re.fullmatch(r"-?\d+\.\d+", word):
        return Value(F.lit(float(word)), T.DoubleType())
    return None


def evaluate(words: list[str], scopes: list[Scope]) -> Value:
    """The value of an expression: a name, a literal, or a call with its arguments; calls within calls stand in parentheses."""

    def one(at: int) -> tuple[Value, int]:
        if words[at] != "(":
            plain = literal(words[at])
            return (look_up(words[at], scopes) if plain is None else plain), at + 1
        name, args, at = words[at + 1], [], at + 2
        while at < len(words) and words[at] != ")":
            value, at = one(at)
            args.append(value)
        if name not in CALLS or at >= len(words):
            raise TemplateError(f"no call ({name} ..)")
        return Value(CALLS[name](*args), T.BooleanType()), at + 1

    if not words:
        raise TemplateError("a block without a value")
    if len(words) > 1 and words[0] != "(":
        words = ["(", *words, ")"]
    return one(0)[0]


def written(nodes: list[Node], scopes: list[Scope]) -> Column:
    parts = [F.lit(n.inner) if n.kind == "text" else shown(evaluate(n.inner, scopes)) if n.kind == "value" else block(n, scopes) for n in nodes]
    return F.lit("") if not parts else parts[0] if len(parts) == 1 else F.concat(*parts)


def block(n: Node, scopes: list[Scope]) -> Column:
    words = [w for w in n.inner if not w.startswith("includeZero=")]
    v = evaluate(words, scopes)
    if n.kind in ("if", "unless"):
        true = holds(v, "includeZero=true" in n.inner)
        return F.when(true if n.kind == "if" else ~true, written(n.body, scopes)).otherwise(written(n.other, scopes))
    name = lambda k: n.names[k] if len(n.names) > k else None
    if v.column is None:
        return written(n.other, scopes)
    if n.kind == "with":
        inside = Scope(v, names=((name(0), v),) if name(0) else ())
        return F.when(holds(v), written(n.body, [*scopes, inside])).otherwise(written(n.other, scopes))

    def item(this: Value, index: Column, size: Column, key: Column | None = None) -> Column:
        told = Value(index, T.IntegerType()) if key is None else Value(key, T.StringType())
        names = tuple((k, x) for k, x in ((name(0), this), (name(1), told)) if k)
        return written(n.body, [*scopes, Scope(this, index, size, key, names)])

    if isinstance(v.kind, T.ArrayType):
        kind, many = v.kind.elementType, F.size(v.column)
        all_of = F.array_join(F.transform(v.column, lambda x, i: item(Value(x, kind), i, many)), "")
    elif isinstance(v.kind, T.MapType):
        kind, many = v.kind.valueType, F.size(v.column)
        all_of = F.array_join(F.transform(F.map_entries(v.column), lambda e, i: item(Value(e["value"], kind), i, many, e["key"].cast("string"))), "")
    elif isinstance(v.kind, T.StructType):
        many = len(v.kind.fields)
        all_of = F.concat(F.lit(""), *[item(step(v, f.name), F.lit(k), F.lit(many), F.lit(f.name)) for k, f in enumerate(v.kind.fields)])
    else:
        return written(n.other, scopes)
    return F.when(holds(v), all_of).otherwise(written(n.other, scopes))


def rendered(template: str, context: Column, kind: T.StructType) -> Column:
    """The text that a template makes of a struct. An error in the template is raised here, before any row is read."""
    return written(parse(template), [Scope(Value(context, kind))])
