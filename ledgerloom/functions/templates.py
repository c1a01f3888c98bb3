"""Page templates as Column expressions: a template is parsed to a tree once, and the tree becomes one expression.

Known are {{ value }}, {% for x in list %} with `loop`, {% if %} / {% elif %} /
{% else %}, {# comments #} and a minus that takes the white space beside a tag.
Values are names, fields, indexes and slices, text and numbers, `and`, `or`,
`not`, `in`, comparisons, arithmetic, `~`, `a if c else b`, a few text methods and
filters. Loops become `transform` and `array_join`, conditions `when`, so rows are
rendered on the JVM inside the query's own stage.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import stripped

#: A filter: from a value's column and its arguments' to the column of what it makes.
Filter = Callable[..., Column]

#: The filter that the old form of amounts, a format call, is rewritten to.
PRICE_FILTER = "format_price"
_FORMAT_CALL = re.compile(r"""\{\{\s*["']\{:,\.[02]f\}["']\.format\((.*?)\)\s*\}\}""", re.S)

_PARTS = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#-?.*?-?#\})", re.S)
_LEXEMES = re.compile(r"""\s*(?:(?P<number>\d+\.\d+|\d+)|(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[^\W\d]\w*)|(?P<op>//|==|!=|<=|>=|[-+*/%~<>()\[\]:.,|]))""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    """A template that can't be read."""


@dataclass(frozen=True)
class Value:
    """A column and its type; null is what an unknown name has. `true`: whether it counts as true, where the column can't tell."""

    column: Column
    kind: T.DataType
    true: Column | None = None

    def text(self) -> Column:
        """As it is printed: nothing for null, True and False for a boolean."""
        if isinstance(self.kind, T.BooleanType):
            return F.when(self.column, "True").when(~self.column, "False").otherwise("")
        return F.coalesce(self.column.cast("string"), F.lit(""))

    def truth(self) -> Column:
        """Whether it counts as true: not null, zero, empty."""
        if self.true is not None:
            return self.true
        if isinstance(self.kind, T.BooleanType):
            found = self.column
        elif isinstance(self.kind, T.NumericType):
            found = self.column != 0
        elif isinstance(self.kind, T.StringType):
            found = self.column != ""
        elif isinstance(self.kind, T.ArrayType | T.MapType):
            found = F.size(self.column) > 0
        else:
            found = self.column.isNotNull()
        return F.coalesce(found, F.lit(False))


_NOTHING = "nothing"
_BOOLEAN, _TEXT, _LONG, _DOUBLE = T.BooleanType(), T.StringType(), T.LongType(), T.DoubleType()

# --- reading


class _Reader:
    """The lexemes of one tag."""

    def __init__(self, source: str) -> None:
        self.source, self.items, at = source, [], 0
        while source[at:].strip():
            m = _LEXEMES.match(source, at)
            if not m:
                raise TemplateError(f"what is {source[at:].strip()!r}?")
            self.items.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def next_is(self, *values: str) -> bool:
        return self.at < len(self.items) and self.items[self.at][0] in ("op", "name") and self.items[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.next_is(*values):
            self.at += 1
            return self.items[self.at - 1][1]
        return None

    def want(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing in {self.source.strip()!r}")

    def name(self) -> str:
        if self.at == len(self.items) or self.items[self.at][0] != "name":
            raise TemplateError(f"a name is missing in {self.source.strip()!r}")
        self.at += 1
        return self.items[self.at - 1][1]

    def end(self) -> None:
        if self.at < len(self.items):
            raise TemplateError(f"too much in {self.source.strip()!r}")

    # from the loosest to the tightest binding; a node is a tuple led by its kind

    def value(self) -> tuple:
        node = self.either()
        if self.take("if"):
            condition = self.either()
            return ("choice", condition, node, self.value() if self.take("else") else (_NOTHING,))
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.joined()
        while True:
            if op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
                node = ("compare", op, node, self.joined())
            elif self.next_is("not") and self.items[self.at + 1 : self.at + 2] == [("name", "in")]:
                self.at += 2
                node = ("not", ("compare", "in", node, self.joined()))
            else:
                return node

    def joined(self) -> tuple:
        node = self.sum()
        while self.take("~"):
            node = ("join", node, self.sum())
        return node

    def sum(self) -> tuple:
        node = self.product()
        while op := self.take("+", "-"):
            node = ("count", op, node, self.product())
        return node

    def product(self) -> tuple:
        node = self.signed()
        while op := self.take("*", "/", "//", "%"):
            node = ("count", op, node, self.signed())
        return node

    def signed(self) -> tuple:
        return ("count", "-", ("literal", 0), self.signed()) if self.take("-") else self.filtered()

    def filtered(self) -> tuple:
        node = self.followed()
        while self.take("|"):
            name = self.name()
            node = ("filter", name, node, self.arguments() if self.take("(") else [])
        return node

    def arguments(self) -> list[tuple]:
        found = []
        while not self.take(")"):
            found.append(self.value())
            if not self.next_is(")"):
                self.want(",")
        return found

    def followed(self) -> tuple:
        node = self.single()
        while True:
            if self.take("."):
                name = self.name()
                node = ("method", name, node, self.arguments()) if self.take("(") else ("field", name, node)
            elif self.take("["):
                first = None if self.next_is(":") else self.value()
                if self.take(":"):
                    node = ("slice", node, first, None if self.next_is("]") else self.value())
                else:
                    node = ("index", node, first)
                self.want("]")
            else:
                return node

    def single(self) -> tuple:
        if self.take("("):
            node = self.value()
            self.want(")")
            return node
        if self.at == len(self.items):
            raise TemplateError(f"a value is missing in {self.source.strip()!r}")
        kind, value = self.items[self.at]
        self.at += 1
        if kind == "number":
            return ("literal", float(value) if "." in value else int(value))
        if kind == "text":
            return ("literal", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "name":
            words = {"true": True, "True": True, "false": False, "False": False}
            return ("literal", words[value]) if value in words else (_NOTHING,) if value in ("none", "None") else ("name", value)
        raise TemplateError(f"{value!r} is out of place in {self.source.strip()!r}")


def parsed(template: str) -> list[tuple]:
    """The template's tree: ("text", s), ("value", node), ("for", name, node, body, otherwise) and ("if", [(node, body)], otherwise)."""
    source = _FORMAT_CALL.sub(lambda m: "{{ (" + m[1] + ") | " + PRICE_FILTER + " }}", template)
    parts = _PARTS.split(source[:-1] if source.endswith("\n") else source)
    for k in range(1, len(parts), 2):  # a minus takes the white space on its side
        if parts[k][2:3] == "-":
            parts[k - 1] = parts[k - 1].rstrip()
        if parts[k][-3:-2] == "-":
            parts[k + 1] = parts[k + 1].lstrip()
    tags = [("text", p) if k % 2 == 0 else (p[:2], p[2:-2].removeprefix("-").removesuffix("-")) for k, p in enumerate(parts) if p and not p.startswith("{#")]
    at = 0

    def body(*ends: str) -> tuple[list[tuple], str, _Reader | None]:
        """What stands before one of the ends, the end, and the rest of its tag."""
        nonlocal at
        out: list[tuple] = []
        while at < len(tags):
            kind, source = tags[at]
            at += 1
            if kind == "text":
                out.append(("text", source))
                continue
            read = _Reader(source)
            if kind == "{{":
                out.append(("value", read.value()))
                read.end()
                continue
            word = read.name()
            if word in ends:
                return out, word, read
            if word == "for":
                name = read.name()
                read.want("in")
                over = read.value()
                read.end()
                inner, end, _ = body("endfor", "else")
                out.append(("for", name, over, inner, body("endfor")[0] if end == "else" else []))
            elif word == "if":
                cases, otherwise = [], []
                while True:
                    condition = read.value()
                    read.end()
                    inner, end, read = body("elif", "else", "endif")
                    cases.append((condition, inner))
                    if end != "elif":
                        otherwise = body("endif")[0] if end == "else" else []
                        break
                out.append(("if", cases, otherwise))
            else:
                raise TemplateError(f"what is {word!r}?")
        if ends:
            raise TemplateError(f"{ends[0]!r} is missing")
        return out, "", None

    return body()[0]


# --- compiling

# Built-in filters, by name; each takes the value and its arguments.
FILTERS: dict[str, Filter] = {"upper": F.upper, "lower": F.lower, "trim": stripped, "default": lambda c, other: F.coalesce(c, other)}


@dataclass(frozen=True)
class _Scope:
    names: dict[str, Value]
    filters: dict[str, Filter]

    def nothing(self) -> Value:
        return Value(F.lit(None).cast("string"), _TEXT)

    def value(self, node: tuple) -> Value:
        return getattr(self, f"_{node[0]}")(*node[1:])

    _nothing = nothing

    def _literal(self, value: object) -> Value:
        return Value(F.lit(value), _BOOLEAN if isinstance(value, bool) else _LONG if isinstance(value, int) else _DOUBLE if isinstance(value, float) else _TEXT)

    def _name(self, name: str) -> Value:
        return self.names.get(name) or self.nothing()

    def _field(self, name: str, node: tuple) -> Value:
        if node == ("name", "loop") and f"loop.{name}" in self.names:
            return self.names[f"loop.{name}"]
        of = self.value(node)
        if isinstance(of.kind, T.MapType):
            return Value(F.try_element_at(of.column, F.lit(name)), of.kind.valueType)
        if isinstance(of.kind, T.StructType) and name in of.kind.names:
            return Value(of.column[name], of.kind[name].dataType)
        return self.nothing()

    def _index(self, node: tuple, index: tuple) -> Value:
        of, at = self.value(node), self.value(index)
        if isinstance(of.kind, T.StructType | T.MapType):
            return self._field(index[1], node) if index[0] == "literal" else self.nothing()
        if isinstance(of.kind, T.ArrayType):
            return Value(F.try_element_at(of.column, F.when(at.column < 0, at.column).otherwise(at.column + 1).cast("int")), of.kind.elementType)
        size = F.length(of.column)
        place = F.when(at.column < 0, size + at.column).otherwise(at.column)
        return Value(F.when((place >= 0) & (place < size), F.substr(of.column, (place + 1).cast("int"), F.lit(1))), _TEXT)

    def _slice(self, node: tuple, first: tuple | None, last: tuple | None) -> Value:
        of = self.value(node)
        listed = isinstance(of.kind, T.ArrayType)
        whole = of.column if listed else of.column.cast("string")
        size = F.size(whole) if listed else F.length(whole)

        def place(node: tuple | None, default: Column) -> Column:
            if node is None:
                return default
            at = self.value(node).column
            return F.least(size, F.when(at < 0, F.greatest(size + at, F.lit(0))).otherwise(at)).cast("int")

        begin, end = place(first, F.lit(0)), place(last, size)
        count = F.greatest(end - begin, F.lit(0))
        return Value(F.slice(whole, begin + 1, count), of.kind) if listed else Value(F.substr(whole, begin + 1, count), _TEXT)

    def _method(self, name: str, node: tuple, arguments: list[tuple]) -> Value:
        of, args = self.value(node).column.cast("string"), [self.value(a) for a in arguments]
        if name == "replace" and len(args) == 2:
            return Value(F.replace(of, args[0].column, args[1].column), _TEXT)
        if name == "split" and len(args) == 1 and arguments[0][0] == "literal":
            return Value(F.split(of, rf"\Q{arguments[0][1]}\E", -1), T.ArrayType(_TEXT))
        made = {"upper": F.upper, "lower": F.lower, "strip": stripped}.get(name)
        if made is None or args:
            raise TemplateError(f"no method {name!r} of {len(args)} values")
        return Value(made(of), _TEXT)

    def _filter(self, name: str, node: tuple, arguments: list[tuple]) -> Value:
        of = self.value(node)
        if name == "length":
            return Value(F.size(of.column) if isinstance(of.kind, T.ArrayType | T.MapType) else F.length(of.column), _LONG)
        if name not in self.filters:
            raise TemplateError(f"no filter {name!r}")
        made = self.filters[name](of.column, *(self.value(a).column for a in arguments))
        return Value(made, of.kind if name == "default" else _TEXT)

    def _same(self, a: Value, b: Value) -> tuple[Value, Value]:
        """Both with one type: their own if they share it, else a number's, else as text."""
        if a.kind == b.kind:
            return a, b
        if isinstance(a.kind, T.NumericType) and isinstance(b.kind, T.NumericType):
            return Value(a.column.cast("double"), _DOUBLE), Value(b.column.cast("double"), _DOUBLE)
        return Value(a.text(), _TEXT), Value(b.text(), _TEXT)

    def _choice(self, condition: tuple, node: tuple, otherwise: tuple) -> Value:
        given, first, second = self.value(condition).truth(), self.value(node), self.value(otherwise)
        a, b = self._same(first, second)
        return Value(F.when(given, a.column).otherwise(b.column), a.kind, F.when(given, first.truth()).otherwise(second.truth()))

    def _or(self, a: tuple, b: tuple) -> Value:
        first, second = self.value(a), self.value(b)
        left, right = self._same(first, second)
        return Value(F.when(first.truth(), left.column).otherwise(right.column), left.kind, first.truth() | second.truth())

    def _and(self, a: tuple, b: tuple) -> Value:
        first, second = self.value(a), self.value(b)
        left, right = self._same(first, second)
        return Value(F.when(first.truth(), right.column).otherwise(left.column), left.kind, first.truth() & second.truth())

    def _not(self, node: tuple) -> Value:
        return Value(~self.value(node).truth(), _BOOLEAN)

    def _compare(self, op: str, a: tuple, b: tuple) -> Value:
        left, right = self.value(a), self.value(b)
        if op == "in":
            found = F.array_contains(right.column, left.column) if isinstance(right.kind, T.ArrayType) else F.contains(right.column, left.column)
        elif op in ("==", "!="):
            found = left.column.eqNullSafe(right.column)
            found = found if op == "==" else ~found
        else:
            found = {"<": left.column < right.column, "<=": left.column <= right.column, ">": left.column > right.column, ">=": left.column >= right.column}[op]
        return Value(F.coalesce(found, F.lit(False)), _BOOLEAN)

    def _join(self, a: tuple, b: tuple) -> Value:
        return Value(F.concat(self.value(a).text(), self.value(b).text()), _TEXT)

    def _count(self, op: str, a: tuple, b: tuple) -> Value:
        left, right = self.value(a), self.value(b)
        if op == "+" and isinstance(left.kind, T.StringType):
            return self._join(a, b)
        whole = all(isinstance(v.kind, T.IntegralType) for v in (left, right))
        x, y = left.column, right.column
        if op in ("/", "//", "%"):
            y = F.when(y != 0, y)  # nothing, where a division by zero has no value
        made = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x.cast("double") / y, "//": lambda: F.floor(x / y), "%": lambda: x - F.floor(x / y) * y}[op]()
        return Value(made.cast("long") if whole and op != "/" else made, _LONG if whole and op != "/" else _DOUBLE)

    def rendered(self, tree: list[tuple]) -> Column:
        pieces = [self._piece(node) for node in tree]
        return F.concat(*pieces) if pieces else F.lit("")

    def _piece(self, node: tuple) -> Column:
        if node[0] == "text":
            return F.lit(node[1])
        if node[0] == "value":
            return self.value(node[1]).text()
        if node[0] == "if":
            out = self.rendered(node[2])
            for condition, body in reversed(node[1]):
                out = F.when(self.value(condition).truth(), self.rendered(body)).otherwise(out)
            return out
        _, name, over, body, otherwise = node
        items = self.value(over)
        if not isinstance(items.kind, T.ArrayType):
            return self.rendered(otherwise)
        size = F.size(items.column)

        def one(item: Column, place: Column) -> Column:
            loop = {"index": place + 1, "index0": place, "length": size, "revindex": size - place}
            names = {f"loop.{k}": Value(c.cast("long"), _LONG) for k, c in loop.items()} | {"loop.first": Value(place == 0, _BOOLEAN), "loop.last": Value(place == size - 1, _BOOLEAN)}
            return replace(self, names=self.names | names | {name: Value(item, items.kind.elementType)}).rendered(body)

        return F.when(size > 0, F.array_join(F.transform(items.column, one), "")).otherwise(self.rendered(otherwise))


def compiled(template: str, rows: DataFrame, filters: dict[str, Filter] | None = None) -> Column:
    """The template as a column over the rows, whose columns are its names.

    Names that the rows lack, and null values, are printed as nothing and count
    as false. A null or empty list has no turns, so a loop's {% else %} is shown.
    A single line end at the template's end is left out, others stay, as do
    those after tags. Numbers with a fraction are printed as Spark casts them. A
    template that can't be read raises TemplateError.
    """
    names = {f.name: Value(F.col(f"`{f.name}`"), f.dataType) for f in rows.schema.fields}
    return _Scope(names, FILTERS | (filters or {})).rendered(parsed(template))


def compiled_by(layout: str, templates: dict[str, str], default: str, rows: DataFrame, filters: dict[str, Filter] | None = None) -> Column:
    """The template that the layout column names, `default` for other names and null."""
    out = compiled(templates[default], rows, filters)
    for name, template in templates.items():
        if name != default:
            out = F.when(F.col(layout) == name, compiled(template, rows, filters)).otherwise(out)
    return out
