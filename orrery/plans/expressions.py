"""The predicate language: lexer, precedence parser, and a typed predicate in conjunctive normal form.

Precedence, lowest first: OR, AND, NOT, OVERLAPS and IN, = and !=, < <= > >=,
+ and -, * / %, unary signs. Ranges a..b:s in an IN list include b. Integer
division gives a float.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from orrery.functions import timespan as ts
from orrery.functions.glob import glob
from orrery.functions.region import Region
from orrery.functions.times import parse_time


class ExpressionError(ValueError):
    """A predicate that cannot be read, or whose types do not agree."""


# ---------------------------------------------------------------- lexer

_TOKENS = re.compile(
    r"""\s*(?:
      (?P<time>[Tt]'[^']*')
    | (?P<range>[+-]?\d+\s*\.\.\s*[+-]?\d+(?:\s*:\s*\d+)?)
    | (?P<number>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)
    | (?P<string>'(?:[^']|'')*')
    | (?P<bind>:[A-Za-z_]\w*)
    | (?P<name>[A-Za-z_]\w*(?:\.[A-Za-z_]\w*){0,3})
    | (?P<op><=|>=|!=|[=<>+\-*/%(),])
    )""",
    re.X,
)
_WORDS = ("IN", "OR", "AND", "NOT", "OVERLAPS")


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKENS.match(text, at)
        if not m:
            raise ExpressionError(f"cannot read {text[at:].strip()[:20]!r} at {at} of {text!r}")
        kind, word = m.lastgroup, m[m.lastgroup]
        if kind == "name" and word.upper() in _WORDS:
            kind, word = "word", word.upper()
        out.append(Token(kind, word, m.start(m.lastgroup)))
        at = m.end()
    return [*out, Token("end", "", len(text))]


# ---------------------------------------------------------------- syntax tree


@dataclass(frozen=True)
class Node:
    """op: literal, name, bind, range, call, tuple, neg, not, or a binary operator."""

    op: str
    args: tuple = ()


_BINARY = {
    "OR": 1, "AND": 2, "OVERLAPS": 4, "IN": 4, "=": 5, "!=": 5, "<": 6, "<=": 6, ">": 6, ">=": 6,
    "+": 7, "-": 7, "*": 8, "/": 8, "%": 8,
}


class Parser:
    def __init__(self, text: str) -> None:
        self.text, self.tokens, self.at = text, tokens(text), 0

    def fail(self, t: Token) -> ExpressionError:
        return ExpressionError(f"unexpected {t.text or 'end'!r} at {t.at} of {self.text!r}")

    def next(self) -> Token:
        self.at += 1
        return self.tokens[self.at - 1]

    def take(self, text: str) -> bool:
        if self.tokens[self.at].text == text and self.tokens[self.at].kind in ("op", "word"):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise self.fail(self.tokens[self.at])

    def parse(self) -> Node | None:
        if self.tokens[0].kind == "end":
            return None
        node = self.expression(0)
        if self.tokens[self.at].kind != "end":
            raise self.fail(self.tokens[self.at])
        return node

    def expression(self, least: int) -> Node:
        left = self.prefix()
        while True:
            t = self.tokens[self.at]
            if t.kind == "word" and t.text == "NOT" and self.tokens[self.at + 1].text == "IN" and least <= 4:
                self.at += 2
                left = Node("not", (Node("IN", (left, self.collection())),))
                continue
            if t.kind == "range" and t.text[0] in "+-" or t.kind not in ("op", "word") or _BINARY.get(t.text, -1) < max(least, 1):
                return left
            self.at += 1
            if t.text == "IN":
                left = Node("IN", (left, self.collection()))
            else:
                left = Node(t.text, (left, self.expression(_BINARY[t.text] + 1)))

    def collection(self) -> Node:
        if self.take("("):
            items = [self.expression(0)]
            while self.take(","):
                items.append(self.expression(0))
            self.need(")")
            return Node("tuple", tuple(items))
        return self.prefix()

    def prefix(self) -> Node:
        t = self.next()
        if t.kind == "word" and t.text == "NOT":
            return Node("not", (self.expression(3),))
        if t.kind == "op" and t.text in "+-":
            inner = self.expression(9)
            return inner if t.text == "+" else Node("neg", (inner,))
        if t.kind == "op" and t.text == "(":
            items = [self.expression(0)]
            while self.take(","):
                items.append(self.expression(0))
            self.need(")")
            return items[0] if len(items) == 1 else Node("tuple", tuple(items))
        if t.kind == "number":
            return Node("literal", (int(t.text) if t.text.isdigit() else float(t.text),))
        if t.kind == "string":
            return Node("literal", (t.text[1:-1].replace("''", "'"),))
        if t.kind == "time":
            try:
                return Node("literal", (Time(parse_time(t.text[2:-1])),))
            except ValueError as e:
                raise ExpressionError(str(e)) from None
        if t.kind == "range":
            a, b, s = re.fullmatch(r"([+-]?\d+)\s*\.\.\s*([+-]?\d+)(?:\s*:\s*(\d+))?", t.text).groups()
            return Node("range", (int(a), int(b), int(s or 1)))
        if t.kind == "bind":
            return Node("bind", (t.text[1:],))
        if t.kind == "name":
            if self.take("("):
                items = []
                if not self.take(")"):
                    items.append(self.expression(0))
                    while self.take(","):
                        items.append(self.expression(0))
                    self.need(")")
                return Node("call", (t.text.upper(), tuple(items)))
            return Node("literal", (None,)) if t.text.upper() == "NULL" else Node("name", (t.text,))
        raise self.fail(t)


def parse(text: str) -> Node | None:
    """The tree of an expression; None if it is empty."""
    return Parser(text).parse()


# ---------------------------------------------------------------- typed values


@dataclass(frozen=True)
class Time:
    nsec: int


@dataclass(frozen=True, eq=False)
class Value:
    """A typed column expression. ``names`` are the columns it needs; ``literal`` is its value if it is one.

    Python's operators build predicates and values, so this is also the expression interface.
    """

    kind: str
    column: Callable[[], Column] | None = None
    names: frozenset[str] = frozenset()
    literal: Any = None
    is_literal: bool = False

    def _arith(self, op: str, other: Any) -> Value:
        return arithmetic(op, self, as_value(other))

    __add__ = lambda a, b: a._arith("+", b)
    __sub__ = lambda a, b: a._arith("-", b)
    __mul__ = lambda a, b: a._arith("*", b)
    __truediv__ = lambda a, b: a._arith("/", b)
    __mod__ = lambda a, b: a._arith("%", b)
    __radd__ = lambda a, b: as_value(b)._arith("+", a)
    __rsub__ = lambda a, b: as_value(b)._arith("-", a)
    __rmul__ = lambda a, b: as_value(b)._arith("*", a)
    __neg__ = lambda a: negative(a)
    __eq__ = lambda a, b: compare("=", a, as_value(b))  # type: ignore[assignment]
    __ne__ = lambda a, b: compare("!=", a, as_value(b))  # type: ignore[assignment]
    __lt__ = lambda a, b: compare("<", a, as_value(b))
    __le__ = lambda a, b: compare("<=", a, as_value(b))
    __gt__ = lambda a, b: compare(">", a, as_value(b))
    __ge__ = lambda a, b: compare(">=", a, as_value(b))
    __hash__ = object.__hash__

    @property
    def desc(self) -> Order:
        return Order(self, True)

    @property
    def is_null(self) -> Predicate:
        return leaf(lambda: ts.is_null(self.column()) if self.kind == "timespan" else self.column().isNull(), self.names)

    @property
    def begin(self) -> Value:
        return self._end("begin", ts.begin_of)

    @property
    def end(self) -> Value:
        return self._end("end", ts.end_of)

    def _end(self, name: str, f: Callable[[Column], Column]) -> Value:
        if self.kind != "timespan":
            raise ExpressionError(f"{self.kind} has no {name}")
        return Value("datetime", lambda: f(self.column()), self.names)

    def overlaps(self, other: Any) -> Predicate:
        return overlap(self, as_value(other))

    def in_range(self, start: int, stop: int | None = None, step: int = 1) -> Predicate:
        """Whether an integer is in start:stop:step; stop is exclusive, as in Python."""
        if self.kind != "int" or step < 1:
            raise ExpressionError("ranges take integers and a positive step")
        if stop is not None and stop <= start:
            return FALSE

        def column() -> Column:
            c = self.column()
            out = c >= start if stop is None else (c >= start) & (c < stop)
            return out & (c % step == start % step) if step > 1 else out

        return leaf(column, self.names)

    def in_iterable(self, items: Iterable[Any]) -> Predicate:
        values = [as_value(x) for x in items]
        if self.kind in ("timespan", "region") or any(not _agree(self.kind, v.kind) for v in values):
            raise ExpressionError(f"{self.kind} is not comparable with every one of the values")
        names = self.names.union(*(v.names for v in values))
        return leaf(lambda: self.column().isin(*(v.column() for v in values)), names) if values else FALSE

    def in_query(self, rows: DataFrame, column: str) -> Predicate:
        """Whether the value is in a column of another query's rows: a semi-join, or a null-aware anti-join."""
        return leaf(None, self.names, query=(self, rows.select(F.col(column).alias("_q"))))

    def glob(self, pattern: str) -> Predicate:
        if self.kind != "string":
            raise ExpressionError("GLOB takes a string")
        return leaf(lambda: glob(self.column(), pattern), self.names)


@dataclass(frozen=True)
class Order:
    value: Value
    descending: bool = False

    def column(self) -> Column:
        if self.value.kind not in ("int", "string", "float", "datetime", "ingest_date"):
            raise ExpressionError(f"cannot order by {self.value.kind}")
        c = self.value.column()
        return c.desc_nulls_last() if self.descending else c.asc_nulls_first()


def as_value(x: Any) -> Value:
    """A value of a Python object."""
    if isinstance(x, Value):
        return x
    lit = lambda kind, f, v: Value(kind, f, literal=v, is_literal=True)
    if isinstance(x, bool):
        return lit("bool", lambda: F.lit(x), x)
    if isinstance(x, int):
        return lit("int", lambda: F.lit(x).cast("long"), x)
    if isinstance(x, float):
        return lit("float", lambda: F.lit(x), x)
    if isinstance(x, str):
        return lit("string", lambda: F.lit(x), x)
    if isinstance(x, bytes):
        return lit("hash", lambda: F.lit(bytearray(x)), x)
    if isinstance(x, uuid.UUID):
        return lit("uuid", lambda: F.lit(str(x)), x)
    if isinstance(x, Time):
        return lit("datetime", lambda: F.lit(x.nsec).cast("long"), x)
    if isinstance(x, ts.Timespan):
        return lit("timespan", x.column, x)
    if isinstance(x, Region):
        return lit("region", x.column, x)
    if x is None:
        return lit("null", lambda: F.lit(None), None)
    raise ExpressionError(f"{type(x).__name__} cannot be part of an expression")


_NUMBERS, _TIMES = {"int", "float"}, {"datetime", "ingest_date"}


def _agree(a: str, b: str) -> bool:
    return a == b or {a, b} <= _NUMBERS or {a, b} <= _TIMES


def arithmetic(op: str, a: Value, b: Value) -> Value:
    if a.kind not in _NUMBERS or b.kind not in _NUMBERS or (a.kind != b.kind and not (a.is_literal or b.is_literal)):
        raise ExpressionError(f"{op} takes two integers or two floats, not {a.kind} and {b.kind}")
    if op == "%" and {a.kind, b.kind} != {"int"}:
        raise ExpressionError("% takes integers")
    kind = "float" if op == "/" or "float" in (a.kind, b.kind) else "int"
    f = {
        "+": lambda x, y: x + y,
        "-": lambda x, y: x - y,
        "*": lambda x, y: x * y,
        "/": lambda x, y: F.try_divide(x.cast("double"), y.cast("double")),
        "%": lambda x, y: F.try_mod(x, y),
    }[op]
    return Value(kind, lambda: f(a.column(), b.column()), a.names | b.names)


def negative(a: Value) -> Value:
    if a.kind not in _NUMBERS:
        raise ExpressionError(f"cannot negate {a.kind}")
    if a.is_literal:
        return as_value(-a.literal)
    return Value(a.kind, lambda: -a.column(), a.names)


# ---------------------------------------------------------------- predicates


@dataclass(frozen=True)
class Leaf:
    column: Callable[[], Column] | None
    names: frozenset[str]
    equality: tuple[Value, Any] | None = None
    negated: bool = False
    spatial: tuple[Value, Value] | None = None
    query: tuple[Value, DataFrame] | None = None
    overlap: bool = False  # of two timespans

    def to_column(self) -> Column:
        if self.column is None:
            raise ExpressionError("this predicate cannot stand below OR")
        c = self.column()
        return ~c if self.negated else c


@dataclass(frozen=True)
class Predicate:
    """AND of ORs. No clause: true. A clause without leaves: false."""

    clauses: tuple[tuple[Leaf, ...], ...] = ()

    def __and__(self, other: Predicate) -> Predicate:
        if () in self.clauses or () in other.clauses:
            return FALSE
        return Predicate((*self.clauses, *other.clauses))

    def __or__(self, other: Predicate) -> Predicate:
        return Predicate(tuple((*a, *b) for a in self.clauses for b in other.clauses))

    def __invert__(self) -> Predicate:
        """De Morgan, and back to normal form."""
        out = FALSE
        for clause in self.clauses:
            part = TRUE
            for x in clause:
                if x.spatial:
                    raise ExpressionError("spatial overlaps cannot be negated")
                part = part & Predicate(((replace(x, negated=not x.negated),),))
            out = out | part
        return out

    @property
    def names(self) -> frozenset[str]:
        return frozenset(n for clause in self.clauses for x in clause for n in x.names)

    def implied_data_id(self) -> dict[str, Any]:
        """Values fixed by equalities that stand under no OR; ExpressionError if two of them conflict."""
        found: dict[str, Any] = {}
        for clause in self.clauses:
            if len(clause) == 1 and clause[0].equality and not clause[0].negated:
                value, literal = clause[0].equality
                for name in value.names:
                    if found.setdefault(name, literal) != literal:
                        raise ExpressionError(f"{name} cannot be both {found[name]!r} and {literal!r}")
        return found

    def spatial(self) -> list[tuple[Value, Value]]:
        found = []
        for clause in self.clauses:
            for x in clause:
                if x.spatial and len(clause) > 1:
                    raise ExpressionError("spatial overlaps cannot stand under OR")
                if x.spatial:
                    found.append(x.spatial)
        return found

    def apply(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` that satisfy it; spatial overlaps are left to the planner."""
        for clause in self.clauses:
            if any(x.query for x in clause):
                if len(clause) > 1:
                    raise ExpressionError("IN of a query cannot stand under OR")
                df = _semi(df, clause[0])
            elif not any(x.spatial for x in clause):
                c = F.lit(False)
                for k, x in enumerate(clause):
                    c = x.to_column() if not k else c | x.to_column()
                df = df.where(c)
        return df


def _semi(df: DataFrame, x: Leaf) -> DataFrame:
    value, rows = x.query
    keyed = df.withColumn("_k", value.column())
    if not x.negated:
        return keyed.join(rows.where("_q IS NOT NULL"), F.col("_k") == F.col("_q"), "left_semi").drop("_k")
    # NOT IN: nothing passes if the other side has a null, and a null passes only an empty other side
    some = rows.agg(F.count("*").alias("_n"), F.count_if(F.col("_q").isNull()).alias("_nulls"))
    anti = keyed.join(rows, F.col("_k") == F.col("_q"), "left_anti")
    return (
        anti.join(F.broadcast(some), F.lit(True))  # one row
        .where("_n = 0 OR (_nulls = 0 AND _k IS NOT NULL)")
        .drop("_k", "_n", "_nulls")
    )


TRUE, FALSE = Predicate(), Predicate(((),))


def leaf(column: Callable[[], Column] | None, names: Iterable[str], **kw: Any) -> Predicate:
    return Predicate(((Leaf(column, frozenset(names), **kw),),))


_COMPARE = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def compare(op: str, a: Value, b: Value) -> Predicate:
    if "null" in (a.kind, b.kind):
        if op not in ("=", "!="):
            raise ExpressionError(f"NULL is not ordered: {op}")
        x = (b if a.kind == "null" else a).is_null
        return x if op == "=" else ~x
    if not _agree(a.kind, b.kind) or a.kind == "region" or (a.kind in ("timespan", "bool", "uuid", "hash") and op not in ("=", "!=")):
        raise ExpressionError(f"{a.kind} {op} {b.kind} is not possible")
    fixed = None
    if op in ("=", "!=") and a.is_literal != b.is_literal:
        plain, literal = (b, a) if a.is_literal else (a, b)
        fixed = (plain, literal.literal) if op == "=" and len(plain.names) == 1 else None
    return leaf(lambda: _COMPARE[op](a.column(), b.column()), a.names | b.names, equality=fixed)


def overlap(a: Value, b: Value) -> Predicate:
    if a.kind == b.kind == "region":
        return leaf(None, a.names | b.names, spatial=(a, b))
    if a.kind in _TIMES and b.kind == "timespan":
        a, b = b, a
    if a.kind == "timespan" and b.kind in _TIMES:
        return leaf(lambda: ts.contains_time(a.column(), b.column()), a.names | b.names)
    if a.kind == b.kind == "timespan":
        return leaf(lambda: ts.overlaps(a.column(), b.column()), a.names | b.names, overlap=True)
    raise ExpressionError(f"{a.kind} OVERLAPS {b.kind} is not possible")


def all_of(*predicates: Predicate) -> Predicate:
    """True if all are; of none it is true."""
    return reduce(lambda a, b: a & b, predicates, TRUE)


def any_of(*predicates: Predicate) -> Predicate:
    """True if one is; of none it is false."""
    return reduce(lambda a, b: a | b, predicates, FALSE)


def not_(predicate: Predicate) -> Predicate:
    return ~predicate


# ---------------------------------------------------------------- strings to predicates

Resolver = Callable[[str], Value]


@dataclass(frozen=True)
class Converter:
    """Turns trees into predicates: ``resolve`` gives the value of an identifier, ``bind`` those of parameters."""

    resolve: Resolver
    bind: Mapping[str, Any]

    def predicate(self, node: Node) -> Predicate:
        op, args = node.op, node.args
        if op == "AND":
            return self.predicate(args[0]) & self.predicate(args[1])
        if op == "OR":
            return self.predicate(args[0]) | self.predicate(args[1])
        if op == "not":
            return ~self.predicate(args[0])
        if op in _COMPARE:
            return compare(op, *self._typed(*args))
        if op == "OVERLAPS":
            return overlap(self.value(args[0]), self.value(args[1]))
        if op == "IN":
            return self._in(*args)
        if op == "call" and args[0] == "GLOB":
            if len(args[1]) != 2:
                raise ExpressionError("GLOB takes an expression and a pattern")
            pattern = self.value(args[1][1])
            if not pattern.is_literal or pattern.kind != "string":
                raise ExpressionError("the pattern of GLOB is a string")
            return self.value(args[1][0]).glob(pattern.literal)
        value = self.value(node)
        if value.kind != "bool":
            raise ExpressionError(f"{value.kind} is not a predicate")
        return leaf(value.column, value.names)

    def _typed(self, left: Node, right: Node) -> tuple[Value, Value]:
        """Both values; a string beside a UUID is one."""
        a, b = self.value(left), self.value(right)
        make = lambda v: as_value(uuid.UUID(v.literal))
        if a.kind == "uuid" and b.kind == "string" and b.is_literal:
            b = make(b)
        elif b.kind == "uuid" and a.kind == "string" and a.is_literal:
            a = make(a)
        return a, b

    def _in(self, left: Node, right: Node) -> Predicate:
        member = self.value(left)
        items = right.args if right.op == "tuple" else (right,)
        out, plain = FALSE, []
        for item in items:
            if item.op == "range":
                a, b, s = item.args
                out = out | member.in_range(a, b + 1, s)
                continue
            bound = self._bound(item)
            if isinstance(bound, (list, tuple, set, frozenset)):
                plain += [as_value(x) for x in bound]
                continue
            v = self.value(item)
            if v.kind == "null":
                out = out | member.is_null
            else:
                plain.append(self._typed(left, item)[1])
        return out | member.in_iterable(plain) if plain else out

    def _bound(self, node: Node) -> Any:
        if node.op in ("bind", "name") and node.args[0] in self.bind:
            return self.bind[node.args[0]]
        return None

    def value(self, node: Node) -> Value:
        op, args = node.op, node.args
        if op == "literal":
            return as_value(args[0])
        if op == "bind" or op == "name" and args[0] in self.bind:
            if args[0] not in self.bind:
                raise ExpressionError(f"no value is given for :{args[0]}")
            bound = self.bind[args[0]]
            if isinstance(bound, (list, tuple, set, frozenset)):
                raise ExpressionError(f":{args[0]} is a collection, which belongs after IN")
            return as_value(bound)
        if op == "name":
            return self.resolve(args[0])
        if op == "neg":
            return negative(self.value(args[0]))
        if op in ("+", "-", "*", "/", "%"):
            return arithmetic(op, self.value(args[0]), self.value(args[1]))
        if op == "tuple":
            ends = [self.value(a) for a in args]
            if len(ends) == 2 and all(e.is_literal and e.kind in ("datetime", "null") for e in ends):
                return as_value(ts.Timespan(*(e.literal.nsec if e.literal else None for e in ends)))
            raise ExpressionError("a pair of times is expected")
        if op == "call":
            return self._call(args[0], [self.value(a) for a in args[1]])
        raise ExpressionError(f"{op} is not a value")

    def _call(self, name: str, args: Sequence[Value]) -> Value:
        if any(not a.is_literal for a in args):
            raise ExpressionError(f"{name} takes literals")
        x = [a.literal for a in args]
        numbers = all(a.kind in _NUMBERS for a in args)
        try:
            if name == "POINT" and len(x) == 2 and numbers:
                return as_value(Region.point(*x))
            if name == "CIRCLE" and len(x) == 3 and numbers:
                return as_value(Region.circle(*x))
            if name == "BOX" and len(x) == 4 and numbers:
                return as_value(Region.box(*x))
            if name == "POLYGON" and len(x) >= 6 and not len(x) % 2 and numbers:
                return as_value(Region.polygon(list(zip(x[::2], x[1::2], strict=True))))
            if name == "REGION" and len(x) == 1 and isinstance(x[0], str):
                return as_value(Region.from_pos(x[0]))
            if name == "UUID" and len(x) == 1 and isinstance(x[0], str):
                return as_value(uuid.UUID(x[0]))
        except ValueError as e:
            raise ExpressionError(f"{name}: {e}") from None
        raise ExpressionError(f"there is no function {name} of these arguments")


def predicate(text: str, resolve: Resolver, bind: Mapping[str, Any] | None = None) -> Predicate:
    """The predicate of a string; TRUE if it is empty."""
    tree = parse(text)
    return TRUE if tree is None else Converter(resolve, bind or {}).predicate(tree)


def frame_resolver(df: DataFrame) -> Resolver:
    """Identifiers are the columns of a frame."""
    kinds = {"bigint": "int", "int": "int", "string": "string", "double": "float", "float": "float", "boolean": "bool", "binary": "hash"}
    types = {c.lower(): (c, t) for c, t in df.dtypes}

    def resolve(name: str) -> Value:
        base, _, part = name.rpartition(".")
        if base and part in ("begin", "end") and base.lower() in types:
            return getattr(resolve(base), part)
        if name.lower() not in types:
            raise ExpressionError(f"unknown identifier {name!r}")
        column, t = types[name.lower()]
        kind = kinds.get(t, "timespan" if t.startswith("struct<begin") else "region" if t.startswith("struct<kind") else None)
        if kind is None:
            raise ExpressionError(f"{name} is of type {t}, which expressions do not have")
        return Value(kind, lambda: F.col(f"`{column}`"), frozenset((column,)))

    return resolve
