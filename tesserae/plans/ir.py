"""Queries as trees: filters, sorts and pages, before they are resolved against a schema."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from ..errors import invalid_query
from ..values import Date, normal

#: The numbers of the operations in a query's portable form.
CODES = {
    "AND": 1, "OR": 2, "NOT": 3, "==": 4, "!=": 5, "<": 6, "<=": 7, ">": 8, ">=": 9, "BETWEEN": 10, "IN": 11, "CONTAINS": 12, "STARTSWITH": 13,
    "ENDSWITH": 14, "IS NULL": 15, "ANY": 16, "MATCHES": 17,
}
FOLDING = ("==", "!=", "IN", "CONTAINS", "STARTSWITH", "ENDSWITH")
MAX_DEPTH = 24
MAX_PARAMETERS = 65_536


@dataclass(frozen=True)
class Param:
    """A value that is given later."""

    number: int


@dataclass(frozen=True)
class Expr:
    def __and__(self, other: Expr) -> Expr:
        return every(self, other)

    def __or__(self, other: Expr) -> Expr:
        return some(self, other)

    def __invert__(self) -> Expr:
        return Not(self)


@dataclass(frozen=True)
class And(Expr):
    items: tuple[Expr, ...] = ()


@dataclass(frozen=True)
class Or(Expr):
    items: tuple[Expr, ...] = ()


@dataclass(frozen=True)
class Not(Expr):
    item: Expr


@dataclass(frozen=True)
class Test(Expr):
    path: tuple[str, ...]
    op: str
    values: tuple[object, ...] = ()
    fold: bool = False


@dataclass(frozen=True)
class Linked(Expr):
    """Some object of the collection links here through the path and meets the filter."""

    collection: str
    path: tuple[str, ...]
    filter: Expr | None = None


@dataclass(frozen=True)
class Query:
    filter: Expr | None = None
    sort: tuple[tuple[tuple[str, ...], bool], ...] = ()  # path, descending
    offset: int = 0
    limit: int | None = None

    def first(self) -> Query:
        return replace(self, limit=1 if self.limit is None else min(1, self.limit))


def _flat(kind: type, items: Iterable[Expr]) -> tuple[Expr, ...]:
    out: list[Expr] = []
    for item in items:
        out += item.items if isinstance(item, kind) else [item]
    return tuple(out)


def every(*items: Expr) -> Expr:
    flat = _flat(And, items)
    return flat[0] if len(flat) == 1 else And(flat)


def some(*items: Expr) -> Expr:
    flat = _flat(Or, items)
    return flat[0] if len(flat) == 1 else Or(flat)


def path_of(path: str | Iterable[str]) -> tuple[str, ...]:
    return tuple(path.split(".")) if isinstance(path, str) else tuple(path)


def test(path: str | Iterable[str], op: str, *values: object, fold: bool = False) -> Expr:
    """A test; equality with null becomes the test for null."""
    made = Test(path_of(path), op, tuple(normal(v) for v in values), fold)
    return null_test(made)


def null_test(t: Test) -> Expr:
    if t.op in ("==", "!=") and t.values == (None,):
        found = Test(t.path, "IS NULL")
        return found if t.op == "==" else Not(found)
    return t


def ignore_case(e: Expr) -> Expr:
    """The filter with every test that can ignore case doing so."""
    match e:
        case And(items):
            return And(tuple(map(ignore_case, items)))
        case Or(items):
            return Or(tuple(map(ignore_case, items)))
        case Not(item):
            return Not(ignore_case(item))
        case Linked(collection, path, inner):
            return Linked(collection, path, inner and ignore_case(inner))
        case Test(op=op, values=values) if op in FOLDING and values and all(isinstance(v, (str, Param)) for v in values):
            return replace(e, fold=True)
    return e


def bind(e: Expr | None, values: list[object]) -> Expr | None:
    """The filter with its parameters' values in their places."""

    def value(v: object) -> object:
        if not isinstance(v, Param):
            return v
        if v.number >= len(values):
            raise invalid_query(f"no value for ${v.number}: got {len(values)}")
        return normal(values[v.number])

    match e:
        case And(items):
            return And(tuple(bind(x, values) for x in items))
        case Or(items):
            return Or(tuple(bind(x, values) for x in items))
        case Not(item):
            return Not(bind(item, values))
        case Linked(collection, path, inner):
            return Linked(collection, path, bind(inner, values))
        case Test(path, op, operands, fold):
            return null_test(Test(path, op, tuple(map(value, operands)), fold))
    return e


def depth(e: Expr | None) -> int:
    match e:
        case And(items) | Or(items):
            return 1 + max(map(depth, items), default=0)
        case Not(item):
            return 1 + depth(item)
        case Linked(_, _, inner):
            return 1 + depth(inner)
        case None:
            return 0
    return 1


def check_depth(e: Expr | None) -> None:
    if depth(e) > MAX_DEPTH:
        raise invalid_query(f"query tree deeper than {MAX_DEPTH}")


def to_dict(q: Query) -> dict:
    """The query's portable form: plain lists and numbers."""
    return {"filter": q.filter and _dump(q.filter), "sort": [[list(p), d] for p, d in q.sort], "offset": q.offset, "limit": q.limit}


def from_dict(d: dict) -> Query:
    return Query(d["filter"] and _load(d["filter"]), tuple((tuple(p), bool(x)) for p, x in d["sort"]), d["offset"], d["limit"])


def _dump(e: Expr) -> list:
    match e:
        case And(items):
            return [CODES["AND"], *map(_dump, items)]
        case Or(items):
            return [CODES["OR"], *map(_dump, items)]
        case Not(item):
            return [CODES["NOT"], _dump(item)]
        case Linked(collection, path, inner):
            return [CODES["ANY"], collection, list(path), inner and _dump(inner)]
        case Test(path, op, values, fold):
            return [CODES[op], list(path), [_dump_value(v) for v in values], fold]
    raise TypeError(e)


def _load(x: list) -> Expr:
    code, *rest = x
    names = {v: k for k, v in CODES.items()}
    if code not in names:
        raise invalid_query(f"unknown operation code {code}")
    match names[code]:
        case "AND":
            return every(*map(_load, rest))
        case "OR":
            return some(*map(_load, rest))
        case "NOT":
            return Not(_load(rest[0]))
        case "ANY":
            return Linked(rest[0], tuple(rest[1]), rest[2] and _load(rest[2]))
    path, values, fold = rest
    return Test(tuple(path), names[code], tuple(_load_value(v) for v in values), fold)


def _dump_value(v: object) -> object:
    match v:
        case Param(n):
            return {"param": n}
        case Date(micros):
            return {"date": micros}
        case bytes():
            return {"bytes": v.hex()}
        case float():
            return {"float": repr(v)}
    return v


def _load_value(v: object) -> object:
    if isinstance(v, dict):
        ((kind, x),) = v.items()
        return {"param": Param, "date": Date, "bytes": bytes.fromhex, "float": float}[kind](x)
    return v


@dataclass(frozen=True)
class Prepared:
    """A parsed query whose parameters are given with each run."""

    query: Query = field(default_factory=Query)

    def bind(self, *values: object) -> Query:
        return replace(self.query, filter=bind(self.query.filter, list(values)))
