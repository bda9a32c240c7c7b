"""Queries written in Python: `where(F.age >= 18).sort_by(F.age).limit(10)`."""

from __future__ import annotations

from dataclasses import dataclass, replace

from .errors import invalid_argument
from .plans import ir
from .plans.ir import Param
from .plans.lang import parse_bound


class Path:
    """A field, or a path of fields; comparing it makes a condition."""

    __hash__ = None

    def __init__(self, names: tuple[str, ...] = ()):
        self._names = names

    def __getattr__(self, name: str) -> Path:
        if name.startswith("__"):
            raise AttributeError(name)
        return Path((*self._names, name))

    def __getitem__(self, name: str) -> Path:
        """A field whose name is no Python name, or the name of a method here; dots part the names of a path."""
        return Path((*self._names, *name.split(".")))

    def __eq__(self, value: object) -> ir.Expr:
        return ir.test(self._names, "==", value)

    def __ne__(self, value: object) -> ir.Expr:
        return ir.test(self._names, "!=", value)

    def __lt__(self, value: object) -> ir.Expr:
        return ir.test(self._names, "<", value)

    def __le__(self, value: object) -> ir.Expr:
        return ir.test(self._names, "<=", value)

    def __gt__(self, value: object) -> ir.Expr:
        return ir.test(self._names, ">", value)

    def __ge__(self, value: object) -> ir.Expr:
        return ir.test(self._names, ">=", value)

    def between(self, low: object, high: object) -> ir.Expr:
        return ir.test(self._names, "BETWEEN", low, high)

    def is_in(self, values: object) -> ir.Expr:
        return ir.test(self._names, "IN", *values)

    def contains(self, value: object) -> ir.Expr:
        return ir.test(self._names, "CONTAINS", value)

    def starts_with(self, value: object) -> ir.Expr:
        return ir.test(self._names, "STARTSWITH", value)

    def ends_with(self, value: object) -> ir.Expr:
        return ir.test(self._names, "ENDSWITH", value)

    def matches(self, search: object) -> ir.Expr:
        return ir.test(self._names, "MATCHES", search)

    def is_null(self) -> ir.Expr:
        return ir.Test(self._names, "IS NULL")

    def is_not_null(self) -> ir.Expr:
        return ir.Not(self.is_null())

    def asc(self) -> Order:
        return Order(self._names, False)

    def desc(self) -> Order:
        return Order(self._names, True)


@dataclass(frozen=True)
class Order:
    names: tuple[str, ...]
    descending: bool


F = Path()
ignore_case = ir.ignore_case


def param(number: int) -> Param:
    return Param(number)


def linked(collection: str, path: str, filter: ir.Expr | None = None) -> ir.Expr:
    """Some object of the collection links here through the path, and meets the filter."""
    return ir.Linked(collection, ir.path_of(path), filter)


@dataclass(frozen=True)
class Query:
    """A query; every method returns another one."""

    tree: ir.Query = ir.Query()

    def where(self, *conditions: ir.Expr) -> Query:
        held = (self.tree.filter,) if self.tree.filter else ()
        return Query(replace(self.tree, filter=ir.every(*held, *conditions)))

    def sort_by(self, *orders: Path | Order | str) -> Query:
        made = []
        for o in orders:
            o = Order(ir.path_of(o), False) if isinstance(o, str) else o.asc() if isinstance(o, Path) else o
            made.append((o.names, o.descending))
        return Query(replace(self.tree, sort=(*self.tree.sort, *made)))

    def limit(self, n: int) -> Query:
        return Query(replace(self.tree, limit=_count(n)))

    def offset(self, n: int) -> Query:
        return Query(replace(self.tree, offset=_count(n)))

    def first(self) -> Query:
        return Query(self.tree.first())

    def bind(self, *values: object) -> Query:
        return Query(ir.Prepared(self.tree).bind(*values))


def _count(n: int) -> int:
    if not isinstance(n, int) or isinstance(n, bool) or n < 0:
        raise invalid_argument("a limit or an offset is a whole number and not negative")
    return n


def where(*conditions: ir.Expr) -> Query:
    return Query().where(*conditions)


def tree_of(query: object, values: tuple[object, ...] = ()) -> ir.Query:
    """The tree of a text, a condition, a query, a prepared query or nothing, with the parameters' values."""
    match query:
        case None:
            return ir.Query()
        case str():
            return parse_bound(query, values)
        case Query():
            query = query.tree
        case ir.Expr():
            query = ir.Query(query)
        case ir.Prepared():
            query = query.query
        case ir.Query():
            pass
        case _:
            raise invalid_argument(f"{query!r} is no query")
    return ir.Prepared(query).bind(*values) if values else query
