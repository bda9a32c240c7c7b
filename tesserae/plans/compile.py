"""Resolved queries to DataFrames.

Conditions are two-valued, Spark's are three-valued. A filter is compiled by polarity: where it must hold, a plain
predicate will do, for rows where it is null are dropped; where it must not hold, the negation is written so that a
null keeps the row (`NOT x <=> v`, `x IS NULL OR NOT x < v`). Both forms reach the Parquet scan, unlike a coalesce.

Links are joins: to-one links are left joins to the target's columns, one per distinct prefix of paths, or inner joins
where a conjunct of the filter tests what they lead to; to-many links and backlinks are semi-joins by key where they stand
among the conjuncts of the filter, or joins to a flag per key where they stand under OR or NOT. Spark picks the join
strategy by the sizes it sees; nothing is broadcast by force.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import invalid_query
from ..functions.text import Words, fold, folded
from ..model import Collection, Schema
from ..values import literal
from . import ir
from .resolve import Path, Segment, check_test, resolve_path, sortable

Frames = Callable[[str], DataFrame]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class Plan:
    """A collection's rows on their way through one query; columns of joined targets are added as paths need them."""

    def __init__(self, schema: Schema, frames: Frames, collection: Collection, numbers: itertools.count | None = None, base: DataFrame | None = None):
        self.schema, self.frames, self.collection = schema, frames, collection
        self.df = frames(collection.name) if base is None else base
        self.columns = self.df.columns
        self.joined: dict[tuple[str, ...], Callable[[str], Column]] = {}
        self.numbers = numbers or itertools.count()
        self.how = "left"

    @property
    def key(self) -> Column:
        return quoted(self.collection.key_name)

    # values of paths

    def single(self, path: Path) -> Column:
        """The value of a path without lists: joins what its links lead to."""
        at, prefix = quoted, ()
        for k, segment in enumerate(path.segments):
            value = _within(at, segment)
            prefix += segment.names
            if k + 1 == len(path.segments):
                return value
            at = self.follow(prefix, value, path.segments[k + 1].collection)
        raise AssertionError

    def follow(self, prefix: tuple[str, ...], link: Column, target: Collection) -> Callable[[str], Column]:
        """The columns of what a to-one link leads to, null where nothing is there."""
        if prefix not in self.joined:
            tag = f"__t{next(self.numbers)}_"
            right = self.frames(target.name)
            right = right.select(*(quoted(c).alias(tag + c) for c in right.columns))
            self.df = self.df.join(right, link == quoted(tag + target.key_name), self.how)
            self.joined[prefix] = lambda name: quoted(tag + name)
        return self.joined[prefix]

    # filters

    def filter(self, e: ir.Expr | None) -> None:
        """Keep the rows that the filter holds for."""
        if e is None:
            return
        ir.check_depth(e)
        later = []
        for item in e.items if isinstance(e, ir.And) else (e,):
            bare = item.item if isinstance(item, ir.Not) else item
            if isinstance(bare, ir.Linked):
                later.append((bare, bare is item))
                continue
            if isinstance(item, ir.Test) and item.op != "IS NULL" and (keys := self.to_many(item)) is not None:
                self.df = self.df.join(keys, self.key == quoted(keys.columns[0]), "left_semi")
                continue
            # A test that must hold of what a link leads to drops the rows whose links lead to nothing.
            self.how = "inner" if isinstance(item, ir.Test) and item.op != "IS NULL" else "left"
            held = self.holds(item)  # may join first
            self.df = self.df.where(held)
            self.how = "left"
        for linked, positive in later:
            keys = self.linking(linked)
            self.df = self.df.join(keys, self.key == quoted(keys.columns[0]), "left_semi" if positive else "left_anti")

    def holds(self, e: ir.Expr) -> Column:
        match e:
            case ir.And(items):
                return _all([self.holds(x) for x in items])
            case ir.Or(items):
                return _any([self.holds(x) for x in items])
            case ir.Not(item):
                return self.fails(item)
            case ir.Linked():
                return self.flag(self.linking(e))
            case ir.Test():
                return self.tested(e, True)
        raise TypeError(e)

    def fails(self, e: ir.Expr) -> Column:
        match e:
            case ir.And(items):
                return _any([self.fails(x) for x in items])
            case ir.Or(items):
                return _all([self.fails(x) for x in items])
            case ir.Not(item):
                return self.holds(item)
            case ir.Linked():
                return ~self.flag(self.linking(e))
            case ir.Test():
                return self.tested(e, False)
        raise TypeError(e)

    def tested(self, t: ir.Test, positive: bool) -> Column:
        path = resolve_path(self.schema, self.collection, t.path)
        t = check_test(self.schema, path, t)
        if any(s.many for s in path.segments[:-1]):
            found = self.flag(self.by_links(path, t))
            if t.op == "IS NULL":
                found = found | self.links_of(path)[0].isNull()
            return found if positive else ~F.coalesce(found, F.lit(False))
        at, prefix = quoted, ()
        for k, segment in enumerate(path.segments[:-1]):
            value = _within(at, segment)
            prefix += segment.names
            at = self.follow(prefix, value, path.segments[k + 1].collection)
        last = path.segments[-1]
        value = _within(at, last)
        if not last.many:
            return condition(value, t, path) if positive else negation(value, t, path)
        if t.op == "IS NULL":
            found = value.isNull() if last.lists == (*(False,) * (len(last.lists) - 1), True) else value.isNull() | F.exists(value, lambda x: x.isNull())
            return found if positive else ~found
        found = F.exists(value, lambda x: condition(x, t, path))
        return found if positive else ~F.coalesce(found, F.lit(False))

    # to-many links

    def links_of(self, path: Path) -> tuple[Column, int]:
        """The keys in the first list of links that the path goes through, and the number of segments up to there."""
        at, prefix = quoted, ()
        for k, segment in enumerate(path.segments):
            value = _within(at, segment)
            if segment.many:
                return value, k + 1
            prefix += segment.names
            at = self.follow(prefix, value, path.segments[k + 1].collection)
        raise AssertionError

    def to_many(self, t: ir.Test) -> DataFrame | None:
        path = resolve_path(self.schema, self.collection, t.path)
        return self.by_links(path, check_test(self.schema, path, t)) if any(s.many for s in path.segments[:-1]) else None

    def by_links(self, path: Path, t: ir.Test) -> DataFrame:
        """The keys of the rows one of whose links leads to an object that the test holds for (a missing one, for IS NULL)."""
        links, used = self.links_of(path)
        rest = Path(path.text, path.segments[used:], path.leaf, path.list_leaf)
        target = rest.segments[0].collection
        inner = Plan(self.schema, self.frames, target, self.numbers)
        names = tuple(n for s in rest.segments for n in s.names)
        inner_test = ir.Test(names, t.op, t.values, t.fold)
        met = inner.fails(inner_test) if t.op == "IS NULL" else inner.holds(inner_test)
        inner.df = inner.df.where(met)
        n = next(self.numbers)
        own, link, key = f"__k{n}", f"__e{n}", f"__g{n}"
        pairs = self.df.select(self.key.alias(own), F.explode(links).alias(link))
        targets = inner.df.select(inner.key.alias(key))
        # A link to nothing, or to an object whose leaf is null: what doesn't lead to an object with a value.
        how = "left_anti" if t.op == "IS NULL" else "left_semi"
        return pairs.join(targets, quoted(link) == quoted(key), how).select(own).distinct()

    def linking(self, e: ir.Linked) -> DataFrame:
        """The distinct keys that the objects of another collection link to."""
        owner = self.schema.find(e.collection)
        if owner is None:
            raise invalid_query(f"ANY: unknown collection `{e.collection}`")
        path = resolve_path(self.schema, owner, e.path)
        if len(path.segments) > 1 or not path.link or path.leaf.target != self.collection.name:
            raise invalid_query(f"`{e.collection}.{path.text}` is not a link to `{self.collection.name}`")
        inner = Plan(self.schema, self.frames, owner, self.numbers)
        inner.filter(e.filter)
        value = _within(quoted, path.segments[0])
        key = f"__k{next(self.numbers)}"
        found = inner.df.select((F.explode(value) if path.many else value).alias(key))
        return found.where(quoted(key).isNotNull()).distinct()

    def flag(self, keys: DataFrame) -> Column:
        """Whether a row's key is among the distinct keys."""
        key, flag = keys.columns[0], f"__f{next(self.numbers)}"
        self.df = self.df.join(keys.withColumn(flag, F.lit(True)), self.key == quoted(key), "left")
        return F.coalesce(quoted(flag), F.lit(False))

    # order and pages

    def ordered(self, q: ir.Query) -> list[Column]:
        out = []
        for names, descending in q.sort:
            value = self.single(sortable(resolve_path(self.schema, self.collection, names)))
            out.append(value.desc_nulls_last() if descending else value.asc_nulls_first())
        return [*out, self.key.asc()]

    def paged(self, q: ir.Query, order: bool = True) -> None:
        """Sort and cut. Without a page and an observed order, there is nothing to do."""
        keys = self.ordered(q)
        if q.offset or q.limit is not None or order:
            self.df = self.df.orderBy(*keys)
        if q.offset:
            self.df = self.df.offset(q.offset)
        if q.limit is not None:
            self.df = self.df.limit(q.limit)

    def rows(self) -> DataFrame:
        return self.df.select(*map(quoted, self.columns))


def _within(at: Callable[[str], Column], segment: Segment) -> Column:
    """The value of a path within one object: an array if it goes through a list. A null list further in gives one null."""

    def inner(value: Column, k: int) -> Column:
        """The array of values of names[k:] within value, names[k - 1] being no list."""
        if k == len(segment.names):
            return F.array(value)
        value = value[segment.names[k]]
        return F.coalesce(each(value, k), F.array(F.lit(None))) if segment.lists[k] else inner(value, k + 1)

    def each(value: Column, k: int) -> Column:
        return value if k + 1 == len(segment.names) else F.flatten(F.transform(value, lambda x: inner(x, k + 1)))

    value = at(segment.names[0])
    for k in range(len(segment.names)):
        if k:
            value = value[segment.names[k]]
        if segment.lists[k]:
            return each(value, k)
    return value


def condition(x: Column, t: ir.Test, path: Path) -> Column:
    """The test of one value; null for null, unless it is the test for null."""
    values = t.values
    if t.fold:
        x, values = fold(x), tuple(map(folded, values))
    v = [literal(y) for y in values]
    match t.op:
        case "==":
            return x == v[0]
        case "!=":
            return x != v[0]
        case "<":
            return x < v[0]
        case "<=":
            return x <= v[0]
        case ">":
            return x > v[0]
        case ">=":
            return x >= v[0]
        case "BETWEEN":
            return (x >= v[0]) & (x <= v[1])
        case "IN":
            if any(y == 0.0 for y in values if isinstance(y, float)):
                v += [F.lit(0.0), F.lit(-0.0)]  # long lists are looked up by bits
            return x.isin(*v) if v else F.lit(False)
        case "CONTAINS":
            return x == v[0] if path.list_leaf else x.contains(v[0])
        case "STARTSWITH":
            return x.startswith(v[0])
        case "ENDSWITH":
            return x.endswith(v[0])
        case "MATCHES":
            return Words.of(values[0]).found_in(x)
        case "IS NULL":
            return x.isNull()
    raise invalid_query(f"`{t.op}` is no test")


def negation(x: Column, t: ir.Test, path: Path) -> Column:
    """Where the test of one value doesn't hold, null included."""
    match t.op:
        case "IS NULL":
            return x.isNotNull()
        case "==":
            return ~(fold(x) if t.fold else x).eqNullSafe(literal(folded(t.values[0]) if t.fold else t.values[0]))
    return x.isNull() | ~condition(x, t, path)


def _all(items: list[Column]) -> Column:
    out = items[0] if items else F.lit(True)
    for x in items[1:]:
        out = out & x
    return out


def _any(items: list[Column]) -> Column:
    out = items[0] if items else F.lit(False)
    for x in items[1:]:
        out = out | x
    return out


def find(schema: Schema, frames: Frames, collection: Collection, q: ir.Query, order: bool = True, base: DataFrame | None = None) -> DataFrame:
    """The objects that a query finds, in its order (or, without order, in any, if no page is cut).

    The filter's objects are among the rows of base, if it is given.
    """
    plan = Plan(schema, frames, collection, base=base)
    plan.filter(q.filter)
    plan.paged(q, order)
    return plan.rows()
