"""Paths and tests against a schema: what they name, and whether the values fit."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..errors import EngineError, invalid_query
from ..model import Collection, Schema, Type, fits
from ..values import EXACT_INT, kind_of, shown
from . import ir

MAX_PATH = 32
STRING_OPS = ("CONTAINS", "STARTSWITH", "ENDSWITH", "MATCHES")


@dataclass(frozen=True)
class Segment:
    """The part of a path within one object: names, and which of them are lists."""

    collection: Collection
    names: tuple[str, ...]
    lists: tuple[bool, ...]

    @property
    def many(self) -> bool:
        return any(self.lists)


@dataclass(frozen=True)
class Path:
    """A resolved path: its segments, apart by the links it follows, and the type at its end (of the elements, if a list)."""

    text: str
    segments: tuple[Segment, ...]
    leaf: Type
    list_leaf: bool
    rest: Path | None = field(default=None, compare=False)

    @property
    def many(self) -> bool:
        return any(s.many for s in self.segments)

    @property
    def link(self) -> bool:
        return self.leaf.kind == "link"

    def tail(self) -> Path:
        """What is left behind the first link."""
        return Path(self.text, self.segments[1:], self.leaf, self.list_leaf)


def resolve_path(schema: Schema, collection: Collection, names: tuple[str, ...]) -> Path:
    text = ".".join(names)
    if not 1 <= len(names) <= MAX_PATH:
        raise invalid_query(f"path `{text[:80]}`: {len(names)} parts, allowed are 1 to {MAX_PATH}")
    segments: list[Segment] = []
    owner, fields, row, lists, here = collection, collection.all_fields, [], [], None
    for k, name in enumerate(names):
        if here is not None:
            inner = here.item or here
            if inner.kind == "link":
                segments.append(Segment(owner, tuple(row), tuple(lists)))
                owner = schema.find(inner.target)
                fields, row, lists = owner.all_fields, [], []
            elif inner.kind == "object":
                fields = inner.fields
            else:
                raise invalid_query(f"path `{text}`: `{names[k - 1]}` is of type {here} and has no parts")
        found = next((f for f in fields if f.name == name), None)
        if found is None:
            raise invalid_query(f"path `{text}`: no field `{name}` in `{owner.name}`")
        here = found.type
        row.append(name)
        lists.append(here.kind == "list")
    leaf = here.item or here
    if leaf.kind == "object":
        raise invalid_query(f"path `{text}`: an embedded object as a whole has no order and no equality")
    return Path(text, (*segments, Segment(owner, tuple(row), tuple(lists))), leaf, here.kind == "list")


def check_test(schema: Schema, path: Path, t: ir.Test) -> ir.Test:
    """The test with its values as the field's type has them; INVALID_QUERY where they don't fit."""
    for v in t.values:
        if isinstance(v, ir.Param):
            raise invalid_query(f"unbound parameter ${v.number}")
    counts = {"IS NULL": 0, "BETWEEN": 2, "IN": len(t.values)}
    if len(t.values) != counts.get(t.op, 1):
        raise invalid_query(f"wrong number of operands for {t.op} on `{path.text}`: {len(t.values)}")
    if t.op == "MATCHES" and (path.leaf.kind != "string" or path.link):
        raise invalid_query(f"MATCHES needs text, `{path.text}` is of type {path.leaf}")
    if t.fold and (path.leaf.kind != "string" or path.link):
        raise invalid_query(f"IGNORE CASE needs text, `{path.text}` is of type {path.leaf}")
    if t.fold and t.op not in ir.FOLDING:
        raise invalid_query(f"no case-insensitive form of {t.op}")
    strings = t.fold or t.op in STRING_OPS and not (t.op == "CONTAINS" and path.list_leaf)
    if strings:
        for v in t.values:
            if path.leaf.kind != "string" or not isinstance(v, str):
                raise invalid_query(f"{t.op} needs text on both sides: `{path.text}` is of type {path.leaf}, the operand is {shown(v)}")
        return t
    return ir.Test(t.path, t.op, tuple(_fitted(schema, path, t.op, v) for v in t.values), t.fold)


def _fitted(schema: Schema, path: Path, op: str, v: object) -> object:
    if v is None:
        raise invalid_query(f"{op} on `{path.text}` with null: only == and != take it")
    if fits(v, path.leaf, schema):
        return v
    if path.leaf.kind == "float" and kind_of(v) == "int" and abs(v) <= EXACT_INT:
        return float(v)
    raise invalid_query(f"type mismatch: `{path.text}` of type {path.leaf} {op} {shown(v)}")


def sortable(path: Path) -> Path:
    if path.many:
        raise invalid_query(f"no order by `{path.text}`: it is many-valued")
    return path


def aggregated(path: Path, function: str) -> Path:
    if path.many:
        raise invalid_query(f"{function} over `{path.text}`: it is many-valued")
    if path.link:
        raise invalid_query(f"{function} over the link `{path.text}`: name a field behind it")
    takes = ("int", "float") if function in ("sum", "avg") else ("int", "float", "string", "bytes", "date")
    if path.leaf.kind not in takes:
        raise invalid_query(f"{function} is undefined for `{path.text}` of type {path.leaf}")
    return path


def collection_of(schema: Schema, name: str) -> Collection:
    if (found := schema.find(name)) is None:
        raise EngineError("INVALID_ARGUMENT", f"there is no collection `{name}`")
    return found
