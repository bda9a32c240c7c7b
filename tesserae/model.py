"""The data model: types, fields, collections and versioned schemas, and their Spark types."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from .errors import invalid_argument
from .values import Date, INT_MAX, INT_MIN, kind_of, normal

SCALARS = ("bool", "int", "float", "string", "bytes", "date")
KEYS = ("int", "string", "bytes")
AUTO_KEY = "id"
MAX_COMPONENTS = 8
MISSING = object()


@dataclass(frozen=True)
class Type:
    kind: str
    item: Type | None = None  # of a list
    target: str | None = None  # of a link
    fields: tuple[Field, ...] = ()  # of an embedded object

    def __str__(self) -> str:
        match self.kind:
            case "list":
                return f"list({self.item})"
            case "link":
                return f"link({self.target})"
            case "object":
                return "object(" + ", ".join(f.name for f in self.fields) + ")"
        return self.kind


Bool, Int, Float, String, Bytes, DateType = (Type(k) for k in SCALARS)


def List(item: Type) -> Type:  # noqa: N802
    return Type("list", item=item)


def Link(target: str) -> Type:  # noqa: N802
    return Type("link", target=target)


def Embedded(*fields: Field) -> Type:  # noqa: N802
    return Type("object", fields=fields)


@dataclass(frozen=True)
class Field:
    name: str
    type: Type
    optional: bool = False
    default: object = MISSING
    cascade: bool = False  # the object goes when the object it links to goes

    @property
    def has_default(self) -> bool:
        return self.default is not MISSING

    def filled(self) -> object:
        """What a field that is left out reads as; MISSING if it may not be left out."""
        return self.default if self.has_default else None if self.optional else MISSING


@dataclass(frozen=True)
class Index:
    paths: tuple[str, ...]
    unique: bool = False
    text: bool = False

    @classmethod
    def on(cls, *paths: str, unique: bool = False, text: bool = False) -> Index:
        return cls(paths, unique, text)


@dataclass(frozen=True)
class Collection:
    name: str
    fields: tuple[Field, ...]
    key: str | None = None  # None: the auto-increment `id`
    indexes: tuple[Index, ...] = ()

    @classmethod
    def of(cls, name: str, *fields: Field, key: str | None = None, indexes: tuple[Index, ...] = ()) -> Collection:
        return cls(name, fields, key, tuple(indexes))

    @property
    def auto(self) -> bool:
        return self.key is None

    @property
    def key_name(self) -> str:
        return self.key or AUTO_KEY

    @property
    def all_fields(self) -> tuple[Field, ...]:
        return ((Field(AUTO_KEY, Int),) if self.auto else ()) + self.fields

    @property
    def key_type(self) -> Type:
        return self.find(self.key_name).type

    def find(self, name: str) -> Field | None:
        return next((f for f in self.all_fields if f.name == name), None)


@dataclass(frozen=True)
class Schema:
    version: int
    collections: tuple[Collection, ...] = field(default_factory=tuple)

    @classmethod
    def of(cls, version: int, *collections: Collection) -> Schema:
        schema = cls(version, collections)
        schema.validate()
        return schema

    def find(self, name: str) -> Collection | None:
        return next((c for c in self.collections if c.name == name), None)

    def validate(self) -> None:
        if self.version < 1:
            raise invalid_argument("a schema's version is 1 or more")
        names = [c.name for c in self.collections]
        for c in self.collections:
            if not c.name:
                raise invalid_argument("a collection has an empty name")
            if names.count(c.name) > 1:
                raise invalid_argument(f"`{c.name}` is declared more than once")
            if c.auto and any(f.name == AUTO_KEY for f in c.fields):
                raise invalid_argument(f"`{c.name}` has its own `{AUTO_KEY}` and no primary key; the name belongs to the auto-increment key")
            self._fields(c.name, c.fields)
            if c.find(c.key_name) is None:
                raise invalid_argument(f"`{c.name}` doesn't have the primary key field `{c.key}`")
            key = c.find(c.key_name)
            if key.type.kind not in KEYS or key.optional or key.has_default:
                raise invalid_argument(f"the primary key of `{c.name}` must be a required int, string or bytes")
            for f in c.fields:
                if f.cascade and f.type.kind != "link":
                    raise invalid_argument(f"`{c.name}.{f.name}` cascades but isn't a link to one object")
            for index in c.indexes:
                self._index(c, index)

    def _fields(self, owner: str, fields: tuple[Field, ...]) -> None:
        for f in fields:
            where = f"{owner}.{f.name}"
            if not f.name:
                raise invalid_argument(f"`{owner}` has a field with an empty name")
            if sum(g.name == f.name for g in fields) > 1:
                raise invalid_argument(f"`{where}` is declared more than once")
            inner = f.type.item if f.type.kind == "list" else f.type
            if inner is None or inner.kind == "list":
                raise invalid_argument(f"`{where}` is a list of lists")
            if inner.kind == "link" and self.find(inner.target) is None:
                raise invalid_argument(f"`{where}` links to `{inner.target}`, which isn't a collection")
            if inner.kind == "object":
                self._fields(where, inner.fields)
            if f.has_default and (inner.kind not in SCALARS or not fits(normal(f.default), f.type, self)):
                raise invalid_argument(f"the default of `{where}` isn't of its type")

    def _index(self, c: Collection, index: Index) -> None:
        if not 1 <= len(index.paths) <= MAX_COMPONENTS:
            raise invalid_argument(f"an index of `{c.name}` has {len(index.paths)} fields, not 1 to {MAX_COMPONENTS}")
        if len(set(index.paths)) < len(index.paths):
            raise invalid_argument(f"an index of `{c.name}` names a field twice")
        for path in index.paths:
            fields, lists, f = c.all_fields, 0, None
            for name in path.split("."):
                if f is not None and (f.type.item or f.type).kind != "object":
                    raise invalid_argument(f"`{c.name}` indexes `{path}`, which goes past a value or through a link")
                f = next((x for x in fields if x.name == name), None)
                if f is None:
                    raise invalid_argument(f"`{c.name}` indexes `{path}`, which it doesn't have")
                lists += f.type.kind == "list"
                fields = (f.type.item or f.type).fields
            leaf = f.type.item or f.type
            if leaf.kind == "object":
                raise invalid_argument(f"`{c.name}` indexes `{path}`, an embedded object; index one of its fields")
            if lists > 1 or lists and len(index.paths) > 1:
                raise invalid_argument(f"`{c.name}` indexes `{path}` through lists: an index of one field may go through one list")
            if index.text and (index.unique or len(index.paths) > 1 or leaf.kind != "string"):
                raise invalid_argument(f"`{c.name}`: a text index is on one string or list of strings and isn't unique")

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "collections": [_dump_collection(c) for c in self.collections]}, indent=1)

    @classmethod
    def from_json(cls, text: str) -> Schema:
        data = json.loads(text)
        return cls(data["version"], tuple(_load_collection(c) for c in data["collections"]))


def fits(value: object, kind: Type, schema: Schema) -> bool:
    """Whether a value is exactly of the type."""
    match kind.kind:
        case "link":
            return fits(value, schema.find(kind.target).key_type, schema)
        case "list":
            return isinstance(value, list) and all(fits(v, kind.item, schema) for v in value)
        case "object":
            return isinstance(value, dict) and all(fits(v, f.type, schema) for f in kind.fields if (v := value.get(f.name)) is not None)
        case "int":
            return kind_of(value) == "int" and INT_MIN <= value <= INT_MAX
    return kind_of(value) == kind.kind


def spark_type(kind: Type, schema: Schema) -> T.DataType:
    match kind.kind:
        case "link":
            return spark_type(schema.find(kind.target).key_type, schema)
        case "list":
            return T.ArrayType(spark_type(kind.item, schema), containsNull=False)
        case "object":
            return T.StructType([T.StructField(f.name, spark_type(f.type, schema)) for f in kind.fields])
    return {"bool": T.BooleanType, "int": T.LongType, "float": T.DoubleType, "string": T.StringType, "bytes": T.BinaryType, "date": T.TimestampNTZType}[kind.kind]()


def nullable(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed within lists, as a cast from a list that Spark knows no better needs it."""
    match kind:
        case T.ArrayType():
            return T.ArrayType(nullable(kind.elementType), True)
        case T.StructType():
            return T.StructType([T.StructField(f.name, nullable(f.dataType), True) for f in kind.fields])
    return kind


def struct_type(c: Collection, schema: Schema) -> T.StructType:
    """The Spark type of a collection; links and the key are named in the fields' metadata."""
    out = []
    for f in c.all_fields:
        inner = f.type.item or f.type
        note = {"link": inner.target} if inner.kind == "link" else {}
        out.append(T.StructField(f.name, spark_type(f.type, schema), True, note | ({"key": True} if f.name == c.key_name else {})))
    return T.StructType(out)


def links_to(schema: Schema, target: str) -> Iterator[tuple[Collection, Field]]:
    """Every cascading link to the collection."""
    for c in schema.collections:
        for f in c.fields:
            if f.cascade and f.type.target == target:
                yield c, f


def _dump_type(t: Type) -> object:
    match t.kind:
        case "list":
            return {"list": _dump_type(t.item)}
        case "link":
            return {"link": t.target}
        case "object":
            return {"object": [_dump_field(f) for f in t.fields]}
    return t.kind


def _load_type(x: object) -> Type:
    if isinstance(x, str):
        return Type(x)
    ((kind, of),) = x.items()
    return List(_load_type(of)) if kind == "list" else Link(of) if kind == "link" else Embedded(*map(_load_field, of))


def _dump_value(v: object) -> object:
    v = normal(v)
    if isinstance(v, list):
        return [_dump_value(x) for x in v]
    return {"bytes": v.hex()} if isinstance(v, bytes) else {"date": v.micros} if isinstance(v, Date) else {"float": repr(v)} if isinstance(v, float) else v


def _load_value(v: object) -> object:
    if isinstance(v, list):
        return [_load_value(x) for x in v]
    if isinstance(v, dict):
        ((kind, of),) = v.items()
        return {"bytes": bytes.fromhex, "date": Date, "float": float}[kind](of)
    return v


def _dump_field(f: Field) -> dict:
    out = {"name": f.name, "type": _dump_type(f.type)}
    return out | ({"optional": True} if f.optional else {}) | ({"cascade": True} if f.cascade else {}) | ({"default": _dump_value(f.default)} if f.has_default else {})


def _load_field(x: dict) -> Field:
    return Field(x["name"], _load_type(x["type"]), x.get("optional", False), _load_value(x["default"]) if "default" in x else MISSING, x.get("cascade", False))


def _dump_collection(c: Collection) -> dict:
    return {"name": c.name, "key": c.key, "fields": [_dump_field(f) for f in c.fields], "indexes": [{"paths": i.paths, "unique": i.unique, "text": i.text} for i in c.indexes]}


def _load_collection(x: dict) -> Collection:
    return Collection(x["name"], tuple(map(_load_field, x["fields"])), x["key"], tuple(Index(tuple(i["paths"]), i["unique"], i["text"]) for i in x["indexes"]))


def with_fields(c: Collection, fields: tuple[Field, ...]) -> Collection:
    return replace(c, fields=fields)
