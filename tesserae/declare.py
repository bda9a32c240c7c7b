"""Schemas declared as classes.

    @embedded
    class Address:
        city: str
        zip: int | None

    @collection("users")
    class User:
        name: str
        email: str | None = field(unique=True)
        age: int = field(default=0, index=True)
        friends: list[Link["users"]] | None
        address: Address | None

    schema = schema_of(1, User)

A class without a field that is a key has the auto-increment `id`. `objects(df, User)` makes instances of rows.
"""

from __future__ import annotations

import datetime as dt
import types
import typing
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .database import _object
from .errors import invalid_argument
from .model import MISSING, Bool, Bytes, Collection, DateType, Embedded, Field, Float, Index, Int, List, Schema, String, Type
from .model import Link as link_to
from .values import Date

PLAIN = {bool: Bool, int: Int, float: Float, str: String, bytes: Bytes, Date: DateType, dt.datetime: DateType, dt.date: DateType}


class Link:
    """`Link["users"]`: a link to an object of that collection."""

    def __init__(self, target: str):
        self.target = target

    def __class_getitem__(cls, target: str) -> Link:
        return cls(target)

    def __or__(self, other: object) -> typing.Any:
        return _Optional(self) if other is type(None) or other is None else NotImplemented


@dataclass(frozen=True)
class _Optional:
    of: object


@dataclass(frozen=True)
class Declared:
    name: str | None = None
    default: object = MISSING
    key: bool = False
    index: bool = False
    unique: bool = False
    text: bool = False
    cascade: bool = False


def field(**options: object) -> typing.Any:
    """A field's stored name, default, key, index, unique, text and cascade."""
    return Declared(**options)


def _type(hint: object) -> tuple[Type, bool]:
    """The model's type of an annotation, and whether None is among its values."""
    if isinstance(hint, _Optional):
        return _type(hint.of)[0], True
    if typing.get_origin(hint) in (typing.Union, types.UnionType):
        rest = [a for a in typing.get_args(hint) if a is not type(None)]
        if len(rest) == 1:
            return _type(rest[0])[0], True
    elif typing.get_origin(hint) is list:
        return List(_type(typing.get_args(hint)[0])[0]), False
    elif isinstance(hint, Link):
        return link_to(hint.target), False
    elif isinstance(hint, type) and hasattr(hint, "__embedded__"):
        return Embedded(*hint.__embedded__), False
    elif hint in PLAIN:
        return PLAIN[hint], False
    raise invalid_argument(f"{hint!r} is no type of a field")


def _fields(cls: type) -> Iterator[tuple[str, Field, Declared]]:
    for name, hint in typing.get_type_hints(cls).items():
        given = cls.__dict__.get(name, MISSING)
        how = given if isinstance(given, Declared) else Declared(default=given)
        kind, optional = _type(hint)
        default = how.default if how.default is not None else MISSING
        yield name, Field(how.name or name, kind, optional, default, how.cascade), how


def _constructor(cls: type) -> None:
    names = [n for n, _, _ in _fields(cls)]

    def init(self: object, **values: object) -> None:
        if unknown := values.keys() - {*names, "id"}:
            raise TypeError(f"{cls.__name__} has no field {sorted(unknown)[0]}")
        for n in names:
            setattr(self, n, values.get(n))
        if "id" in values:
            self.id = values["id"]

    cls.__init__ = init
    cls.__repr__ = lambda self: f"{cls.__name__}({', '.join(f'{k}={v!r}' for k, v in vars(self).items())})"
    cls.__eq__ = lambda self, other: type(self) is type(other) and vars(self) == vars(other)


def embedded(cls: type) -> type:
    """A class of objects that live within others."""
    cls.__embedded__ = tuple(f for _, f, _ in _fields(cls))
    cls.__names__ = {f.name: n for n, f, _ in _fields(cls)}
    _constructor(cls)
    return cls


def collection(name: str, indexes: Iterable[Index] = ()) -> Callable[[type], type]:
    """A class of a collection's objects."""

    def made(cls: type) -> type:
        found = list(_fields(cls))
        keys = [f.name for _, f, how in found if how.key]
        if len(keys) > 1:
            raise invalid_argument(f"`{name}` declares more than one key")
        own = [Index.on(f.name, unique=how.unique) for _, f, how in found if how.index or how.unique]
        own += [Index.on(f.name, text=True) for _, f, how in found if how.text]
        cls.__collection__ = Collection(name, tuple(f for _, f, _ in found), keys[0] if keys else None, (*own, *indexes))
        cls.__names__ = {f.name: n for n, f, _ in found}
        _constructor(cls)
        return cls

    return made


def schema_of(version: int, *classes: type) -> Schema:
    return Schema.of(version, *(c.__collection__ for c in classes))


def values_of(obj: object) -> dict:
    """The stored fields of an instance, for insert and put."""

    def plain(v: object) -> object:
        return values_of(v) if hasattr(type(v), "__names__") else [plain(x) for x in v] if isinstance(v, list) else v

    names = {n: stored for stored, n in type(obj).__names__.items()}
    return {names.get(k, k): plain(v) for k, v in vars(obj).items() if v is not None}


def objects(df: DataFrame, cls: type) -> Iterator[object]:
    """Instances of a result's rows, a partition at a time; embedded objects stay dictionaries."""
    for row in df.toLocalIterator():
        yield cls(**{cls.__names__.get(k, k): v for k, v in _object(row).items()})
