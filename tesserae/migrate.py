"""Schema versions: what a newer schema changes, what it may not, and how the rows follow."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from .errors import EngineError, invalid_argument
from .model import Collection, Field, Schema, Type
from .operators.changes import check_unique, default_of
from .plans.compile import quoted

if TYPE_CHECKING:
    from .database import ReadTransaction, WriteTransaction


@dataclass(frozen=True)
class Migration:
    """The steps to one version. A function gets the transactions of the previous schema and of the new one."""

    version: int
    renamed_collections: dict[str, str] = field(default_factory=dict)  # old to new
    renamed_fields: dict[tuple[str, str], str] = field(default_factory=dict)  # (collection, old) to new
    deleted: tuple[str, ...] = ()
    replaced: tuple[tuple[str, str], ...] = ()  # (collection, field): starts anew
    run: Callable[[ReadTransaction, WriteTransaction], None] | None = None


def same_schema(a: Schema, b: Schema) -> bool:
    return a.to_json() == b.to_json()


@dataclass
class Carried:
    """Where a declared collection's rows come from: the stored collection and, by present name, its fields."""

    stored: Collection
    fields: dict[str, str]  # present name to stored name; fields that start anew are left out


def steps_between(migrations: tuple[Migration, ...], old: int, new: int) -> list[Migration]:
    versions = [m.version for m in migrations]
    for v in versions:
        if versions.count(v) > 1:
            raise invalid_argument(f"there are two migrations to version {v}")
    return sorted((m for m in migrations if old < m.version <= new), key=lambda m: m.version)


def carry(stored: Schema, steps: list[Migration]) -> dict[str, Carried]:
    """What each name of the new schema stands for among the stored collections, after all renames."""
    now = {c.name: Carried(c, {f.name: f.name for f in c.all_fields}) for c in stored.collections}
    for m in steps:
        for name in m.deleted:
            if name not in now:
                raise invalid_argument(f"a migration deletes `{name}`, which there is not")
            del now[name]
        for old, new in m.renamed_collections.items():
            if old not in now:
                raise invalid_argument(f"a migration renames the collection `{old}`, which there is not")
            if new in now:
                raise invalid_argument(f"a migration renames `{old}` to `{new}`, which is there already")
            now[new] = now.pop(old)
        for (name, old), new in m.renamed_fields.items():
            c = now.get(name)
            if c is None or old not in c.fields:
                raise invalid_argument(f"a migration renames `{name}.{old}`, which there is not")
            if new in c.fields:
                raise invalid_argument(f"a migration renames `{name}.{old}` to `{new}`, which is there already")
            c.fields[new] = c.fields.pop(old)
        for name, gone in m.replaced:
            c = now.get(name)
            if c is None or gone not in c.fields:
                raise invalid_argument(f"a migration replaces `{name}.{gone}`, which there is not")
            if c.fields[gone] == c.stored.key_name:
                raise invalid_argument(f"a migration replaces the primary key of `{name}`")
            del c.fields[gone]
    return now


def check(declared: Schema, carried: dict[str, Carried]) -> None:
    """Refuse what would leave objects without a value, or change a value's meaning."""
    for name in carried.keys() - {c.name for c in declared.collections}:
        raise invalid_argument(f"the schema no longer has `{name}`; a migration has to delete it")
    for c in declared.collections:
        if (before := carried.get(c.name)) is None:
            continue
        if before.stored.auto != c.auto or before.fields.get(c.key_name) != before.stored.key_name:
            raise invalid_argument(f"the primary key of `{c.name}` changed, which no migration can do")
        for f in c.fields:
            old = before.stored.find(before.fields[f.name]) if f.name in before.fields else None
            _check_field(f"{c.name}.{f.name}", f, old, carried)


def _check_field(where: str, f: Field, old: Field | None, carried: dict[str, Carried]) -> None:
    needs = not f.optional and not f.has_default
    if old is None:
        if needs:
            raise invalid_argument(f"the new field `{where}` is required and has no default")
        return
    if not _same_shape(f.type, old.type, carried):
        raise invalid_argument(f"the type of `{where}` changed; a migration has to replace the field")
    if old.optional and needs:
        raise invalid_argument(f"`{where}` became required and has no default")
    if old.has_default and needs:
        raise invalid_argument(f"`{where}` lost its default")
    inner, before = f.type.item or f.type, old.type.item or old.type
    if inner.kind == "object":
        known = {g.name: g for g in before.fields}
        for g in inner.fields:
            _check_field(f"{where}.{g.name}", g, known.get(g.name), carried)


def _same_shape(new: Type, old: Type, carried: dict[str, Carried]) -> bool:
    if new.kind != old.kind:
        return False
    if new.kind == "list":
        return _same_shape(new.item, old.item, carried)
    if new.kind == "link":
        return new.target in carried and carried[new.target].stored.name == old.target
    return True


def migrate(txn: WriteTransaction, declared: Schema, migrations: tuple[Migration, ...]) -> None:
    """Bring the rows to the declared schema, run the functions in the order of versions, and commit all of it or nothing."""
    from .database import ReadTransaction

    steps = steps_between(migrations, txn.schema.version, declared.version)
    carried = carry(txn.schema, steps)
    check(declared, carried)
    old = ReadTransaction(txn.store, txn.base)
    tables, counters = {}, {}
    for c in declared.collections:
        before = carried.get(c.name)
        if before is None:
            continue
        name = before.stored.name
        counters |= {c.name: txn.counters[name]} if name in txn.counters else {}
        unchanged = all(f.name == before.fields.get(f.name) and f == before.stored.find(f.name) for f in c.fields)
        if unchanged and c.name == name or name not in txn.tables:
            tables[c.name] = list(txn.tables.get(name, []))
            continue
        df = old.frame(name)
        columns = [_column(f, before, declared).alias(f.name) for f in c.all_fields]
        tables[c.name] = [txn.write(df.select(*columns), c.name)]
    txn.schema, txn.tables, txn.counters, txn.indexes, txn.changed = declared, tables, counters, {}, True
    try:
        for m in steps:
            if m.run is not None:
                m.run(old, txn)
        for c in declared.collections:
            check_unique(txn.frame(c.name), declared, c)
    except EngineError:
        txn.abort()
        raise
    except Exception as e:
        txn.abort()
        raise EngineError("MIGRATION_FAILED", f"the migration's function failed: {e}") from e
    txn.commit()


def _column(f: Field, before: Carried, schema: Schema):
    stored = before.fields.get(f.name)
    if stored is None:
        return default_of(F.lit(None), schema, f)
    kept = before.stored.find(stored)
    value = quoted(stored)
    inner = f.type.item or f.type
    if inner.kind == "object" and inner != (kept.type.item or kept.type):
        known = {g.name for g in (kept.type.item or kept.type).fields}

        def made(x):
            return F.struct(*(default_of(x[g.name] if g.name in known else F.lit(None), schema, g).alias(g.name) for g in inner.fields))

        value = F.transform(value, made) if f.type.item else F.when(value.isNotNull(), made(value))
    return default_of(value, schema, f)


