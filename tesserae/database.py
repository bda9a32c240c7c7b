"""A database of collections: reads of one commit, and writes that become the next one."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .builder import tree_of
from .errors import EngineError, invalid_argument
from .migrate import Migration, migrate, same_schema
from .model import Collection, Schema, fits, spark_type
from .operators import aggregate as agg
from .operators import changes
from .operators.indexes import narrowed
from .plans import ir
from .plans.compile import find, quoted
from .plans.lang import parse
from .plans.resolve import collection_of
from .sources.snapshot import Commit, Store, folders_of
from .values import Date, EPOCH, literal, normal


def prepare(text: str) -> ir.Prepared:
    """A query text whose parameters' values are given with each run."""
    return parse(text)


class Reader:
    """The queries of one collection. Results are DataFrames; nothing is read before an action."""

    def __init__(self, schema: Schema, frames: Callable[[str], DataFrame], name: str, narrow: Callable[[Collection, ir.Expr | None], DataFrame | None] | None = None):
        self.schema, self.frames = schema, frames
        self.collection: Collection = collection_of(schema, name)
        self.narrow = narrow

    def _base(self, tree: ir.Query) -> DataFrame | None:
        """The rows that stored indexes leave of the collection for a query, if they help."""
        return self.narrow(self.collection, tree.filter) if self.narrow else None

    def frame(self) -> DataFrame:
        return self.frames(self.collection.name)

    def find(self, query: object = None, *values: object, ordered: bool = True) -> DataFrame:
        """The objects found, in the query's order; without ordered, no sort that a page doesn't need."""
        tree = tree_of(query, values)
        return find(self.schema, self.frames, self.collection, tree, ordered, self._base(tree))

    def find_one(self, query: object = None, *values: object) -> dict | None:
        tree = tree_of(query, values).first()
        found = find(self.schema, self.frames, self.collection, tree, base=self._base(tree)).collect()
        return _object(found[0]) if found else None

    def count(self, query: object = None, *values: object) -> int:
        tree = tree_of(query, values)
        return agg.count(self.schema, self.frames, self.collection, tree, self._base(tree))

    def aggregate(self, function: str, path: str, query: object = None, *values: object) -> object:
        tree = tree_of(query, values)
        return agg.aggregate(self.schema, self.frames, self.collection, function, path, tree, self._base(tree))

    def sum(self, path: str, query: object = None, *values: object) -> object:
        return self.aggregate("sum", path, query, *values)

    def min(self, path: str, query: object = None, *values: object) -> object:
        return self.aggregate("min", path, query, *values)

    def max(self, path: str, query: object = None, *values: object) -> object:
        return self.aggregate("max", path, query, *values)

    def avg(self, path: str, query: object = None, *values: object) -> object:
        return self.aggregate("avg", path, query, *values)

    def get(self, key: object) -> dict | None:
        """The object with the key: a filter that reaches the scan, whose row groups without the key are skipped."""
        found = self.frame().where(quoted(self.collection.key_name) == self._key(key)).collect()
        return _object(found[0]) if found else None

    def get_many(self, keys: Iterable[object]) -> DataFrame:
        """(position, the object's fields): a row per key, in their order; all null for a key that isn't there."""
        df = self.frame()
        kind = spark_type(self.collection.key_type, self.schema)
        keys = [changes.stored(normal(k)) for k in keys]
        asked = df.sparkSession.createDataFrame(list(enumerate(keys)), f"__position long, __key {kind.simpleString()}")
        return asked.join(df, F.col("__key") == quoted(self.collection.key_name), "left").orderBy("__position").select(F.col("__position").alias("position"), *map(quoted, df.columns))

    def iter(self) -> Iterator[dict]:
        """Every object in key order, a partition at a time."""
        return map(_object, self.find().toLocalIterator())

    def visit(self, f: Callable[[Iterator[object]], None], query: object = None, *values: object) -> None:
        """Call f with the rows of each partition, where they are."""
        self.find(query, *values, ordered=False).foreachPartition(f)

    def range(self, low: object = None, high: object = None, descending: bool = False) -> DataFrame:
        """The objects with keys from low to high, both included, in key order."""
        df, key = self.frame(), quoted(self.collection.key_name)
        for bound, test in ((low, lambda v: key >= v), (high, lambda v: key <= v)):
            if bound is not None:
                df = df.where(test(self._key(bound)))
        return df.orderBy(key.desc() if descending else key.asc())

    def __len__(self) -> int:
        return self.frame().count()

    def is_empty(self) -> bool:
        return self.frame().isEmpty()

    def _key(self, key: object):
        key = normal(key)
        if not fits(key, self.collection.key_type, self.schema):
            raise invalid_argument(f"the key of `{self.collection.name}` is of another type than {key!r}")
        return literal(key)


class Writer(Reader):
    """A collection within a write transaction; reads see its own changes."""

    def __init__(self, txn: WriteTransaction, name: str):
        super().__init__(txn.schema, txn.frame, name, lambda c, e: narrowed(txn.store, txn.state(), c, e))
        self.txn = txn

    @property
    def _key_name(self) -> str:
        return self.collection.key_name

    def insert(self, obj: dict) -> object:
        """Insert an object; its key."""
        return self.insert_many([obj])[0]

    def insert_many(self, objects: list[dict] | DataFrame) -> list[object] | None:
        """Insert objects (their keys are returned) or the rows of a DataFrame; DUPLICATE_KEY if a key or unique value is taken."""
        return self._put(objects, replacing=False)

    def put(self, obj: dict) -> object:
        return self.put_many([obj])[0]

    def put_many(self, objects: list[dict] | DataFrame) -> list[object] | None:
        """Insert objects or replace those with their keys; of objects with one key, the last stays."""
        return self._put(objects, replacing=True)

    def _put(self, objects: list[dict] | DataFrame, replacing: bool) -> list[object] | None:
        txn, c, key = self.txn, self.collection, self._key_name
        counter = txn.counters.get(c.name, 1)
        keys, numbered = None, False
        if isinstance(objects, DataFrame):
            df = changes.with_defaults(objects, self.schema, c)
            if c.auto:
                first = changes.next_number(df, counter)
                df, numbered = changes.number_rows(df, txn.stage, key, first)
                numbered = numbered and first < 1 << 62  # numbers so far from the last one can't run into it
            changes.missing(df, c)
        else:
            made, keys = [], []
            for o in objects:
                o = dict(o)
                if c.auto and o.get(key) is None:
                    o[key] = counter
                o = changes.complete(self.schema, c.name, c.all_fields, o)
                if c.auto and o[key] >= counter:
                    counter = o[key] + 1
                made.append(o)
                keys.append(o[key])
            if replacing:
                made = list({o[key]: o for o in made}.values())
            if not made:
                return keys
            df = changes.rows_of(txn.spark, self.schema, c, made)
        folder, new = txn.staged(df)
        if c.auto and isinstance(objects, DataFrame):
            counter = changes.next_number(new, counter)
        old = self.frame()
        if not numbered:
            changes.repeated_key(new, key)
        if replacing and not numbered:
            taken = new.select(quoted(key).alias("__k"))
            entries = txn.rewritten(c, taken, lambda part: changes.without(part, key, taken))
            changes.check_unique(txn.store.read_rows(txn.schema, c.name, [*entries, folder]), self.schema, c, new)
            txn.point(c.name, [*entries, folder])
        else:
            if not numbered:  # the counter is beyond every key there is
                changes.taken_key(old, new, key)
            changes.check_unique(old.union(new), self.schema, c, new)
            txn.point(c.name, [*txn.tables.get(c.name, ()), folder])
        if c.auto:
            txn.counters[c.name] = counter
        return keys

    def update(self, key: object, given: dict) -> bool:
        """Set fields of the object with the key; whether it is there."""
        keys = self.frame().where(quoted(self._key_name) == self._key(key)).select(quoted(self._key_name).alias("__k"))
        return self._update(keys, given) > 0

    def update_where(self, query: object, given: dict, *values: object) -> int:
        """Set fields of the objects found, all or none; their number. The keys are found first."""
        return self._update(self._keys(query, values), given)

    def change(self, *, key: object = None, query: object = None, **given: object) -> int:
        """update or update_where with the fields as arguments."""
        return self.update_where(query, given) if key is None else int(self.update(key, given))

    def _update(self, keys: DataFrame, given: dict) -> int:
        c, txn = self.collection, self.txn
        keys = txn.stage(keys)
        change = lambda df: changes.updated(df, self.schema, c, keys, given)
        change(self.frame())  # refuses what can't be set, whether or not anything is found
        n = keys.count()
        if n and given:
            entries = txn.rewritten(c, keys, change)
            if any(p.split(".")[0] in given for i in c.indexes if i.unique for p in i.paths):
                df = txn.store.read_rows(txn.schema, c.name, entries)
                changes.check_unique(df, self.schema, c, df.join(keys, quoted(self._key_name) == F.col("__k"), "left_semi"))
            txn.point(c.name, entries)
        return n

    def delete(self, key: object) -> bool:
        """Delete the object with the key, and what cascades; whether it is there."""
        return self._delete(self.frame().where(quoted(self._key_name) == self._key(key)).select(quoted(self._key_name).alias("__k"))) > 0

    def delete_where(self, query: object = None, *values: object) -> int:
        """Delete the objects found, and what cascades; the number found."""
        return self._delete(self._keys(query, values))

    def _delete(self, keys: DataFrame) -> int:
        keys = self.txn.stage(keys)
        gone = changes.cascade(self.schema, self.txn.frame, self.txn.stage, self.collection.name, keys)
        for name, lost in gone.items():
            c = self.schema.find(name)
            self.txn.point(name, self.txn.rewritten(c, lost, lambda part, c=c, lost=lost: changes.without(part, c.key_name, lost)))
        return keys.count()

    def _keys(self, query: object, values: tuple[object, ...]) -> DataFrame:
        tree = tree_of(query, values)
        found = find(self.schema, self.frames, self.collection, tree, False, self._base(tree))
        return found.select(quoted(self._key_name).alias("__k"))


class ReadTransaction:
    """One commit, whatever is written meanwhile."""

    def __init__(self, store: Store, commit: Commit):
        self.store, self.commit = store, commit
        self.schema = commit.schema

    def frame(self, name: str) -> DataFrame:
        return self.store.frame(self.commit, name)

    def collection(self, name: str) -> Reader:
        return Reader(self.schema, self.frame, name, lambda c, e: narrowed(self.store, self.commit, c, e))

    def __enter__(self) -> ReadTransaction:
        return self

    def __exit__(self, *_: object) -> None:
        pass


#: So many keys are looked for by value, which lets the scan skip row groups without them.
FEW_KEYS = 1000


class WriteTransaction:
    """Changes on top of a commit. Nothing is seen by others before commit(); abort() leaves nothing.

    A change rewrites the files that hold what it changes; the others are named again. The frames of a transaction are
    read while it is open: folders that the commit doesn't name go at its end.
    """

    def __init__(self, store: Store, commit: Commit):
        self.store, self.base, self.spark = store, commit, store.spark
        self.schema = commit.schema
        self.tables = {k: list(v) for k, v in commit.tables.items()}
        self.counters = dict(commit.counters)
        self.indexes = commit.indexes
        self.made: list[str] = []
        self.changed = False
        self.open = True

    def collection(self, name: str) -> Writer:
        self._opened()
        return Writer(self, name)

    def frame(self, name: str) -> DataFrame:
        self._opened()
        return self.store.frame(self.state(), name)

    def state(self) -> Commit:
        """What the transaction would commit now."""
        return Commit(self.base.number + 1, self.schema, {k: tuple(v) for k, v in self.tables.items()}, self.counters, self.indexes)

    def write(self, df: DataFrame, name: str) -> str:
        """Write rows to a new folder, which goes at the end if the commit doesn't name it."""
        folder = self.store.write(df, name)
        self.made.append(folder)
        return folder

    def staged(self, df: DataFrame) -> tuple[str, DataFrame]:
        folder = self.write(df, "staged")
        return folder, self.spark.read.schema(df.schema).parquet(f"{self.store.root}/{folder}")

    def stage(self, df: DataFrame) -> DataFrame:
        """Write rows to a folder that no commit names: lineage is cut, and what follows sees the same rows whenever it runs."""
        return self.staged(df)[1]

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows as a folder of their own; the others stay where they are."""
        self.point(name, [*self.tables.get(name, ()), self.write(df, name)])

    def point(self, name: str, entries: list[str]) -> None:
        """Let the collection have the rows of these folders and files."""
        if entries != self.tables.get(name):
            self.tables[name] = entries
            self.changed = True

    def holding(self, c: Collection, keys: DataFrame) -> list[str]:
        """The files that hold rows with the keys (column __k)."""
        if not self.tables.get(c.name):
            return []
        rows = self.frame(c.name).select(quoted(c.key_name).alias("__key"), F.col("_metadata.file_path").alias("__file"))
        few = keys.limit(FEW_KEYS + 1).collect() if c.key_type.kind in ("int", "string") else None
        if few is not None and len(few) <= FEW_KEYS:
            rows = rows.where(F.col("__key").isin([r[0] for r in few]))
        else:
            rows = rows.join(keys, F.col("__key") == F.col("__k"), "left_semi")
        # A name a file: no more than the commit and every plan's listing have.
        return sorted("data/" + "/".join(r[0].split("/")[-2:]) for r in rows.select("__file").distinct().collect())

    def rewritten(self, c: Collection, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[str]:
        """The collection's entries once the files that hold the keys have been rewritten by the change; others aren't read."""
        old, found = self.tables.get(c.name, []), self.holding(c, keys)
        if not found:
            return list(old)
        folders, gone, entries = {f.rsplit("/", 1)[0] for f in found}, set(found), []
        for e in old:
            entries += [f for f in self.store.files(e) if f not in gone] if e in folders or e in gone else [e]
        return [*entries, self.write(change(self.store.read_rows(self.schema, c.name, found)), c.name)]

    def commit(self) -> None:
        self._opened()
        self.open = False
        new = self.state()
        try:
            if self.changed or self.counters != self.base.counters or self.schema != self.base.schema:
                self.store.publish(new)
        except EngineError:
            self.store.delete(self.made)
            raise
        self.store.delete(set(self.made) - folders_of(new.tables))

    def abort(self) -> None:
        if self.open:
            self.open = False
            self.store.delete(self.made)

    def _opened(self) -> None:
        if not self.open:
            raise EngineError("CLOSED", "the transaction has ended")


class Database:
    def __init__(self, store: Store, schema: Schema):
        self.store, self.schema = store, schema

    @classmethod
    def open(cls, spark: SparkSession, root: str, schema: Schema | None = None, migrations: Iterable[Migration] = (), create: bool = True) -> Database:
        """Open a folder as a database, make it, or migrate it to a newer schema. Without a schema the stored one holds."""
        store = Store(spark, root)
        commit = store.latest()
        if commit is None:
            if schema is None or not create:
                raise EngineError("NOT_FOUND", f"there is no database in {root}")
            schema.validate()
            commit = Commit(1, schema)
            store.publish(commit)
        elif schema is not None:
            schema.validate()
            if schema.version < commit.schema.version:
                raise EngineError("SCHEMA_TOO_NEW", f"the database has schema version {commit.schema.version}, and {schema.version} is declared")
            if schema.version == commit.schema.version and not same_schema(schema, commit.schema):
                raise EngineError("SCHEMA_MISMATCH", f"the declared schema differs from the stored one, and both have version {schema.version}")
            if schema.version > commit.schema.version:
                migrate(WriteTransaction(store, commit), schema, tuple(migrations))
        return cls(store, store.latest().schema)

    def _latest(self) -> Commit:
        commit = self.store.latest()
        if not same_schema(commit.schema, self.schema):
            raise EngineError("SCHEMA_MISMATCH", "the database was migrated meanwhile; open it again")
        return commit

    def read(self) -> ReadTransaction:
        return ReadTransaction(self.store, self._latest())

    def begin(self) -> WriteTransaction:
        """A write transaction that the caller commits or aborts."""
        return WriteTransaction(self.store, self._latest())

    @contextmanager
    def write(self) -> Iterator[WriteTransaction]:
        """A write transaction that is committed at the end of the block, or aborted by an exception."""
        txn = self.begin()
        try:
            yield txn
        except BaseException:
            txn.abort()
            raise
        if txn.open:
            txn.commit()


def _object(row: object) -> dict:
    """A row as plain values, dates as Date."""
    import datetime as dt

    def plain(v: object) -> object:
        if isinstance(v, dt.datetime):
            return Date((v - EPOCH) // dt.timedelta(microseconds=1))
        if isinstance(v, (bytearray, memoryview)):
            return bytes(v)
        if isinstance(v, list):
            return [plain(x) for x in v]
        return {k: plain(x) for k, x in v.asDict().items()} if hasattr(v, "asDict") else v

    return plain(row)
