"""Tools for a whole database: check, backup, compact and salvage."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import PySparkException
from py4j.protocol import Py4JJavaError

from .database import Database, ReadTransaction
from .errors import EngineError, invalid_argument
from .model import AUTO_KEY, MISSING, Collection, Schema
from .operators.changes import unique_values
from .operators.indexes import build
from .plans.compile import quoted
from .sources.snapshot import Commit, Store


@dataclass(frozen=True)
class Problem:
    collection: str
    kind: str  # unreadable, null_key, repeated_key, missing_value, repeated_value, counter
    where: str
    count: int


def check(db: Database, dangling: bool = False) -> list[Problem]:
    """Every problem of the newest commit. Links to nothing are allowed; they are counted if asked for."""
    txn, out = db.read(), []
    for c in txn.schema.collections:
        try:
            out += _problems(txn, c)
            if dangling:
                out += _dangling(txn, c)
        except (PySparkException, Py4JJavaError) as e:
            out.append(Problem(c.name, "unreadable", str(e).splitlines()[0][:200], 1))
    return out


def _problems(txn: ReadTransaction, c: Collection) -> list[Problem]:
    df, key = txn.frame(c.name), quoted(c.key_name)
    required = [f.name for f in c.all_fields if f.filled() is MISSING and f.name != c.key_name]
    row = df.agg(F.count_if(key.isNull()), *(F.count_if(quoted(n).isNull()) for n in required), *([F.max(key)] if c.auto else [])).first()
    out = [Problem(c.name, "null_key", c.key_name, row[0])] if row[0] else []
    out += [Problem(c.name, "missing_value", n, k) for n, k in zip(required, row[1:]) if k]
    if c.auto and row[-1] is not None and row[-1] >= txn.commit.counters.get(c.name, 1):
        out.append(Problem(c.name, "counter", c.key_name, 1))
    if n := df.where(key.isNotNull()).groupBy(key.alias("k")).count().where("count > 1").count():
        out.append(Problem(c.name, "repeated_key", c.key_name, n))
    for index in c.indexes:
        if index.unique and (n := unique_values(df, txn.schema, c, index).groupBy("v").count().where("count > 1").count()):
            out.append(Problem(c.name, "repeated_value", ", ".join(index.paths), n))
    return out


def _dangling(txn: ReadTransaction, c: Collection) -> list[Problem]:
    out = []
    for f in c.fields:
        inner = f.type.item or f.type
        if inner.kind == "link":
            target = txn.schema.find(inner.target)
            value = F.explode(quoted(f.name)) if f.type.item else quoted(f.name)
            links = txn.frame(c.name).select(value.alias("l")).where("l is not null")
            keys = txn.frame(inner.target).select(quoted(target.key_name).alias("k"))
            if n := links.join(keys, F.col("l") == F.col("k"), "left_anti").count():
                out.append(Problem(c.name, "dangling", f.name, n))
    return out


def _copied(source: Store, commit: Commit, target: Store, read) -> Commit:
    """The commit's rows written anew: one sorted folder per collection."""
    tables = {}
    for c in commit.schema.collections:
        if commit.tables.get(c.name):
            df: DataFrame = read(c.name)
            tables[c.name] = (target.write(df.repartitionByRange(quoted(c.key_name)).sortWithinPartitions(quoted(c.key_name)), c.name),)
    return replace(commit, tables=tables, indexes={})


def backup(db: Database, path: str) -> None:
    """Copy the newest commit to a new database; a path where anything is is refused."""
    target = Store(db.store.spark, path)
    if target.exists():
        raise invalid_argument(f"there is something at {path} already")
    txn = db.read()
    target.publish(replace(_copied(db.store, txn.commit, target, txn.frame), number=1))


def compact(db: Database) -> int:
    """Rewrite every collection as one folder in key order, and drop what older commits used; the number of folders dropped.

    Stored indexes are built anew, if there were any. Readers of older commits must be done, as their files go.
    """
    txn = db.read()
    new = replace(_copied(db.store, txn.commit, db.store, txn.frame), number=txn.commit.number + 1)
    if txn.commit.indexes:
        new = replace(new, indexes=build(db.store, new))
    db.store.publish(new)
    return db.store.drop_unused(new)


def index(db: Database) -> None:
    """Store the declared indexes of one field for all rows there are; what is written later is read until this is run again."""
    commit = db.read().commit
    db.store.publish(replace(commit, number=commit.number + 1, indexes=build(db.store, commit)))


def salvage(spark: SparkSession, root: str, path: str, schema: Schema | None = None) -> dict[str, int]:
    """Copy what can still be read to a new database; the number of rows by collection.

    The newest commit that can be read is taken. Unreadable files are skipped, and so are rows without a key and further
    rows with a key.
    """
    source, target = Store(spark, root), Store(spark, path)
    if target.exists():
        raise invalid_argument(f"there is something at {path} already")
    commit = None
    for name in reversed([n for n in source.listed("commits") if n.endswith(".json") and not n.startswith(".")]):
        try:
            commit = Commit.from_json(source.read("commits", name))
            break
        except (EngineError, Py4JJavaError, UnicodeDecodeError):
            continue
    if commit is None:
        raise EngineError("CORRUPTED", f"no commit of {root} can be read")
    commit = replace(commit, schema=schema or commit.schema)
    keys = ("spark.sql.files.ignoreCorruptFiles", "spark.sql.files.ignoreMissingFiles")
    before = {k: spark.conf.get(k) for k in keys}
    found = {}
    try:
        for k in keys:
            spark.conf.set(k, "true")

        def read(name: str) -> DataFrame:
            c = commit.schema.find(name)
            there = tuple(f for f in commit.tables[name] if source.exists(f))
            df = source.frame(replace(commit, tables={name: there}), name)
            return df.where(quoted(c.key_name).isNotNull()).dropDuplicates([c.key_name])

        made = _copied(source, commit, target, read)
        counters = dict(made.counters)
        for c in made.schema.collections:
            df = target.frame(made, c.name)
            found[c.name] = df.count()
            if c.auto and found[c.name]:
                counters[c.name] = max(counters.get(c.name, 1), df.agg(F.max(AUTO_KEY)).first()[0] + 1)
        target.publish(replace(made, number=1, counters=counters))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return found
