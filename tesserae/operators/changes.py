"""Changes as DataFrames: new rows with keys and defaults, checks of keys and unique indexes, updates and cascades."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import EngineError, invalid_argument
from ..model import AUTO_KEY, MISSING, Collection, Field, Index, Schema, fits, links_to, nullable, spark_type, struct_type
from ..plans.compile import _within, quoted
from ..plans.resolve import resolve_path
from ..values import Date, EPOCH, INT_MAX, literal, normal

Stage = Callable[[DataFrame], DataFrame]


def complete(schema: Schema, owner: str, fields: Iterable[Field], given: dict) -> dict:
    """The object with every field: what was left out has its default or is null."""
    fields = list(fields)
    given = normal(given)
    if unknown := given.keys() - {f.name for f in fields}:
        raise invalid_argument(f"`{owner}` has no field `{sorted(unknown)[0]}`")
    return {f.name: checked(schema, f"{owner}.{f.name}", f, given.get(f.name)) for f in fields}


def checked(schema: Schema, where: str, f: Field, value: object) -> object:
    """A field's value as it is stored; null reads as the default, or is refused where the field is required."""
    if value is None:
        value = f.filled()
        if value is MISSING:
            raise invalid_argument(f"`{where}` is required")
        return normal(value)
    inner = f.type.item or f.type
    if inner.kind == "object":
        items = value if f.type.item else [value]
        if not isinstance(items, list) or not all(isinstance(x, dict) for x in items):
            raise invalid_argument(f"`{where}` holds {f.type}")
        made = [complete(schema, where, inner.fields, x) for x in items]
        return made if f.type.item else made[0]
    if inner.kind == "float":
        widen = lambda v: float(v) if isinstance(v, int) and not isinstance(v, bool) and abs(v) <= 1 << 53 else v
        value = [widen(v) for v in value] if isinstance(value, list) else widen(value)
    if not fits(value, f.type, schema):
        raise invalid_argument(f"`{where}` holds {f.type}, and {value!r} is not that")
    return value


def stored(value: object) -> object:
    """A model value as a value for a Spark row."""
    import datetime as dt

    if isinstance(value, Date):
        return EPOCH + dt.timedelta(microseconds=value.micros)
    if isinstance(value, list):
        return [stored(v) for v in value]
    if isinstance(value, dict):
        return {k: stored(v) for k, v in value.items()}
    return value


def rows_of(spark: SparkSession, schema: Schema, c: Collection, objects: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(stored(o[f.name]) for f in c.all_fields) for o in objects], struct_type(c, schema))


def with_defaults(df: DataFrame, schema: Schema, c: Collection) -> DataFrame:
    """A DataFrame of objects with every field, typed; null reads as the default. Required fields are checked by `missing`."""
    if unknown := set(df.columns) - {f.name for f in c.all_fields}:
        raise invalid_argument(f"`{c.name}` has no field `{sorted(unknown)[0]}`")
    return df.select(*(default_of(quoted(f.name) if f.name in df.columns else F.lit(None), schema, f).alias(f.name) for f in c.all_fields))


def default_of(value: Column, schema: Schema, f: Field) -> Column:
    kind = spark_type(f.type, schema)
    value = value.cast(nullable(kind))
    if not f.has_default or f.default is None:
        return value
    d = normal(f.default)
    return F.coalesce(value, (F.array(*map(literal, d)) if isinstance(d, list) else literal(d)).cast(nullable(kind)))


def missing(df: DataFrame, c: Collection) -> None:
    """INVALID_ARGUMENT if a required field is null somewhere."""
    required = [f.name for f in c.all_fields if f.filled() is MISSING]
    if required:
        found = df.agg(*(F.max(quoted(n).isNull()).alias(n) for n in required)).first()
        for n in required:
            if found[n]:
                raise invalid_argument(f"`{c.name}.{n}` is required")


def number_rows(df: DataFrame, stage: Stage, column: str, first: int) -> tuple[DataFrame, bool]:
    """The rows, those without a key numbered from first on in the order of the written rows (partitions, then rows); and whether none had one."""
    rows = stage(df.withColumn("__n", F.monotonically_increasing_id()))
    part, place = F.shiftright("__n", 33), F.col("__n").bitwiseAND((1 << 33) - 1)
    fresh = rows.where(quoted(column).isNull()).select("__n", part.alias("__p"))
    totals = fresh.groupBy("__p").agg(F.count("*").alias("__c"))
    # A row a partition: the prefix sum over all of them is small.
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("__p", (F.coalesce(F.sum("__c").over(before), F.lit(0)) + first).alias("__b"))
    if rows.where(quoted(column).isNotNull()).isEmpty():
        # A row's number in its partition is known: there is nothing to rank.
        out = rows.withColumn("__p", part).join(bases, "__p").withColumn("__id", F.col("__b") + place)
        return out.select(*(F.col("__id").cast("long").alias(c) if c == column else quoted(c) for c in df.columns)), True
    rank = F.row_number().over(Window.partitionBy("__p").orderBy("__n"))
    numbers = fresh.withColumn("__r", rank).join(bases, "__p").select("__n", (F.col("__b") + F.col("__r") - 1).cast("long").alias("__id"))
    out = rows.join(numbers, "__n", "left")
    return out.select(*(F.coalesce(quoted(c), F.col("__id")).alias(c) if c == column else quoted(c) for c in df.columns)), False


def next_number(df: DataFrame, counter: int) -> int:
    top = df.agg(F.max(AUTO_KEY)).first()[0]
    return counter if top is None else max(counter, min(top, INT_MAX - 1) + 1)


def repeated_key(new: DataFrame, key: str) -> None:
    found = new.groupBy(quoted(key).alias("k")).count().where("count > 1").limit(1).collect()
    if found:
        raise EngineError("DUPLICATE_KEY", f"the key {found[0].k!r} is given more than once")


def taken_key(old: DataFrame, new: DataFrame, key: str) -> None:
    found = new.select(quoted(key).alias("k")).join(old.select(quoted(key).alias("o")), F.col("k") == F.col("o"), "left_semi").limit(1).collect()
    if found:
        raise EngineError("DUPLICATE_KEY", f"the key {found[0].k!r} is taken")


def unique_values(df: DataFrame, schema: Schema, c: Collection, index: Index) -> DataFrame:
    """(k, v): the keys and the index's values where none of them is null; the distinct elements of a list one by one."""
    if len(index.paths) == 1:
        path = resolve_path(schema, c, tuple(index.paths[0].split(".")))
        value = _within(quoted, path.segments[0])
        value = F.explode(F.array_distinct(value)) if path.many else value
        return df.select(quoted(c.key_name).alias("k"), value.alias("v")).where("v is not null")
    values = [_within(quoted, resolve_path(schema, c, tuple(p.split("."))).segments[0]) for p in index.paths]
    there = values[0].isNotNull()
    for v in values[1:]:
        there = there & v.isNotNull()
    return df.where(there).select(quoted(c.key_name).alias("k"), F.struct(*(v.alias(f"f{n}") for n, v in enumerate(values))).alias("v"))


def check_unique(df: DataFrame, schema: Schema, c: Collection, changed: DataFrame | None = None) -> None:
    """DUPLICATE_KEY if a unique index has a value twice; only values of the changed rows are looked at, if they are given."""
    for index in c.indexes:
        if index.unique:
            values = unique_values(df, schema, c, index)
            if changed is not None:
                values = values.join(unique_values(changed, schema, c, index).select(F.col("v").alias("w")).distinct(), F.col("v") == F.col("w"), "left_semi")
            if values.groupBy("v").count().where("count > 1").limit(1).collect():
                raise EngineError("DUPLICATE_KEY", f"`{c.name}`: a value of the unique index on {', '.join(index.paths)} is taken")


def updated(df: DataFrame, schema: Schema, c: Collection, keys: DataFrame, changes: dict) -> DataFrame:
    """df with the changed fields of the rows whose keys (column __k, distinct) are given."""
    values = {}
    for name, value in normal(changes).items():
        f = c.find(name)
        if f is None:
            raise invalid_argument(f"`{c.name}` has no field `{name}`")
        if name == c.key_name:
            raise invalid_argument(f"`{name}` is the primary key, which does not change")
        values[name] = constant(schema, f, checked(schema, f"{c.name}.{name}", f, value))
    flagged = df.join(keys.withColumn("__hit", F.lit(True)), quoted(c.key_name) == F.col("__k"), "left")
    return flagged.select(*(F.when(F.col("__hit"), values[n]).otherwise(quoted(n)).alias(n) if n in values else quoted(n) for n in df.columns))


def constant(schema: Schema, f: Field, value: object) -> Column:
    """A literal of the field's type, lists and embedded objects included."""

    def made(v: object) -> Column:
        if isinstance(v, list):
            return F.array(*map(made, v))
        if isinstance(v, dict):
            return F.struct(*(made(x).alias(k) for k, x in v.items()))
        return F.lit(None) if v is None else literal(v)

    return made(value).cast(nullable(spark_type(f.type, schema)))


def cascade(schema: Schema, frame: Callable[[str], DataFrame], stage: Stage, name: str, keys: DataFrame) -> dict[str, DataFrame]:
    """The keys (column __k) that go with these, by collection: rounds over the cascading links until nothing new is found.

    Every round is written to the shared store, so lineage stays short and cycles end.
    """
    gone = {name: stage(keys)}
    fresh = dict(gone)
    while fresh:
        found: dict[str, DataFrame] = {}
        for target, new in fresh.items():
            for c, f in links_to(schema, target):
                rows = frame(c.name).join(new.withColumnRenamed("__k", "__t"), quoted(f.name) == F.col("__t"), "left_semi").select(quoted(c.key_name).alias("__k"))
                found[c.name] = found[c.name].union(rows) if c.name in found else rows
        fresh = {}
        for n, rows in found.items():
            rows = rows.distinct()
            if n in gone:
                rows = rows.join(gone[n], "__k", "left_anti")
            rows = stage(rows)
            if not rows.isEmpty():
                fresh[n] = rows
                gone[n] = gone[n].union(rows) if n in gone else rows
    return gone


def without(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    return df.join(keys, quoted(key) == F.col("__k"), "left_anti")
