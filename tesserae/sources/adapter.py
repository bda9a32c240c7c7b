"""Plain Parquet tables as collections: integers and floats are widened, links and keys declared beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import invalid_argument
from ..model import Bool, Bytes, Collection, DateType, Embedded, Field, Float, Int, Link, List, Schema, String, Type, nullable, spark_type


def model_type(t: T.DataType) -> Type:
    """The model's type of a Spark type."""
    match t:
        case T.BooleanType():
            return Bool
        case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType():
            return Int
        case T.FloatType() | T.DoubleType():
            return Float
        case T.StringType():
            return String
        case T.BinaryType():
            return Bytes
        case T.TimestampNTZType() | T.TimestampType() | T.DateType():
            return DateType
        case T.ArrayType():
            return List(model_type(t.elementType))
        case T.StructType():
            return Embedded(*(Field(f.name, model_type(f.dataType), optional=True) for f in t.fields))
    raise invalid_argument(f"{t.simpleString()} has no type in the model")


def collection_of(name: str, struct: T.StructType, key: str | None = None, links: dict[str, str] | None = None, copies: dict[str, str] | None = None) -> Collection:
    """A collection for a table. links: target by column; copies: a further field by the column it copies, as `labels.doc` does."""
    fields = []
    for f in struct.fields:
        kind = model_type(f.dataType)
        if target := (links or {}).get(f.name):
            kind = List(Link(target)) if kind.kind == "list" else Link(target)
        fields.append(Field(f.name, kind, optional=f.name != key))
    fields += [Field(new, Link((links or {})[new]), optional=True) for new in (copies or {})]
    return Collection.of(name, *fields, key=key)


def conform(df: DataFrame, c: Collection, schema: Schema, copies: dict[str, str] | None = None) -> DataFrame:
    """The table with the collection's types. A collection without a key gets a surrogate `id` only where one is asked for."""
    for new, old in (copies or {}).items():
        df = df.withColumn(new, F.col(old))
    return df.select(*(F.col(f.name).cast(nullable(spark_type(f.type, schema))).alias(f.name) for f in c.all_fields if f.name in df.columns))


#: The links among the tables that the benchmarks use.
LINKS = {
    "region": ("r_regionkey", {}),
    "nation": ("n_nationkey", {"n_regionkey": "region"}),
    "customer": ("c_custkey", {"c_nationkey": "nation"}),
    "supplier": ("s_suppkey", {"s_nationkey": "nation"}),
    "part": ("p_partkey", {}),
    "orders": ("o_orderkey", {"o_custkey": "customer"}),
    "lineitem": (None, {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
    "events": ("event_id", {}),
    "documents": ("doc_id", {}),
    "labels": ("doc_id", {"doc": "documents"}),
    "embeddings": ("vec_id", {}),
    "pages": ("page_id", {}),
    "benchmark": ("item_id", {}),
    "conversations": (None, {}),
}
COPIES = {"labels": {"doc": "doc_id"}}


class Tables:
    """The tables of a directory as a schema and frames, for reading: files are neither copied nor changed."""

    def __init__(self, spark: SparkSession, directory: str, names: tuple[str, ...] = tuple(LINKS)):
        self.spark, self.directory = spark, directory
        self.raw = {n: spark.read.parquet(f"{directory}/{n}.parquet") for n in names}
        collections = []
        for n, df in self.raw.items():
            key, links = LINKS[n]
            collections.append(collection_of(n, df.schema, key, {c: t for c, t in links.items() if t in self.raw}, COPIES.get(n)))
        self.schema = Schema(1, tuple(collections))

    def frame(self, name: str) -> DataFrame:
        df = self.raw[name]
        c = self.schema.find(name)
        if c.auto:  # a surrogate key, unique within this run
            df = df.withColumn(c.key_name, F.monotonically_increasing_id())
        return conform(df, c, self.schema, COPIES.get(name))
