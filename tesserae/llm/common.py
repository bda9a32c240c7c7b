"""What the operators of this package share: the cluster's shared folder, written tables, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workspace import shared_dir

#: Bytes of an Arrow batch of documents that goes to Python; a single longer text is a batch of its own.
BATCH_BYTES = 4 << 20


def session(spark: SparkSession) -> SparkSession:
    """Bound the session's Arrow batches by size, as documents may be long, unless the session has a bound of its own.

    The setting has to hold when a caller runs what an operator returns, so it stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries that run in this block delete their shuffle files when they end."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to a table in the shared folder and read it back: lineage is cut, and a lost executor loses nothing.

    The shuffle files of the write go with its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `written` made and nothing needs any more."""
    for df in tables:
        spark = df.sparkSession
        if files := df.inputFiles():
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that gives the memory of its worker back at the end of a partition: workers are used again."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return wrapped


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def unused(df: DataFrame, name: str) -> str:
    """The name, longer if df has a column of it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def crc_mod(column: str, modulus: int) -> Column:
    """crc32(the id as text) mod modulus; the text of a null id is empty."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's texts as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node that can be reached.

    Alternating large-star and small-star rounds; each is written to the shared folder. Nodes are longs.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        before, edges = edges, written(small, name)
        discard(before)
        with tidy(edges.sparkSession):
            now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def roots_of(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The roots of the forest's nodes at."""
    while True:
        up = parent[at]
        if (up == at).all():
            return at
        at = up
