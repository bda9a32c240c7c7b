"""Labelled rows: all that may be learned from, or a bounded sample, the same for every partitioning of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod


def known(labels: DataFrame, label: str, modulus: int, held_out: int) -> DataFrame:
    """doc_id and label (0 or 1) of all ids whose crc32 mod modulus isn't held_out; of repeated labels the greatest counts."""
    found = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", modulus) != held_out))
    return found.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, most: int) -> DataFrame:
    """doc_id, text and label (0 or 1) of at most `most` labelled rows whose crc32(doc_id) mod modulus isn't held_out.

    The rows with the least hashes of doc_id are taken, evenly over both labels; of repeated labels the greatest counts.
    """
    found = known(labels, label, modulus, held_out)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = found.where("label = 1").orderBy(*order).limit(most // 2).union(found.where("label = 0").orderBy(*order).limit(most // 2))
    # At most `most` ids: the bound is this function's parameter.
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
