"""A training corpus from raw documents: each stage works on what its predecessor kept.

Every stage is written to the shared folder and read again, so a lost executor repeats at most one stage. SQL can't
express stages 1, 2, 3 and 5; tests/llm compare them with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import decontaminate, near, packing, suffix_dedup, toxicity
from tesserae.llm.common import discard, written


#: Repeated strings of so many bytes go, found by anchors of so many bytes.
REPEAT_BYTES, REPEAT_ANCHOR = 200, 64


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more for toxicity go."""
    return toxicity.keep_civil(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that a Jaccard similarity of 0.8 over five-word shingles links, the one with the least id stays.

    SimHash proposes pairs, and bands of minimum hashes those beyond its reach; sets are compared exactly.
    """
    return near.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur elsewhere are cut out: over 50 words are longer, but for the shortest words."""
    return suffix_dedup.remove_repeats(docs, REPEAT_BYTES, REPEAT_ANCHOR)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; a document that is half of such passages goes."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token sequences of 4096."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("suffix_dedup", cut_repeats), ("decontamination", cut_benchmark), ("packing", pack)]

#: SQL can't express most stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*before)
        before = [docs]
    return docs
