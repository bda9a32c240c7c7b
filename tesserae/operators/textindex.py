"""A text index: the terms of a field as a table of (term, key), and searches that read it instead of the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import Words, terms
from ..model import Collection, Schema
from ..plans.compile import _within, quoted
from ..plans.resolve import resolve_path


def index_terms(df: DataFrame, schema: Schema, c: Collection, path: str) -> DataFrame:
    """(term, key), each once; a list's element is told apart by its place, as one string must hold every word."""
    found = resolve_path(schema, c, tuple(path.split(".")))
    value = _within(quoted, found.segments[0])
    texts = value if found.many else F.array(value)
    rows = df.select(quoted(c.key_name).alias("key"), F.posexplode(texts).alias("place", "text"))
    return rows.select("key", "place", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))


def search(index: DataFrame, words: str) -> DataFrame:
    """The distinct keys whose text has every word."""
    return places(index, Words.of(words), "term", "key", "place").select("key").distinct()


def places(index: DataFrame, asked: Words, term: str, *by: str) -> DataFrame:
    """The columns `by` of the texts that have every word: one pass over the matching terms, grouped by text."""
    wanted = [(w, True) for w in sorted(asked.exact)] + [(w, False) for w in sorted(asked.prefixes)]
    if not wanted:
        return index.select(*by).limit(0)
    met = [F.col(term) == w if exact else F.col(term).startswith(w) for w, exact in wanted]
    any_met = met[0]
    for m in met[1:]:
        any_met = any_met | m
    found = index.where(any_met).groupBy(*by).agg(*(F.bool_or(m).alias(f"w{k}") for k, m in enumerate(met)))
    for k in range(len(met)):
        found = found.where(f"w{k}")
    return found.select(*by)
