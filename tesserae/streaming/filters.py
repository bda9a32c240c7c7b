"""Beyond the reference: the filters of the query language on streams of one collection's objects."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..builder import tree_of
from ..errors import invalid_query
from ..model import Schema
from ..plans.compile import Plan
from ..plans.resolve import collection_of


def filtered(stream: DataFrame, schema: Schema, collection: str, query: object, *values: object) -> DataFrame:
    """The stream's objects that the query's filter holds for. A sort or a page has no meaning on a stream."""
    tree = tree_of(query, values)
    if tree.sort or tree.offset or tree.limit is not None:
        raise invalid_query("a stream is neither sorted nor cut")
    plan = Plan(schema, lambda name: stream, collection_of(schema, collection))
    plan.filter(tree.filter)
    return plan.rows()
