"""Counts and the scalar aggregates of one field, after the query's sort, offset and limit."""

from __future__ import annotations


from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import invalid_argument, invalid_query
from ..functions.exact import divided, exact_total
from ..model import Collection, Schema
from ..plans import ir
from ..plans.compile import Frames, Plan
from ..plans.resolve import aggregated, resolve_path
from ..values import Date, INT_MAX, INT_MIN

FUNCTIONS = {"sum": 1, "min": 2, "max": 3, "avg": 4}


def count(schema: Schema, frames: Frames, collection: Collection, q: ir.Query, base: DataFrame | None = None) -> int:
    """The number of objects found: rows are counted without their columns, and the page is arithmetic."""
    plan = Plan(schema, frames, collection, base=base)
    plan.filter(q.filter)
    Plan(schema, frames, collection).ordered(q)  # refuses a sort that can't be
    n = max(0, plan.df.count() - q.offset)
    return n if q.limit is None else min(n, q.limit)


def aggregate(schema: Schema, frames: Frames, collection: Collection, function: str, path: tuple[str, ...] | str, q: ir.Query, base: DataFrame | None = None) -> object:
    """sum, min, max or avg of a field: sums are exact and rounded once; of no values a sum is 0 and the rest null."""
    if function not in FUNCTIONS:
        raise invalid_query(f"`{function}` is no aggregate")
    found = aggregated(resolve_path(schema, collection, ir.path_of(path)), function)
    plan = Plan(schema, frames, collection, base=base)
    plan.filter(q.filter)
    value = plan.single(found)
    plan.paged(q, order=False)
    values = plan.df.select(value.alias("v")).where("v is not null")
    kind = found.leaf.kind
    try:
        if function in ("min", "max"):
            v = F.col("v") + F.lit(0.0) if kind == "float" else F.col("v")
            out = values.agg((F.min if function == "min" else F.max)(v)).first()[0]
            return Date.of(out) if kind == "date" and out is not None else bytes(out) if kind == "bytes" and out is not None else out
        if kind == "int":
            total, n = values.agg(F.sum(F.col("v").cast("decimal(20,0)")), F.count("*")).first()
            return _of_ints(function, int(total or 0), n)
        total = exact_total(values)
        if function == "sum":
            return total.over(1) if total.n else 0.0
        return total.over(total.n) if total.n else None
    except (PySparkException, Py4JJavaError) as e:
        raise invalid_argument(str(e).splitlines()[0]) from e


def _of_ints(function: str, total: int, n: int) -> int | float | None:
    if function == "avg":
        return divided(total, n) if n else None
    if not INT_MIN <= total <= INT_MAX:
        raise invalid_argument("the sum does not fit in 64 bits")
    return total


