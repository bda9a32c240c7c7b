"""Stored indexes: which files hold a value, or a term, of an indexed field.

`build` writes, for each declared index of one field, a table (v, key, place, file) in the order of v: the field's values, or
the terms of its texts. Files never change, so an index stays right for the folders it covers; folders that came later
are simply read. `narrowed` looks a query's conjuncts up in the index, where only row groups with the asked values are
read, and gives the rows of the files that hold them and of the folders that no index covers. The query's own filter is
applied to these rows as ever, so an index changes what is read and never what is found.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import Words, terms
from ..model import Collection, Schema
from ..plans import ir
from ..plans.compile import _within, condition, quoted
from ..plans.resolve import check_test, resolve_path
from ..sources.snapshot import Commit, Store, folder_of
from .textindex import places


def entries_of(df: DataFrame, schema: Schema, c: Collection, path: str, text: bool) -> DataFrame:
    """(v, key, place, file): a row per value or term of an object; the terms of one string share a place."""
    found = resolve_path(schema, c, tuple(path.split(".")))
    value = _within(quoted, found.segments[0])
    file = F.regexp_extract("_metadata.file_path", "([^/]+/[^/]+)$", 1).alias("file")
    rows = df.select(quoted(c.key_name).alias("key"), file, F.posexplode(value if found.many else F.array(value)).alias("place", "v"))
    if text:
        return rows.select("key", "file", "place", F.explode(F.array_distinct(terms(F.col("v")))).alias("v"))
    return rows.where("v is not null").select("key", "file", F.lit(0).alias("place"), "v").distinct()


def build(store: Store, commit: Commit) -> dict[str, dict[str, dict]]:
    """The indexes of a commit's rows, by collection and path: kind, folder and the folders that are covered."""
    out: dict[str, dict[str, dict]] = {}
    for c in commit.schema.collections:
        for index in c.indexes:
            if len(index.paths) == 1 and commit.tables.get(c.name):
                rows = entries_of(store.frame(commit, c.name), commit.schema, c, index.paths[0], index.text)
                folder = store.write(rows.repartitionByRange("v").sortWithinPartitions("v"), "index")
                covers = sorted({folder_of(e) for e in commit.tables[c.name]})
                out.setdefault(c.name, {})[index.paths[0]] = {"text": index.text, "folder": folder, "covers": covers}
    return out


def _conjuncts(e: ir.Expr | None) -> Iterable[ir.Test]:
    return (t for t in (e.items if isinstance(e, ir.And) else (e,)) if isinstance(t, ir.Test) and t.op != "IS NULL" and not any(isinstance(v, ir.Param) for v in t.values))


def narrowed(store: Store, commit: Commit, c: Collection, e: ir.Expr | None) -> DataFrame | None:
    """The rows among which the filter's objects are, or None where no index helps."""
    entries = before = list(commit.tables.get(c.name, ()))
    for t in _conjuncts(e):
        index = commit.indexes.get(c.name, {}).get(".".join(t.path))
        if index is None or index["text"] != (t.op == "MATCHES") or not {*map(folder_of, entries)} & {*index["covers"]}:
            continue
        path = resolve_path(commit.schema, c, t.path)
        t = check_test(commit.schema, path, t)
        rows = store.spark.read.parquet(f"{store.root}/{index['folder']}")
        hits = places(rows, Words.of(t.values[0]), "v", "key", "place", "file") if index["text"] else rows.where(condition(F.col("v"), t, path))
        # Names of files: no more than the commit and every plan's listing have.
        files = {f"data/{r.file}" for r in hits.select("file").distinct().collect()}
        covers = {*index["covers"]}
        entries = [f for e in entries for f in ([x for x in store.files(e) if x in files] if folder_of(e) in covers else [e])]
    return None if entries is before else store.read_rows(commit.schema, c.name, entries)
