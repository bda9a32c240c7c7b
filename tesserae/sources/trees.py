"""Named, ordered trees of bytes, kept as one collection of a database."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..database import ReadTransaction, WriteTransaction
from ..model import Bytes, Collection, Field, String

#: The collection that a schema needs for trees. A row's key is the tree's name, a zero byte and the key.
TREES = Collection.of("__trees", Field("place", Bytes), Field("tree", String), Field("key", Bytes), Field("value", Bytes), key="place")


def place(tree: str, key: bytes) -> bytes:
    return tree.encode() + b"\0" + key


class Trees:
    def __init__(self, txn: ReadTransaction | WriteTransaction):
        self.rows = txn.collection(TREES.name)

    def get(self, tree: str, key: bytes) -> bytes | None:
        found = self.rows.get(place(tree, key))
        return found and found["value"]

    def insert(self, tree: str, key: bytes, value: bytes) -> None:
        """Set the key's value."""
        self.insert_many(tree, {key: value})

    def insert_many(self, tree: str, pairs: dict[bytes, bytes]) -> None:
        self.rows.put_many([{"place": place(tree, k), "tree": tree, "key": k, "value": v} for k, v in pairs.items()])

    def remove(self, tree: str, key: bytes) -> bool:
        return self.rows.delete(place(tree, key))

    def range(self, tree: str, low: bytes | None = None, high: bytes | None = None, backward: bool = False) -> DataFrame:
        """(key, value) with low <= key < high, in the order of keys."""
        df = self.rows.frame().where(F.col("tree") == tree)
        for bound, test in ((low, lambda v: F.col("key") >= v), (high, lambda v: F.col("key") < v)):
            if bound is not None:
                df = df.where(test(F.unhex(F.lit(bound.hex()))))
        return df.select("key", "value").orderBy(F.col("key").desc() if backward else F.col("key").asc())

    def len(self, tree: str) -> int:
        return self.rows.frame().where(F.col("tree") == tree).count()

    def names(self) -> list[str]:
        return sorted(r.tree for r in self.rows.frame().select("tree").distinct().collect())

    def delete_tree(self, tree: str) -> int:
        return self.rows.delete_where("tree == $0", tree)
