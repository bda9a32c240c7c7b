"""Asynchronous twins of databases, transactions and collections: the same calls, awaited.

Every call runs in a thread, where it waits for Spark, so an event loop goes on meanwhile. Results are the same; a
DataFrame's own actions are awaited with `rows`. A write transaction belongs to one task, as its changes follow each other.

    db = await AsyncDatabase.open(spark, root, schema)
    async with db.write() as txn:
        await txn.collection("users").insert({"name": "Ada"})
    users = (await db.read()).collection("users")
    found = await rows(await users.find('name == "Ada"'))
"""

from __future__ import annotations

import asyncio
from collections.abc import AsyncIterator, Callable, Iterable
from contextlib import asynccontextmanager

from pyspark.sql import DataFrame, Row, SparkSession

from .database import Database, Reader, ReadTransaction, WriteTransaction
from .migrate import Migration
from .model import Schema


async def rows(df: DataFrame) -> list[Row]:
    return await asyncio.to_thread(df.collect)


class AsyncCollection:
    """Every method of a collection (of a write transaction, also those that change it), awaited; `length` is its len."""

    def __init__(self, inner: Reader):
        self._inner = inner

    def __getattr__(self, name: str) -> Callable:
        method = getattr(self._inner, name)
        if not callable(method):
            return method

        async def call(*values: object, **named: object) -> object:
            return await asyncio.to_thread(method, *values, **named)

        return call

    async def length(self) -> int:
        return await asyncio.to_thread(len, self._inner)

    async def iter(self) -> AsyncIterator[dict]:
        """Every object in key order, a partition at a time."""
        found, end = await asyncio.to_thread(self._inner.iter), object()
        while (obj := await asyncio.to_thread(next, found, end)) is not end:
            yield obj


class AsyncTransaction:
    def __init__(self, inner: ReadTransaction | WriteTransaction):
        self._inner = inner

    def collection(self, name: str) -> AsyncCollection:
        return AsyncCollection(self._inner.collection(name))

    def frame(self, name: str) -> DataFrame:
        return self._inner.frame(name)

    async def commit(self) -> None:
        await asyncio.to_thread(self._inner.commit)

    async def abort(self) -> None:
        await asyncio.to_thread(self._inner.abort)


class AsyncDatabase:
    def __init__(self, inner: Database):
        self._inner = inner

    @classmethod
    async def open(cls, spark: SparkSession, root: str, schema: Schema | None = None, migrations: Iterable[Migration] = (), create: bool = True) -> AsyncDatabase:
        return cls(await asyncio.to_thread(Database.open, spark, root, schema, migrations, create))

    async def read(self) -> AsyncTransaction:
        return AsyncTransaction(await asyncio.to_thread(self._inner.read))

    @asynccontextmanager
    async def write(self) -> AsyncIterator[AsyncTransaction]:
        """A write transaction that is committed at the end of the block, or aborted by an exception."""
        txn = await asyncio.to_thread(self._inner.begin)
        try:
            yield AsyncTransaction(txn)
        except BaseException:
            await asyncio.to_thread(txn.abort)
            raise
        if txn.open:
            await asyncio.to_thread(txn.commit)
