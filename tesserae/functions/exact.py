"""Sums and means that are exact until they are rounded once."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Every finite double is a whole number of these: 2 ** -1074.
UNIT = 1074
SCHEMA = "total binary, n long, nans long, plus long, minus long"


@dataclass
class Exact:
    """An exact total: a whole number of units, and what isn't finite."""

    total: int = 0
    n: int = 0
    nans: int = 0
    plus: int = 0
    minus: int = 0

    def add(self, values: np.ndarray) -> None:
        """Add doubles. Mantissas are summed per exponent in two halves, as whole numbers that doubles hold exactly."""
        for k in range(0, len(values), 1 << 20):
            self._add(values[k : k + (1 << 20)])

    def _add(self, values: np.ndarray) -> None:
        self.n += len(values)
        finite = np.isfinite(values)
        if not finite.all():
            self.nans += int(np.isnan(values).sum())
            self.plus += int((values == np.inf).sum())
            self.minus += int((values == -np.inf).sum())
            values = values[finite]
        mantissa, exponent = np.frexp(values)
        whole = np.ldexp(mantissa, 53).astype(np.int64)
        place = exponent.astype(np.int64) - 53 + UNIT  # below zero only for subnormals, whose low bits are zero
        small = place < 0
        whole[small] >>= -place[small]
        place[small] = 0
        low, high = np.bincount(place, (whole & 0xFFFFFFFF).astype(float)), np.bincount(place, (whole >> 32).astype(float))
        for k in np.flatnonzero((low != 0) | (high != 0)).tolist():
            self.total += (int(low[k]) + (int(high[k]) << 32)) << k

    def merge(self, other: Exact) -> None:
        self.total += other.total
        self.n += other.n
        self.nans += other.nans
        self.plus += other.plus
        self.minus += other.minus

    def over(self, n: int) -> float:
        """The total divided by n, rounded once; never -0.0."""
        if self.nans or self.plus and self.minus:
            return math.nan
        if self.plus or self.minus:
            return math.inf if self.plus else -math.inf
        return divided(self.total, n << UNIT)

    def row(self) -> pa.RecordBatch:
        size = self.total.bit_length() // 8 + 1
        return pa.RecordBatch.from_arrays([pa.array([self.total.to_bytes(size, "little", signed=True)]), *(pa.array([x], pa.int64()) for x in (self.n, self.nans, self.plus, self.minus))], ["total", "n", "nans", "plus", "minus"])

    @classmethod
    def of_row(cls, total: bytes, n: int, nans: int, plus: int, minus: int) -> Exact:
        return cls(int.from_bytes(total, "little", signed=True), n, nans, plus, minus)


def divided(a: int, b: int) -> float:
    """a / b, rounded once, infinite beyond the doubles."""
    try:
        return a / b
    except OverflowError:
        return math.inf if a > 0 else -math.inf


def exact_total(values: DataFrame) -> Exact:
    """The exact total of a column of doubles without nulls: a row from each partition, combined in a second small stage."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Exact()
        for batch in batches:
            out.add(batch.column(0).to_numpy(zero_copy_only=False))
        yield out.row()

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Exact()
        for batch in batches:
            for row in batch.to_pylist():
                out.merge(Exact.of_row(**row))
        yield out.row()

    out = Exact()
    for row in values.mapInArrow(fold, SCHEMA).repartition(16).mapInArrow(combine, SCHEMA).collect():
        out.merge(Exact.of_row(bytes(row.total), row.n, row.nans, row.plus, row.minus))
    return out
