"""Values of the data model as Python values, and dates as microseconds since 1970 without a zone."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import invalid_query

EPOCH = dt.datetime(1970, 1, 1)
INT_MIN, INT_MAX = -(1 << 63), (1 << 63) - 1
EXACT_INT = 1 << 53
#: Microseconds of the 400 years after which the calendar repeats.
CYCLE = 146_097 * 86_400_000_000


@dataclass(frozen=True, order=True)
class Date:
    """A date: microseconds since the epoch, in UTC."""

    micros: int

    @classmethod
    def of(cls, value: dt.date) -> Date:
        """A date, a date and time (naive: UTC)."""
        if not isinstance(value, dt.datetime):
            value = dt.datetime(value.year, value.month, value.day)
        if value.tzinfo:
            value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
        return cls((value - EPOCH) // dt.timedelta(microseconds=1))

    def column(self) -> Column:
        try:
            return F.lit(EPOCH + dt.timedelta(microseconds=self.micros)).cast("timestamp_ntz")
        except OverflowError:
            pass
        try:  # a year before 1 or after 9999: the same day of the calendar's next or last cycle, and the year by hand
            shift = 1 if self.micros < 0 else -1
            near = EPOCH + dt.timedelta(microseconds=self.micros + shift * CYCLE)
        except OverflowError as e:
            raise invalid_query(f"the date {self.micros} lies outside the years 0 to 9999") from e
        return F.lit(f"{near.year - 400 * shift:04d}{near.strftime('-%m-%d %H:%M:%S.%f')}").cast("timestamp_ntz")


DATE_TEXT = re.compile(r"(\d{4})-(\d\d)-(\d\d)(?:[Tt](\d\d):(\d\d):(\d\d)(?:\.(\d{1,6}))?(?:([Zz])|([+-])(\d\d):(\d\d)))?", re.ASCII)


def parse_date(text: str) -> Date:
    """RFC 3339 text, or a date alone, which is its midnight in UTC; ValueError for anything else."""
    found = DATE_TEXT.fullmatch(text)
    if not found:
        raise ValueError(f"`{text}` is not a date")
    year, month, day, hour, minute, second = (int(x or 0) for x in found.groups()[:6])
    near = year + 400 if year < 400 else year  # the calendar repeats; Python has no year 0
    moment = dt.datetime(near, month, day, hour, minute, second, int((found[7] or "").ljust(6, "0")))
    offset = 0
    if found[9]:
        h, m = int(found[10]), int(found[11])
        if h > 23 or m > 59:
            raise ValueError(f"`{text}` has no such offset")
        offset = (1 if found[9] == "+" else -1) * (h * 60 + m)
    micros = (moment - EPOCH) // dt.timedelta(microseconds=1) - (near - year) // 400 * CYCLE - offset * 60_000_000
    return Date(micros)


def normal(value: object) -> object:
    """The value as the model has it: dates as Date, byte strings as bytes, sequences as lists."""
    if isinstance(value, (dt.date, dt.datetime)):
        return Date.of(value)
    if isinstance(value, (bytearray, memoryview)):
        return bytes(value)
    if isinstance(value, (list, tuple, set, frozenset)):
        return [normal(v) for v in value]
    if isinstance(value, dict):
        return {k: normal(v) for k, v in value.items()}
    return value


def kind_of(value: object) -> str:
    """The type a value has by itself."""
    if value is None:
        return "null"
    for kind, types in (("bool", bool), ("int", int), ("float", float), ("string", str), ("bytes", bytes), ("date", Date), ("list", list), ("object", dict)):
        if isinstance(value, types):
            return kind
    return type(value).__name__


def literal(value: object) -> Column:
    """A Spark literal of the model's type."""
    match kind_of(value):
        case "date":
            return value.column()
        case "int":
            return F.lit(value).cast("long")
        case "float":
            return F.lit(value).cast("double")
        case "bytes":
            return F.unhex(F.lit(value.hex()))
        case _:
            return F.lit(value)


def shown(value: object) -> str:
    return f"`{value!r}`" if kind_of(value) != "string" else f'"{value}"'
