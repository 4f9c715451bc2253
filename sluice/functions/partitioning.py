"""Partition strategies as Column expressions, and the composite partition key.

Buckets are unsigned 32-bit numbers held as long. Everything stays in the JVM, so a strategy costs no Python and can be
pushed below other operators.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ColumnNotFound, MultipleColumnsFound, PartitionError

UINT32 = 1 << 32
MAX_UINT32 = UINT32 - 1

#: Fixed values of 32-bit FNV-1.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619

_INT_LIMITS = {T.ByteType: 1 << 7, T.ShortType: 1 << 15, T.IntegerType: 1 << 31, T.LongType: 1 << 63}


class Strategy(Protocol):
    """How a column becomes a bucket number."""

    kind: str

    def validate(self, dtype: T.DataType) -> None:
        """Raise PartitionError if the strategy cannot take a column of this type."""

    def bucket(self, column: Column) -> Column:
        """The bucket of each value, a long in [0, 2**32)."""


@dataclass(frozen=True)
class IntegerRange:
    """Ranges of ``width``: value divided by width toward zero, modulo 2**32."""

    width: int
    kind: str = "integer_range"

    def validate(self, dtype: T.DataType) -> None:
        limit = _INT_LIMITS.get(type(dtype))
        if limit is None:
            raise PartitionError(f"integer ranges need an integer column, not {dtype.simpleString()}")
        if not 0 < self.width < limit:
            raise PartitionError(f"width {self.width} is not within {dtype.simpleString()}")

    def bucket(self, column: Column) -> Column:
        return F.pmod(F.call_function("div", column.cast("long"), F.lit(self.width).cast("long")), F.lit(UINT32))


@dataclass(frozen=True)
class StringHash:
    """``count`` equal intervals of a 32-bit hash of the UTF-8 bytes."""

    count: int
    method: str = "fnv"
    kind: str = "string_hash"

    def validate(self, dtype: T.DataType) -> None:
        if not isinstance(dtype, T.StringType):
            raise PartitionError(f"string hashes need a string column, not {dtype.simpleString()}")
        if self.method != "fnv":
            raise PartitionError(f"unknown hash method {self.method!r}")
        if not 1 <= self.count <= MAX_UINT32:
            raise PartitionError(f"count {self.count} is not within 1 and {MAX_UINT32}")

    def bucket(self, column: Column) -> Column:
        return interval(fnv1(column), self.count)


class Failing:
    """A strategy that can never be used; it stands for an unknown method."""

    kind = "error"

    def validate(self, dtype: T.DataType) -> None:
        raise PartitionError("unknown partition method")

    def bucket(self, column: Column) -> Column:
        raise PartitionError("unknown partition method")


def fnv1(column: Column) -> Column:
    """32-bit FNV-1 of a string's UTF-8 bytes, as a long."""
    # as ISO-8859-1 every byte is one character, and its code the byte
    letters = F.split(F.decode(column.cast("binary"), "ISO-8859-1"), "")
    octets = F.when(F.octet_length(column) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(letters, lambda c: F.ascii(c).cast("long"))
    )
    return F.aggregate(
        octets, F.lit(FNV_OFFSET).cast("long"), lambda h, b: F.pmod(h * FNV_PRIME, F.lit(UINT32)).bitwiseXOR(b)
    )


def interval(value: Column, count: int) -> Column:
    """Which of ``count`` equal intervals of [0, 2**32 - 1] a value lies in."""
    step = MAX_UINT32 // count
    return F.least(F.call_function("div", value.cast("long"), F.lit(step).cast("long")), F.lit(count - 1).cast("long"))


def require_column(df: DataFrame, name: str) -> T.DataType:
    """The type of a column that must be there exactly once."""
    found = [f.dataType for f in df.schema.fields if f.name == name]
    if not found:
        raise ColumnNotFound(name)
    if len(found) > 1:
        raise MultipleColumnsFound(name)
    return found[0]


def partition_columns(df: DataFrame, parts: Sequence[tuple[str, Strategy]]) -> list[Column]:
    """One bucket column for each partition column, in the order declared."""
    out = []
    for name, strategy in parts:
        strategy.validate(require_column(df, name))
        out.append(strategy.bucket(F.col(f"`{name}`")))
    return out


def partition_key(df: DataFrame, parts: Sequence[tuple[str, Strategy]]) -> Column:
    """The buckets joined by ``-``."""
    if not parts:
        raise PartitionError("a table needs a partition column")
    return F.concat_ws("-", *[c.cast("string") for c in partition_columns(df, parts)])
