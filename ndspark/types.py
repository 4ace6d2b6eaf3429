"""Types, ranges and errors of the array model."""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum

from pyspark.sql import types as T


class DataType(IntEnum):
    """Codes of element and scalar types. Fixed values."""

    NONE = 0
    INT8 = 1
    UINT8 = 2
    INT16 = 3
    UINT16 = 4
    INT32 = 5
    UINT32 = 6
    INT64 = 7
    UINT64 = 8
    FLOAT = 9
    DOUBLE = 10
    STRING = 11
    INT8_ARRAY = 12
    UINT8_ARRAY = 13
    INT16_ARRAY = 14
    UINT16_ARRAY = 15
    INT32_ARRAY = 16
    UINT32_ARRAY = 17
    INT64_ARRAY = 18
    UINT64_ARRAY = 19
    FLOAT_ARRAY = 20
    DOUBLE_ARRAY = 21
    STRING_ARRAY = 22

    @property
    def is_array(self) -> bool:
        return self >= DataType.INT8_ARRAY

    @property
    def scalar(self) -> DataType:
        """The element's type."""
        return DataType(self - 11) if self.is_array else self

    @property
    def array(self) -> DataType:
        return self if self.is_array else DataType(self + 11)

    @property
    def spark(self) -> T.DataType:
        """The narrowest Spark type that holds every value: unsigned types take the next wider one."""
        return SPARK[self.scalar]

    @property
    def readable(self) -> bool:
        """Arrays of strings can be declared but not read."""
        return self.is_array and self != DataType.STRING_ARRAY


SPARK = {
    DataType.NONE: T.NullType(),
    DataType.INT8: T.ByteType(),
    DataType.UINT8: T.ShortType(),
    DataType.INT16: T.ShortType(),
    DataType.UINT16: T.IntegerType(),
    DataType.INT32: T.IntegerType(),
    DataType.UINT32: T.LongType(),
    DataType.INT64: T.LongType(),
    DataType.UINT64: T.DecimalType(20, 0),
    DataType.FLOAT: T.FloatType(),
    DataType.DOUBLE: T.DoubleType(),
    DataType.STRING: T.StringType(),
}


class Compression(IntEnum):
    """Codes of encodings. Fixed values."""

    PFOR_DELTA_2D_INT16 = 0
    FPX_XOR_2D = 1
    PFOR_DELTA_2D = 2
    PFOR_DELTA_2D_INT16_LOGARITHMIC = 3
    NONE = 4


class StoreError(ValueError):
    """A store, node or request that can't be read."""


@dataclass(frozen=True)
class Range:
    """Half-open range of a dimension, from zero."""

    start: int
    end: int

    @property
    def count(self) -> int:
        return self.end - self.start


def as_ranges(ranges) -> list[Range]:
    """Ranges from Range objects, slices without a step, or pairs."""
    out = []
    for r in ranges:
        if isinstance(r, slice):
            if r.step not in (None, 1) or r.start is None or r.stop is None:
                raise StoreError("a slice needs both ends and no step")
            r = Range(r.start, r.stop)
        out.append(r if isinstance(r, Range) else Range(*r))
    return out


def check_ranges(ranges: list[Range], dims: list[int]) -> None:
    """Rank first, then bounds: each range must be non-empty and inside its dimension."""
    if len(ranges) != len(dims):
        raise StoreError(f"{len(ranges)} ranges were given for an array of rank {len(dims)}")
    for i, (r, n) in enumerate(zip(ranges, dims)):
        if not 0 <= r.start < r.end <= n:
            raise StoreError(f"[{r.start}, {r.end}) is empty or outside of dimension {i}, which has {n} places")
