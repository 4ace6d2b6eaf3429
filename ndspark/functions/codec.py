"""Value transforms of the encodings. Bit packing is Parquet's."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quantise(x: Column, scale: float, offset: float = 0.0) -> Column:
    """rint((x + offset) scale), half to even."""
    return F.rint((x + F.lit(offset)) * F.lit(scale))


def scale_int16(x: Column, scale: float, offset: float = 0.0) -> Column:
    """16-bit integers; values outside their range are null, as they can't be stored."""
    q = quantise(x, scale, offset)
    return F.when(q.between(-32768, 32767), q).cast("smallint")


def unscale(q: Column, scale: float, offset: float = 0.0) -> Column:
    return q.cast("double") / F.lit(scale) - F.lit(offset)


def scale_wide(x: Column, scale: float, offset: float = 0.0) -> Column:
    """32-bit floats as integers: bigint."""
    return quantise(x, scale, offset).cast("bigint")


def scale_log_int16(x: Column, scale: float) -> Column:
    """log10(1 + x), then as scale_int16."""
    return scale_int16(F.log10(1 + x), scale)


def unscale_log(q: Column, scale: float) -> Column:
    return F.pow(F.lit(10.0), q.cast("double") / F.lit(scale)) - 1


def delta(q: Column, chunk: list[str], lane: list[str], order: str) -> Column:
    """Differences along `order` in each lane of each chunk; the first value stays."""
    w = Window.partitionBy(*chunk, *lane).orderBy(order)
    return q - F.coalesce(F.lag(q).over(w), F.lit(0))


def undelta(d: Column, chunk: list[str], lane: list[str], order: str) -> Column:
    w = Window.partitionBy(*chunk, *lane).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum(d).over(w)


def xor(bits: Column, chunk: list[str], lane: list[str], order: str) -> Column:
    """Exclusive or with the value before, in each lane of each chunk."""
    w = Window.partitionBy(*chunk, *lane).orderBy(order)
    return bits.bitwiseXOR(F.coalesce(F.lag(bits).over(w), F.lit(0)))


def unxor(bits: Column, chunk: list[str], lane: list[str], order: str) -> Column:
    w = Window.partitionBy(*chunk, *lane).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.bit_xor(bits).over(w)


@F.pandas_udf(T.LongType())
def double_bits(x: pd.Series) -> pd.Series:
    """The bits of doubles as integers; Spark has no function for that."""
    return pd.Series(x.to_numpy(np.float64).view(np.int64))


@F.pandas_udf(T.DoubleType())
def bits_double(x: pd.Series) -> pd.Series:
    return pd.Series(x.to_numpy(np.int64).view(np.float64))


@F.pandas_udf(T.IntegerType())
def float_bits(x: pd.Series) -> pd.Series:
    return pd.Series(x.to_numpy(np.float32).view(np.int32))


@F.pandas_udf(T.FloatType())
def bits_float(x: pd.Series) -> pd.Series:
    return pd.Series(x.to_numpy(np.int32).view(np.float32))
