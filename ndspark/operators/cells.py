"""Reading hyper-rectangles: chunk predicates, exploding what is asked for, flat row-major results.

Every plan in cells form is narrow: no exchange, whatever the size of the array.
"""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import Range, StoreError, check_ranges


def long(x: int) -> Column:
    return F.lit(x).cast("bigint")


def read_cells(chunks: DataFrame, dims: list[int], chunk_dims: list[int], ranges: list[Range], values: str = "values") -> DataFrame:
    """Cells i0..ik, v of the ranges.

    chunks has c0..ck (chunk coordinates) and a row-major array of the chunk's cells; edge chunks are
    as large as what is left of the array. Chunks outside the ranges are pruned by predicates on
    c0..ck, which reach the scan. Within a chunk only the asked rows are generated and of each only the
    asked run is sliced out, so a narrow slice of a wide chunk costs what it returns.
    """
    check_ranges(ranges, dims)
    k = len(dims)
    touched = F.lit(True)
    for d, (r, h) in enumerate(zip(ranges, chunk_dims)):
        touched &= F.col(f"c{d}").between(long(r.start // h), long((r.end - 1) // h))
    df = chunks.where(touched)
    origin = [F.col(f"c{d}") * long(h) for d, h in enumerate(chunk_dims)]
    shape = [F.least(long(h), long(n) - o) for h, n, o in zip(chunk_dims, dims, origin)]
    low = [F.greatest(long(r.start) - o, long(0)) for r, o in zip(ranges, origin)]
    high = [F.least(long(r.end) - o, s) for r, o, s in zip(ranges, origin, shape)]
    keep = [f"c{d}" for d in range(k)] + [values]
    for d in range(k - 1):
        df = df.select(*keep, F.explode(F.sequence(low[d], high[d] - 1)).alias(f"l{d}"))
        keep.append(f"l{d}")
    base = long(0)
    for d in range(k - 1):
        base = (base + F.col(f"l{d}")) * shape[d + 1]
    run = F.slice(values, (base + low[-1] + 1).cast("int"), (high[-1] - low[-1]).cast("int"))
    df = df.select(*keep, low[-1].alias("first"), F.posexplode(run).alias("p", "v"))
    at = [origin[d] + F.col(f"l{d}") for d in range(k - 1)] + [origin[-1] + F.col("first") + F.col("p")]
    return df.select(*[a.cast("bigint").alias(f"i{d}") for d, a in enumerate(at)], "v")


def linear(ranges: list[Range]) -> Column:
    """Row-major position of a cell within the ranges."""
    out = long(0)
    for d, r in enumerate(ranges):
        out = out * long(r.count) + (F.col(f"i{d}") - long(r.start))
    return out


def flat(cells: DataFrame, ranges: list[Range]) -> DataFrame:
    """One row: the values as a row-major array. It is a single value, so it must fit into one row."""
    if prod(r.count for r in ranges) >= 2**31:
        raise StoreError("a flat result holds fewer than 2^31 values; read cells instead")
    pair = F.struct(linear(ranges).alias("lin"), F.col("v").alias("v"))
    return cells.select(F.transform(F.sort_array(F.collect_list(pair)), lambda x: x["v"]).alias("values"))


def to_chunks(cells: DataFrame, dims: list[int], chunk_dims: list[int]) -> DataFrame:
    """Chunks c0..ck, values from cells i0..ik, v. One shuffle, by chunk; a chunk is bounded by its shape."""
    k = len(dims)
    c = [F.expr(f"i{d} div {h}").cast("bigint") for d, h in enumerate(chunk_dims)]
    df = cells.select(*[x.alias(f"c{d}") for d, x in enumerate(c)], *[f"i{d}" for d in range(k)], "v")
    at = long(0)
    for d, (h, n) in enumerate(zip(chunk_dims, dims)):
        shape = F.least(long(h), long(n) - F.col(f"c{d}") * long(h))
        at = at * shape + (F.col(f"i{d}") - F.col(f"c{d}") * long(h))
    pair = F.struct(at.alias("at"), F.col("v").alias("v"))
    keys = [f"c{d}" for d in range(k)]
    return df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(pair)), lambda x: x["v"]).alias("values"))


def rows_as_chunks(df: DataFrame, key: str, values: str | Column) -> DataFrame:
    """A table with a dense key and an array column as a 2-d array in chunks of one row."""
    column = F.col(values) if isinstance(values, str) else values
    return df.select(F.col(key).cast("bigint").alias("c0"), long(0).alias("c1"), column.alias("values"))


def column_as_cells(df: DataFrame, key: str, value: str, r: Range) -> DataFrame:
    """A column with a dense key as a 1-d array: the range is a predicate on the key."""
    return df.where(F.col(key).between(r.start, r.end - 1)).select(F.col(key).cast("bigint").alias("i0"), F.col(value).alias("v"))
