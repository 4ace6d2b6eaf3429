"""Planning of reads: chunk grids, blocks counted from the end, coalescing, splitting, batches, retries."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..types import Range, check_ranges


def chunk_grid(spark: SparkSession, dims: list[int], chunk_dims: list[int]) -> DataFrame:
    """chunk_id, c0..ck, and lo and n of each dimension: every chunk of an array, row-major."""
    counts = [-(-n // h) for n, h in zip(dims, chunk_dims)]
    total = 1
    for n in counts:
        total *= n
    df, rest = spark.range(total).withColumnRenamed("id", "chunk_id"), F.col("chunk_id")
    stride = total
    for d, (n, h, count) in enumerate(zip(dims, chunk_dims, counts)):
        stride //= count
        df = df.withColumn(f"c{d}", F.expr(f"(chunk_id div {stride}) % {count}"))
        df = df.withColumn(f"lo{d}", F.col(f"c{d}") * h).withColumn(f"n{d}", F.least(F.lit(h).cast("bigint"), F.lit(n).cast("bigint") - F.col(f"lo{d}")))
    return df


def chunks_touched(dims: list[int], chunk_dims: list[int], ranges: list[Range]) -> int:
    check_ranges(ranges, dims)
    out = 1
    for r, h in zip(ranges, chunk_dims):
        out *= (r.end - 1) // h - r.start // h + 1
    return out


def touched_chunks(grid: DataFrame, chunk_dims: list[int], ranges: list[Range]) -> DataFrame:
    """The grid's chunks that the ranges meet."""
    for d, (r, h) in enumerate(zip(ranges, chunk_dims)):
        grid = grid.where(F.col(f"c{d}").between(r.start // h, (r.end - 1) // h))
    return grid


def block_of(offset: Column, file_size: Column, block_size: int) -> Column:
    """Blocks are counted from the end of the file, so its trailer is in block 0 and the first block is the short one."""
    return ((file_size - offset - 1) - F.pmod(file_size - offset - 1, F.lit(block_size))) / block_size


def block_cover(extents: DataFrame, block_size: int) -> DataFrame:
    """id, off, size, file_size -> a row for each block that an extent needs: id, block, block_start, block_end. size > 0."""
    bs = int(block_size)
    first, last = F.expr(f"(file_size - off - size) div {bs}"), F.expr(f"(file_size - off - 1) div {bs}")
    df = extents.where("size > 0").select("id", "file_size", F.explode(F.sequence(first, last)).alias("block"))
    end = F.col("file_size") - F.col("block") * bs
    return df.select("id", "block", F.greatest(F.lit(0).cast("bigint"), end - bs).alias("block_start"), end.alias("block_end"))


def coalesce_reads(extents: DataFrame, gap: int = 2048, file: str = "file") -> DataFrame:
    """file, off, size -> reads: extents of a file that lie at most `gap` apart become one.

    A new read begins where the furthest end so far is over `gap` behind.
    """
    w = Window.partitionBy(file).orderBy("off", "size")
    ends = F.max(F.col("off") + F.col("size")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = extents.withColumn("new", F.when(F.col("off") - ends <= gap, 0).otherwise(1))
    df = df.withColumn("read", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = df.groupBy(file, "read").agg(F.min("off").alias("start"), F.max(F.col("off") + F.col("size")).alias("end"), F.count(F.lit(1)).alias("extents"))
    return out.select(file, "start", "end", "extents")


def split_reads(reads: DataFrame, most: int = 65536) -> DataFrame:
    """start, end -> pieces of at most `most` bytes."""
    keep = [c for c in reads.columns if c not in ("start", "end")]
    df = reads.where(F.col("end") > F.col("start")).select(*keep, "end", F.explode(F.sequence("start", F.col("end") - 1, F.lit(most).cast("bigint"))).alias("start"))
    return df.select(*keep, "start", F.least("end", F.col("start") + most).alias("end"))


def batches(df: DataFrame, index: str, limit: int) -> DataFrame:
    """Batch of each task when at most `limit` run at once and each batch ends before the next."""
    if limit < 1:
        raise ValueError("limit must be positive")
    return df.withColumn("batch", F.expr(f"{index} div {int(limit)}"))


def backoff(attempt: Column, base: int = 500, most: int = 5000) -> Column:
    """Milliseconds to wait after a failed attempt: doubling, up to `most`."""
    return F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), attempt)).cast("bigint")


def slice_parts(ranges: list[Range], parts: list[int]) -> list[list[Range]]:
    """Ranges cut evenly into parts along each dimension; together their slices are the whole slice."""
    cuts = []
    for r, n in zip(ranges, parts):
        edges = [r.start + r.count * i // n for i in range(n + 1)]
        cuts.append([Range(a, b) for a, b in zip(edges, edges[1:]) if a < b])
    return [list(x) for x in product(*cuts)]
