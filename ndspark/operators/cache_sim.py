"""What block caches would do on an access log: LRU hits, FIFO eviction, sliding expiry, statistics."""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored


def lru_hits(log: DataFrame, key: str, order: str, capacity: int, segment: int = 65_536) -> DataFrame:
    """order, key, hit: whether a cache of `capacity` blocks that drops the least recently used one holds the key.

    `order` is a dense number from 0. The log is cut into segments. What the cache holds at a segment's
    start are the last `capacity` distinct keys before it, so each segment is first reduced to its own
    last ones. Joining two such summaries is associative: the last use of each key, and of those the last
    `capacity`. So all prefixes come from rounds that double their reach, as many as the logarithm of
    the number of segments, each over at most `capacity` rows a segment; then all segments are replayed
    in parallel.
    """
    cap = max(1, capacity)
    df = log.select(F.col(order).cast("bigint").alias("t"), F.col(key).cast("bigint").alias("k")).withColumn("s", F.expr(f"t div {int(segment)}"))

    def latest(uses: DataFrame) -> DataFrame:
        last = uses.groupBy("s", "k").agg(F.max("t").alias("t"))
        return last.withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy(F.desc("t")))).where(F.col("r") <= cap).select("s", "k", "t")

    held, reach = latest(df), 1
    segments = (df.agg(F.max("s").alias("s")).first().s or 0) + 1
    while reach < segments:
        held = stored(held, "lru")
        held = latest(held.unionByName(held.select((F.col("s") + reach).alias("s"), "k", "t").where(F.col("s") < segments)))
        reach *= 2
    start = held.select((F.col("s") + 1).alias("s"), "k", "t").where(F.col("s") < segments)

    def replay(key, before: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        held = OrderedDict.fromkeys(before.sort_values("t")["k"])
        part, hits = part.sort_values("t"), []
        for k in part["k"]:
            hits.append(k in held)
            held.pop(k, None)
            held[k] = None
            if len(held) > cap:
                held.popitem(last=False)
        return part.assign(hit=hits)[["t", "k", "hit"]]

    return start.groupBy("s").cogroup(df.groupBy("s")).applyInPandas(replay, "t bigint, k bigint, hit boolean")


def evict_fifo(entries: DataFrame, max_bytes: int, fraction: float = 0.1, cache: str | None = None) -> DataFrame:
    """key, size, created_at -> with evicted: when the total exceeds max_bytes, the oldest go until it is at most (1 - fraction) of it.

    Entries without a time are the oldest. With `cache`, each cache by itself. Entries are dealt out by
    ranges of time, so one cache may hold them all: sums of the ranges are added up first, few rows,
    and within a range the running sum starts from there.
    """
    name = F.col(cache) if cache else F.lit("")
    at = F.struct(F.coalesce("created_at", F.lit(0)).alias("at"), F.col("key"))
    dealt = entries.withColumn("_cache", name).withColumn("_at", at).repartitionByRange("_cache", "_at").withColumn("_range", F.spark_partition_id())
    dealt = stored(dealt, "evict")
    sums = dealt.groupBy("_cache", "_range").agg(F.sum("size").alias("_sum"))
    own = Window.partitionBy("_cache")
    before = own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_cache", "_range", F.sum("_sum").over(own).alias("_total"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_ahead"))
    both = dealt.join(sums, dealt["_cache"].eqNullSafe(sums["_cache"]) & (dealt["_range"] == sums["_range"])).drop(sums["_cache"]).drop(sums["_range"])
    within = Window.partitionBy("_cache", "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    freed = F.col("_ahead") + F.coalesce(F.sum("size").over(within), F.lit(0))
    evicted = (F.col("_total") > max_bytes) & (F.col("_total") - freed > max_bytes * (1 - fraction))
    return both.withColumn("evicted", evicted).select(*entries.columns, "evicted")


def ttl_hits(log: DataFrame, key: str, ts: str, ttl_us: int, tie: str) -> DataFrame:
    """log with hit: whether the key was used at most ttl before; each use starts the time again."""
    last = F.lag(ts).over(Window.partitionBy(key).orderBy(ts, tie))
    return log.withColumn("hit", F.coalesce(F.col(ts) - last <= ttl_us, F.lit(False)))


def single_flight(log: DataFrame, key: str, window: str) -> DataFrame:
    """The fetches that are left when requests for a key in the same window share one."""
    return log.select(window, key).distinct()


def stats(log: DataFrame, hit: str, size: str) -> DataFrame:
    """requests, hits, misses, bytes and hit_bytes in one row."""
    h = F.col(hit).cast("bigint")
    return log.agg(F.count(F.lit(1)).alias("requests"), F.sum(h).alias("hits"), F.sum(1 - h).alias("misses"), F.sum(size).cast("bigint").alias("bytes"), F.sum(h * F.col(size)).cast("bigint").alias("hit_bytes"))
