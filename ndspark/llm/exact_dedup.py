"""Exact deduplication by a content sort, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SHARE, SPACE, documents, materialize, partitions, whole


def normalised(text) -> F.Column:
    return F.regexp_replace(whole(text), f"{SPACE}+", " ")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", levels: tuple[int, ...] = (32, 256, 2048)) -> DataFrame:
    """Groups of equal normalised texts; of each, the row with the smallest identifier stays.

    Spark samples splitters of the content and deals the rows out by range; each partition is sorted by
    the whole content, which puts equal texts side by side, and the window compares neighbours by it.
    The splitters see the first levels[0] characters; where different texts that begin alike are more
    than 1/SHARE of a partition, also what follows up to the next level. Beginnings that are still
    so frequent after the last level are told apart by a hash, so order across partitions ends
    there; equal texts meet anyway. A single text with more bytes than 1/SHARE of a partition is cut
    into slices by identifier; the first rows of its slices, one each, are compared by whole text
    again. At most SHARE x partitions such beginnings or texts exist, so their hashes are broadcast.

    Returns id, keep_id, group_size, kept, text_sha256, one row for each input row.
    Null text counts as empty. Null identifiers come last in the order; a group of nothing else has a
    null keep_id. Of rows that repeat identifier and text, one is kept. Identifiers may be of any type
    that has an order. An empty table gives no row. Other columns of the input are not read.
    """
    spark = df.sparkSession
    base = df.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
    total = df.agg(F.sum(F.octet_length(F.col(text_col)) + 1).alias("b")).first().b or 0
    share = max(1, total // (SHARE * partitions(spark)))
    part = lambda i: F.substring("norm", 1 + (levels[i - 1] if i else 0), levels[i] - (levels[i - 1] if i else 0))
    prefix = lambda i: F.xxhash64(F.substring("norm", 1, levels[i]))
    # one scan counts the beginnings of all levels and the whole texts: (level, hash), the last level is the whole
    n = len(levels)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), prefix(i).alias("p")) for i in range(n)], F.struct(F.lit(n).alias("level"), F.col("h").alias("p"))))
    heavy = base.select(F.xxhash64("norm").alias("h"), (F.octet_length("norm").cast("bigint") + 1).alias("b"), "norm").select("h", "b", each.alias("x"))
    heavy = heavy.groupBy("x.level", "x.p").agg(F.count(F.lit(1)).alias("c"), F.sum("b").alias("b"), (F.min("h") == F.max("h")).alias("one"))
    heavy = materialize(heavy.where((F.col("b") > share) & (F.col("c") > 1) & (F.col("one") == (F.col("level") == n))).select("level", "p", F.ceil(F.col("b") / share).alias("slices")))
    found = {r.level for r in heavy.select("level").distinct().collect()}
    keys = [part(0).alias("k0")]
    dealt = base
    for i in range(n):
        if i not in found:
            break  # a longer beginning is no more frequent
        much = heavy.where(F.col("level") == i).select(F.col("p").alias(f"_p{i}"), F.lit(True).alias(f"_much{i}"))
        dealt = dealt.join(F.broadcast(much), prefix(i) == F.col(f"_p{i}"), "left").drop(f"_p{i}")
        after = part(i + 1) if i + 1 < n else F.xxhash64("norm").cast("string")
        keys.append(F.when(F.col(f"_much{i}"), after).otherwise("").alias(f"k{i + 1}"))
    hot = n in found
    if hot:
        texts = heavy.where(F.col("level") == n).select("p", "slices")
        dealt = dealt.withColumn("_h", F.xxhash64("norm")).join(F.broadcast(texts), F.col("_h") == F.col("p"), "left")
        keys.append(F.when(F.col("slices").isNotNull(), F.pmod(F.xxhash64("id", F.lit(1)), "slices")).otherwise(F.lit(-1).cast("bigint")).alias("slice"))
    dealt = dealt.select("id", "norm", *keys)
    # the window's keys hold the range's, so it needs no shuffle of its own; a constant among them would
    keys = [c for c in dealt.columns if c not in ("id", "norm")]
    near = Window.partitionBy(*keys, "norm").orderBy(F.asc_nulls_last("id"))
    run = near.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = dealt.repartitionByRange(*keys).select("*", F.first("id").over(run).alias("keep"), F.count(F.lit(1)).over(run).alias("n"), F.row_number().over(near).alias("rn"))
    rows = rows.select("id", "keep", "n", "rn", F.sha2("norm", 256).alias("text_sha256"), *(["slice", F.when((F.col("slice") >= 0) & (F.col("rn") == 1), F.col("norm")).alias("head_text")] if hot else []))
    if hot:
        rows = materialize(rows)
        heads = rows.where(F.col("head_text").isNotNull())
        same = Window.partitionBy("head_text")
        firsts = F.row_number().over(same.orderBy(F.asc_nulls_last("keep"), "slice"))
        merged = heads.select("text_sha256", "slice", F.min("keep").over(same).alias("all_keep"), F.sum("n").over(same).alias("all_n"), (firsts == 1).alias("first"))
        rows = rows.join(F.broadcast(merged), ["text_sha256", "slice"], "left")
        many = F.col("all_n").isNotNull()
        keep, n_, first = F.when(many, F.col("all_keep")).otherwise(F.col("keep")), F.coalesce("all_n", "n"), F.coalesce("first", F.lit(True))
    else:
        keep, n_, first = F.col("keep"), F.col("n"), F.lit(True)
    return rows.select(F.col("id").alias(id_col), keep.alias("keep_id"), n_.cast("bigint").alias("group_size"), ((F.col("rn") == 1) & first).alias("kept"), "text_sha256")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
