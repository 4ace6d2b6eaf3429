"""Mixing sources to target weights by entropy balancing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SHARE, SPACE, documents, lookup, materialize, partitions, whole

#: A document is taken at most so many times.
CAP = 3


def words(text) -> Column:
    """Number of maximal runs of characters that are no ASCII white space."""
    return F.regexp_count(whole(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """key, source, source_size -> key, source_size, target. One row a source.

    Sources are ordered by code point, null last; the weights repeat along that order. The share of
    each is its weight's part of all words; what exceeds CAP times a source's words is dealt to the
    others by weight, until no source is above.

    With shares of weight, the sources saturate in order of weight / size, so one sort decides: with
    the first k saturated, the level is (all - CAP x their sizes) / (remaining weight); source k
    saturates while level x its weight is above its cap.
    """
    everything = Window.partitionBy(F.lit(0))
    ordered = everything.orderBy(F.asc_nulls_last("source"))
    n = len(weights)
    df = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (1 + F.pmod(F.row_number().over(ordered) - 1, F.lit(n))).cast("int")))
    steep = everything.orderBy(F.desc(F.when(F.col("source_size") > 0, F.col("weight") / F.col("source_size")).otherwise(F.lit(float("inf")))), F.asc_nulls_last("source"))
    before = steep.rowsBetween(Window.unboundedPreceding, -1)
    df = df.select(
        "*",
        F.sum("source_size").over(everything).alias("all_size"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("capped"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("left_weight"),
    )
    level = (F.col("all_size") - CAP * F.col("capped")) / F.col("left_weight")
    full = (CAP * F.col("source_size")).cast("double")
    df = df.withColumn("level", level).withColumn("over", level * F.col("weight") > full)
    last = F.min(F.when(~F.col("over"), F.struct(F.col("capped"), F.col("left_weight"), F.col("level")))).over(everything)["level"]
    return df.select("key", "source_size", F.when(F.col("over"), full).otherwise(F.least(full, F.coalesce(last, F.lit(0.0)) * F.col("weight"))).alias("target"))


def rate(lam: Column, x: Column) -> Column:
    """Tilted rate in (0, CAP); 1 at lam = 0: the base rate 1/CAP of each of CAP slots, tilted by exp(lam x)."""
    return CAP / (1 + (CAP - 1) * F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), lam * x))))


def balance(classes: DataFrame, steps: int = 40) -> DataFrame:
    """key, size, n, source_size, target -> with rate w such that sum(w n size) = target in each source.

    Entropy balancing: of all rates in (0, CAP), the ones nearest to 1 in relative entropy that meet
    the token constraint are the exponentially tilted ones; lam of a source minimises the convex dual
    whose gradient is sum(w n size) - target. x is 1/2 + size / (2 mean size) of the source, so long
    documents are tilted somewhat more than short ones and no rate depends on a unit. Each
    Newton step is one distributed sum over the histogram of sizes, with a bracket as guard.
    """
    own = Window.partitionBy("key")
    mean = F.sum(F.col("n") * F.col("size")).over(own) / F.sum("n").over(own)
    full = F.col("target") >= CAP * F.col("source_size") * (1 - 1e-12)
    base = materialize(classes.where("size > 0").withColumn("x", 0.5 + 0.5 * F.col("size") / mean).withColumn("state", F.when(full, 1).when(F.col("target") <= 0, -1).otherwise(0)))
    free = base.where("state = 0")
    lams = materialize(free.groupBy("key").agg(F.first("target").alias("goal")).withColumns({"lam": F.lit(0.0), "lo": F.lit(-1e3), "hi": F.lit(1e3)}))
    far = not lams.isEmpty()
    while far and steps:
        steps -= 1
        w = rate(F.col("lam"), F.col("x"))
        mass = F.col("n") * F.col("size")
        sums = free.join(lams, "key").groupBy("key", "goal", "lam", "lo", "hi").agg(F.sum(w * mass).alias("g"), F.sum(w * (1 - w / CAP) * F.col("x") * mass).alias("h"))
        gap = F.col("g") - F.col("goal")
        lo, hi = F.when(gap <= 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap >= 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - gap / F.greatest(F.col("h"), F.lit(1e-300))
        near = F.abs(gap) <= 1e-9 * F.col("goal")
        found = materialize(sums.select("key", "goal", F.when(near, F.col("lam")).when((newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2).alias("lam"), lo.alias("lo"), hi.alias("hi"), near.alias("near")))
        far, lams = not found.where(~F.col("near")).isEmpty(), found.drop("near")
    solved = base.join(lams.select("key", "lam"), "key", "left")
    return solved.select(*classes.columns, F.when(F.col("state") == 1, F.lit(float(CAP))).when(F.col("state") == -1, F.lit(0.0)).otherwise(rate(F.col("lam"), F.col("x"))).alias("w"))


def rounded(classes: DataFrame, fixes: int = 6) -> DataFrame:
    """w n of each class as an integer m, so that the sum of m size is near the target.

    Along the sizes of a source the running sum is rounded, so no error adds up beyond one document;
    then, `fixes` times, the largest class that fits into what is missing (or too much) takes or gives
    one copy.
    """
    own = Window.partitionBy("key")
    upto = own.orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = F.floor(F.sum(F.col("w") * F.col("n")).over(upto) + 0.5)
    df = classes.withColumn("r", running).withColumn("m", F.col("r") - F.coalesce(F.lag("r").over(own.orderBy("size")), F.lit(0))).drop("r")
    for _ in range(fixes):
        df = df.withColumn("miss", F.col("target") - F.sum(F.col("m") * F.col("size")).over(own))
        room = F.when(F.col("miss") > 0, F.col("m") < CAP * F.col("n")).otherwise(F.col("m") > 0)
        df = df.withColumn("pick", F.max(F.when(room & (F.col("size") <= F.abs(F.col("miss"))), F.col("size"))).over(own))
        df = df.withColumn("m", F.col("m") + F.when(F.col("size") == F.col("pick"), F.signum("miss").cast("bigint")).otherwise(0)).drop("miss", "pick")
    return df.withColumn("m", F.col("m").cast("bigint"))


def mixing_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """How often the mix takes each document: id, key, size, source_size, target, copies.

    Only the slim columns (identifier, source, number of words) are kept of the documents; the dual is
    solved over their histogram. Copies of a class (source, size) are dealt evenly in the order of a
    hash of the identifier; a class with more than 1/SHARE of a partition's rows is ranked in slices.

    Null text has size 0; documents without words are taken 0 times. Null source is a source of its
    own, the last. Null identifiers and repeated rows are documents like any other. An empty table
    gives no row. Other columns of the input are not read. Reruns give the same rows.
    """
    spark = df.sparkSession
    key = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "source"))
    slim = materialize(df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words(text_col).alias("size")).select("id", key.alias("key"), "source", "size"))
    classes = materialize(slim.groupBy("key", "size").agg(F.first("source").alias("source"), F.count(F.lit(1)).alias("n")))
    sums = classes.groupBy("key").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = materialize(targets(sums, weights))
    found = rounded(balance(classes.drop("source").join(goals, "key")))
    total = slim.count()
    limit = max(1, total // (SHARE * partitions(spark)))
    plan = classes.select("key", "size", F.col("n").alias("rows"), "n").join(found.select("key", "size", "m"), ["key", "size"], "left").join(goals, "key")
    plan = materialize(plan.select("key", "size", "rows", "source_size", "target", "n", F.coalesce("m", F.lit(0).cast("bigint")).alias("m"), (1 + F.floor(F.col("n") / limit)).alias("slices")))
    rows = lookup(slim.drop("source"), plan, ["key", "size"], "rows", total, F.xxhash64("id", F.lit(2)))
    rows = rows.withColumn("order", F.xxhash64("id")).withColumn("slice", F.pmod(F.xxhash64("id", F.lit(3)), "slices"))
    per = slim.join(F.broadcast(plan.where("slices > 1").select("key", "size", "slices")), ["key", "size"]).groupBy("key", "size", F.pmod(F.xxhash64("id", F.lit(3)), "slices").alias("slice")).agg(F.count(F.lit(1)).alias("c"))
    ahead = Window.partitionBy("key", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("key", "size", "slice", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("ahead"))
    rank = F.row_number().over(Window.partitionBy("key", "size", "slice").orderBy("order", F.asc_nulls_last("id"))) - 1
    ranked = rows.withColumn("rank", rank).join(F.broadcast(per), ["key", "size", "slice"], "left")
    place = F.col("rank") + F.coalesce("ahead", F.lit(0))
    copies = F.expr("m div n") + F.when(place < F.expr("m % n"), 1).otherwise(0)
    return ranked.select("id", "key", "size", "source_size", "target", copies.cast("bigint").alias("copies"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """The mix itself: every row of df as often as it is taken, with all of df's columns.

    Cases as in mixing_copies; of rows that repeat identifier, source and size, each is taken as often
    as the one taken most.
    """
    names = df.columns
    taken = mixing_copies(df, id_col, text_col, source_col, weights).groupBy("id", "key", "size").agg(F.max("copies").alias("copies"))
    taken = taken.where("copies > 0").select(F.col("id").alias("_mix_id"), F.col("key").alias("_mix_key"), F.col("size").alias("_mix_size"), F.col("copies").alias("_mix_copies"))
    own = F.when(F.col(source_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source_col).cast("string")))
    left = df.withColumn("_own_key", own).withColumn("_own_size", words(text_col))
    both = left.join(taken, left[id_col].eqNullSafe(F.col("_mix_id")) & (F.col("_own_key") == F.col("_mix_key")) & (F.col("_own_size") == F.col("_mix_size")))
    return both.withColumn("_mix_i", F.explode(F.sequence(F.lit(1).cast("bigint"), "_mix_copies"))).select(*names)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing_copies(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
