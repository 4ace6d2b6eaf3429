"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts define it.
SPACE = r"[\x20\x09-\x0D]"
#: One key may hold at most 1/SHARE of a partition's rows before it is dealt out.
SHARE = 4


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared(spark: SparkSession) -> str:
    """The cluster's shared folder: the session's spark.checkpoint.dir, a temporary one only where that is unset and the master is local."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ndspark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under the shared one."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole(text: Column | str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the identifier as text, modulo n: the folds of the contracts."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def lookup(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, spread: Column) -> DataFrame:
    """left LEFT JOIN right on keys, where a few keys may hold most rows of left.

    right has one row a key and is materialised; its column `weight` is the number of left's rows with
    the key and `total` their sum. Keys above total / (SHARE x partitions) rows are broadcast: there
    can't be more than SHARE x partitions of them, whatever the input. Their rows join the others'
    shuffle under a salt made of `spread`, so no task gets more than its share.
    """
    parts = partitions(left.sparkSession)
    limit = max(1, total // (SHARE * parts))
    payload = [c for c in right.columns if c not in (*keys, weight)]
    hot = right.where(F.col(weight) > limit)
    if hot.isEmpty():
        return left.join(right.drop(weight), keys, "left")
    heads = hot.select(*keys, *[F.col(c).alias(f"_hot_{c}") for c in payload], F.lit(True).alias("_hot"))
    marked = left.join(F.broadcast(heads), keys, "left").withColumn("_salt", F.when(F.col("_hot"), 1 + F.pmod(spread, F.lit(SHARE * parts))).otherwise(F.lit(0).cast("bigint")))
    # always 0, but no literal: the optimizer would take one out of the join's keys
    none = (F.col(weight) > limit).cast("bigint").alias("_salt")
    cold = right.where(F.col(weight) <= limit).select(*keys, none, *payload)
    joined = marked.join(cold, [*keys, "_salt"], "left")
    return joined.select(*left.columns, *[F.when(F.col("_hot"), F.col(f"_hot_{c}")).otherwise(F.col(c)).alias(c) for c in payload])


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder. For loops that join their own results: a checkpoint keeps
    size estimates, which such joins square until planning never ends; a table's size is known."""
    folder = shared_folder(df.sparkSession, "table")
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out._folder = folder
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what stored() wrote, once nothing reads it any more."""
    for t in tables:
        drop_folder(t.sparkSession, t._folder)
