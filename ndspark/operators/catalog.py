"""The node catalog: metadata, navigation and typed scalars as queries over a small table.

nodes: node_id, parent_id, ordinal, name, dtype, compression, scale_factor, add_offset, dims, chunk_dims,
scalar struct<i, u, f, d, s>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import DataType

NODES = T.StructType(
    [
        T.StructField("node_id", T.LongType()),
        T.StructField("parent_id", T.LongType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("dtype", T.IntegerType()),
        T.StructField("compression", T.IntegerType()),
        T.StructField("scale_factor", T.FloatType()),
        T.StructField("add_offset", T.FloatType()),
        T.StructField("dims", T.ArrayType(T.LongType())),
        T.StructField("chunk_dims", T.ArrayType(T.LongType())),
        T.StructField("scalar", T.StructType([T.StructField("i", T.LongType()), T.StructField("u", T.DecimalType(20, 0)), T.StructField("f", T.FloatType()), T.StructField("d", T.DoubleType()), T.StructField("s", T.StringType())])),
    ]
)


def metadata(nodes: DataFrame) -> DataFrame:
    """Type, encoding, shape and name of every node; an empty name is none."""
    name = F.nullif(F.col("name"), F.lit(""))
    return nodes.select("node_id", "dtype", "compression", "scale_factor", "add_offset", "dims", "chunk_dims", name.alias("name"))


def children_count(nodes: DataFrame) -> DataFrame:
    """node_id, children: of every node, zero included."""
    counts = nodes.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.select("node_id").join(counts, "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("children"))


def child(nodes: DataFrame, parent: int, index: int) -> DataFrame:
    """The child at that place; no row if there is none."""
    return nodes.where((F.col("parent_id") == parent) & (F.col("ordinal") == index))


def child_by_name(nodes: DataFrame, parent: int, name: str) -> DataFrame:
    """The direct child of that name; the first of several. Unnamed children are never found."""
    return nodes.where((F.col("parent_id") == parent) & (F.col("name") == name) & (F.col("name") != "")).orderBy("ordinal").limit(1)


def path_parts(path: Column) -> Column:
    """The parts of a path; repeated, leading and trailing slashes don't count."""
    return F.filter(F.split(path, "/"), lambda p: p != "")


def find_by_path(nodes: DataFrame, root: int, path: str) -> DataFrame:
    """The node that a path leads to from root; no row for an empty path or a missing part.

    One small join for each part; at equal names the lowest ordinal wins at each step.
    """
    parts = [p for p in path.split("/") if p]
    if not parts:
        return nodes.limit(0)
    at = child_by_name(nodes, root, parts[0]).select(F.col("node_id").alias("at"))
    for part in parts[1:]:
        step = nodes.where(F.col("name") == part).join(at, F.col("parent_id") == F.col("at"))
        at = step.orderBy("ordinal").limit(1).select(F.col("node_id").alias("at"))
    return nodes.join(at, F.col("node_id") == F.col("at")).drop("at")


def with_paths(nodes: DataFrame, levels: int = 10_000) -> DataFrame:
    """node_id, path of every node below the root, by a recursive query. It fails on a tree of more than `levels` levels, and leaves nothing out."""
    nodes.createOrReplaceTempView("_ndspark_nodes")
    return nodes.sparkSession.sql(f"""
        WITH RECURSIVE walk(node_id, path) MAX RECURSION LEVEL {levels} AS (
          SELECT node_id, CAST('' AS STRING) FROM _ndspark_nodes WHERE parent_id IS NULL
          UNION ALL
          SELECT n.node_id, concat(w.path, '/', n.name)
          FROM walk w JOIN _ndspark_nodes n ON n.parent_id = w.node_id
          WHERE n.name <> ''
        ) SELECT node_id, path FROM walk WHERE path <> ''
    """)


def widened(value: Column, bits: int) -> Column:
    """The bits of a signed integer read as unsigned."""
    if bits < 64:
        return value.cast("bigint").bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
    wide = value.cast("decimal(20,0)")
    return F.when(wide < 0, (wide + F.expr("18446744073709551616")).cast("decimal(20,0)")).otherwise(wide)


def scalar(dtype: DataType) -> Column:
    """A node's value if it has that type, else null. Zero-length strings are null."""
    dtype = DataType(dtype)
    if dtype == DataType.NONE or dtype.is_array:
        return F.lit(None).cast("string")
    field = {DataType.UINT64: "u", DataType.FLOAT: "f", DataType.DOUBLE: "d", DataType.STRING: "s"}.get(dtype, "i")
    value = F.col("scalar")[field]
    if dtype == DataType.STRING:
        value = F.nullif(value, F.lit(""))
    return F.when(F.col("dtype") == int(dtype), value.cast(dtype.spark))
