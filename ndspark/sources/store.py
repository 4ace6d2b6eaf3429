"""Stores: a catalog of nodes and, for each array, its chunks in Parquet files sorted by chunk coordinates."""

from __future__ import annotations

import tempfile
import uuid
from array import array
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, cells
from ..types import DataType, StoreError, as_ranges, check_ranges


def write_store(nodes: DataFrame, arrays: dict[int, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Write nodes (schema catalog.NODES) and, by node_id, the cells i0..ik, v of each array.

    Chunks are range-partitioned and sorted by their coordinates, so a slice reads few files and few
    row groups. The catalog is written last: a store without one can't be opened.
    """
    for row in nodes.where(F.col("node_id").isin(list(arrays))).collect():
        chunks = cells.to_chunks(arrays[row.node_id], row.dims, row.chunk_dims)
        keys = [f"c{d}" for d in range(len(row.dims))]
        chunks.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode).parquet(f"{path}/chunks/node={row.node_id}")
    nodes.coalesce(1).write.mode(mode).parquet(f"{path}/nodes")


class Store:
    """An open store. Its nodes are read once; nothing else runs until a result is asked for."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        try:
            nodes = spark.read.parquet(f"{path}/nodes")
        except Exception as e:
            raise StoreError(f"{path} holds no store") from e
        missing = {f.name for f in catalog.NODES} - set(nodes.columns)
        if missing:
            raise StoreError(f"{path} holds no store: it lacks {', '.join(sorted(missing))}")
        roots = nodes.where("parent_id IS NULL").collect()
        if len(roots) != 1:
            raise StoreError(f"{path} holds no store: it has {len(roots)} roots")
        self.nodes = nodes.select(*[f.name for f in catalog.NODES])
        self.root = Node(self, roots[0])

    def node(self, node_id: int) -> Node | None:
        return self.root._one(self.nodes.where(F.col("node_id") == node_id))


class Node:
    """The root, a group, a scalar or an array of a store."""

    def __init__(self, store: Store, row):
        self._store, self._row = store, row

    @property
    def row(self):
        if self._row is None:
            raise StoreError("this node was closed")
        return self._row

    def close(self) -> None:
        self._row = None

    def __enter__(self) -> Node:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _one(self, df: DataFrame) -> Node | None:
        found = df.limit(1).collect()
        return Node(self._store, found[0]) if found else None

    # metadata
    @property
    def node_id(self) -> int:
        return self.row.node_id

    @property
    def data_type(self) -> DataType:
        return DataType(self.row.dtype)

    @property
    def compression(self) -> int:
        return self.row.compression

    @property
    def scale_factor(self) -> float:
        return self.row.scale_factor

    @property
    def add_offset(self) -> float:
        return self.row.add_offset

    @property
    def dimensions(self) -> list[int]:
        return list(self.row.dims or [])

    @property
    def chunk_dimensions(self) -> list[int]:
        return list(self.row.chunk_dims or [])

    @property
    def name(self) -> str | None:
        return self.row["name"] or None

    # hierarchy
    @property
    def number_of_children(self) -> int:
        return self._store.nodes.where(F.col("parent_id") == self.node_id).count()

    def child(self, index: int) -> Node | None:
        return self._one(catalog.child(self._store.nodes, self.node_id, index))

    def child_by_name(self, name: str) -> Node | None:
        return self._one(catalog.child_by_name(self._store.nodes, self.node_id, name))

    def find_by_path(self, path: str) -> Node | None:
        return self._one(catalog.find_by_path(self._store.nodes, self.node_id, path))

    # values
    def read_scalar(self, dtype: DataType):
        """The value, or None if the node has another type."""
        self.row
        found = self._store.nodes.where(F.col("node_id") == self.node_id).select(catalog.scalar(dtype).alias("v")).collect()
        return found[0].v if found else None

    def chunks(self) -> DataFrame:
        return self._store.spark.read.parquet(f"{self._store.path}/chunks/node={self.node_id}")

    def _checked(self, dtype: DataType, ranges):
        row = self.row
        dtype = DataType(dtype)
        if dtype != row.dtype or not dtype.readable:
            raise StoreError(f"values of type {DataType(row.dtype).name} were asked for as {dtype.name}")
        ranges = as_ranges(ranges)
        check_ranges(ranges, row.dims)
        return ranges

    def read(self, dtype: DataType, ranges) -> DataFrame:
        """Cells i0..ik, v. The type must be the node's; type, rank and bounds are checked here, not when the job runs."""
        ranges = self._checked(dtype, ranges)
        return cells.read_cells(self.chunks(), self.row.dims, self.row.chunk_dims, ranges)

    def read_flat(self, dtype: DataType, ranges) -> list:
        """The values as a row-major list on the driver, for slices that fit there."""
        ranges = self._checked(dtype, ranges)
        return list(cells.flat(self.read(dtype, ranges), ranges).first()["values"])

    def read_into(self, dtype: DataType, ranges, output) -> None:
        """Fill a buffer from its start; it must have room for the slice, and what lies behind stays."""
        ranges = self._checked(dtype, ranges)
        need = 1
        for r in ranges:
            need *= r.count
        if len(output) < need:
            raise StoreError(f"the buffer has room for {len(output)} of {need} values")
        values = self.read_flat(dtype, ranges)
        output[:need] = array(output.typecode, values) if isinstance(output, array) else values

    def prefetch(self, ranges) -> DataFrame:
        """The chunks of the ranges, kept by Spark and loaded now; no type is asked for. Unpersist the result when done."""
        ranges = as_ranges(ranges)
        check_ranges(ranges, self.row.dims)
        df = self.chunks()
        for d, (r, h) in enumerate(zip(ranges, self.row.chunk_dims)):
            df = df.where(F.col(f"c{d}").between(r.start // h, (r.end - 1) // h))
        df = df.persist()
        df.count()
        return df


def open_store(spark: SparkSession, path: str) -> Node:
    """The root node of the store at path."""
    return Store(spark, path).root


@contextmanager
def cancellable(spark: SparkSession, tag: str):
    """Jobs started inside can be cancelled from elsewhere by spark.interruptTag(tag)."""
    spark.addTag(tag)
    try:
        yield
    finally:
        spark.removeTag(tag)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the cluster's shared folder (spark.checkpoint.dir); a temporary one only for a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise StoreError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.gettempdir()
    return f"{base}/ndspark-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: what a loop builds on stays a scan."""
    df.write.parquet(folder := scratch(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(folder)
