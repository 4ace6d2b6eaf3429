"""The fixture tree written as a store and read back; slices against plain lists; plans."""

import array
import itertools
from decimal import Decimal

import pytest

from ndspark.operators import cells, io_plan
from ndspark.plans import fixture
from ndspark.sources.store import cancellable, open_store, write_store
from ndspark.types import DataType, Range, StoreError


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("s") / "tree")
    write_store(fixture.nodes(spark), fixture.arrays(spark), path)
    return open_store(spark, path)


def test_navigation(root):
    assert root.name == "root" and root.number_of_children == 2
    assert root.child(0).name == "child_0" and root.child(1).name == "all_types" and root.child(2) is None
    assert root.child_by_name("child_0").child_by_name("child_0_9") is None
    assert root.find_by_path("child_0/child_0_2") is None
    assert root.find_by_path("") is None and root.find_by_path("/") is None
    assert root.find_by_path("//child_0/child_0_1/child_0_1_0/").name == "child_0_1_0"
    assert root.find_by_path("child_0/child_0_1").number_of_children == 2


def test_metadata(root):
    node = root.find_by_path("child_0/child_0_0/child_0_0_1")
    assert (node.data_type, node.scale_factor, node.add_offset) == (DataType.FLOAT_ARRAY, 20.0, 0.0)
    assert (node.dimensions, node.chunk_dimensions, node.compression) == ([2, 3], [2, 3], 2)


def test_float_slices(root):
    node = root.find_by_path("child_0/child_0_0/child_0_0_1")
    assert node.read_flat(DataType.FLOAT_ARRAY, [(0, 2), (0, 3)]) == pytest.approx([20.1, 20.2, 20.3, 21.1, 21.2, 21.3], abs=1e-5)
    assert node.read_flat(DataType.FLOAT_ARRAY, [slice(1, 2), slice(0, 2)]) == pytest.approx([21.1, 21.2], abs=1e-5)
    assert root.find_by_path("child_0/child_0_1/child_0_1_1").read_flat(DataType.FLOAT_ARRAY, [(0, 2)]) == [1013.25, 1012.5]


@pytest.mark.parametrize("name,dtype,values", fixture.ARRAYS)
def test_every_array_type(root, name, dtype, values):
    got = root.find_by_path(f"all_types/{name}").read_flat(dtype, [(0, 3)])
    assert got == pytest.approx(values, rel=1e-6)


@pytest.mark.parametrize("name,dtype,field,value", fixture.SCALARS)
def test_every_scalar_type(root, name, dtype, field, value):
    node = root.find_by_path(f"all_types/{name}")
    got = node.read_scalar(dtype)
    assert got == (value if isinstance(value, (str, Decimal)) else pytest.approx(value, rel=1e-6))
    other = DataType.STRING if dtype != DataType.STRING else DataType.INT8
    assert node.read_scalar(other) is None and node.read_scalar(dtype.array) is None


def test_errors_come_before_any_job(root):
    node = root.find_by_path("child_0/child_0_0/child_0_0_1")
    with pytest.raises(StoreError, match="asked for as"):
        node.read(DataType.DOUBLE_ARRAY, [(0, 9), (0, 9), (0, 9)])
    with pytest.raises(StoreError, match="rank 2"):
        node.read(DataType.FLOAT_ARRAY, [(0, 1)] * 3)
    for bad in ((0, 3), (1, 1), (2, 1), (-1, 1)):
        with pytest.raises(StoreError, match="outside of dimension 0"):
            node.read(DataType.FLOAT_ARRAY, [bad, (0, 1)])
    with pytest.raises(StoreError, match="room for 5 of 6"):
        node.read_into(DataType.FLOAT_ARRAY, [(0, 2), (0, 3)], [0.0] * 5)
    node.close()
    with pytest.raises(StoreError, match="closed"):
        node.read(DataType.FLOAT_ARRAY, [(0, 1), (0, 1)])
    with pytest.raises(StoreError, match="closed"):
        _ = node.dimensions


def test_not_a_store(spark, tmp_path):
    with pytest.raises(StoreError, match="holds no store"):
        open_store(spark, str(tmp_path / "none"))


def test_read_into_and_prefetch(root):
    node = root.find_by_path("all_types/int32")
    buffer = array.array("i", [7] * 4)
    node.read_into(DataType.INT32_ARRAY, [(1, 3)], buffer)
    assert list(buffer) == [0, 32, 7, 7]
    kept = node.prefetch([(0, 1)])
    assert kept.count() == 1
    kept.unpersist()


def test_cancellable(spark):
    with cancellable(spark, "some"):
        assert "some" in spark.getTags()
    assert "some" not in spark.getTags()


def grid(spark, dims):
    return spark.createDataFrame([(*i, float(v)) for v, i in enumerate(itertools.product(*map(range, dims)))], ", ".join(f"i{d} bigint" for d in range(len(dims))) + ", v double")


@pytest.mark.parametrize("dims,chunk,ranges", [([5, 5], [2, 2], [(0, 2), (0, 2)]), ([5, 5], [2, 2], [(1, 4), (0, 3)]), ([5, 5], [5, 5], [(1, 4), (0, 3)]), ([7], [3], [(2, 7)]), ([3, 4, 5], [2, 3, 2], [(0, 3), (1, 4), (1, 5)]), ([2, 3, 2, 3], [1, 2, 2, 2], [(0, 2), (1, 3), (0, 1), (0, 3)])])
def test_any_chunk_shape_gives_the_same_cells(spark, dims, chunk, ranges):
    chunks = cells.to_chunks(grid(spark, dims), dims, chunk)
    ranges = [Range(*r) for r in ranges]
    want = [float(v) for v, i in enumerate(itertools.product(*map(range, dims))) if all(r.start <= x < r.end for r, x in zip(ranges, i))]
    found = cells.read_cells(chunks, dims, chunk, ranges)
    assert cells.flat(found, ranges).first()["values"] == want
    whole = [x for part in io_plan.slice_parts(ranges, [2] + [1] * (len(dims) - 1)) for x in cells.read_cells(chunks, dims, chunk, part).collect()]
    assert sorted(whole) == sorted(found.collect())


def test_slices_are_narrow_and_pruned(root):
    node = root.find_by_path("child_0/child_0_0/child_0_0_1")
    plan = node.read(DataType.FLOAT_ARRAY, [(0, 1), (0, 2)])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "GreaterThanOrEqual(c0" in plan and "Python" not in plan


def test_chunks_touched():
    assert io_plan.chunks_touched([5, 5], [2, 2], [Range(0, 2), Range(0, 2)]) == 1
    for shape, n in (([64, 16], 2), ([7, 5], 27), ([500, 64], 1), ([1, 1], 480)):
        assert io_plan.chunks_touched([500, 64], shape, [Range(10, 70), Range(4, 12)]) == n


def test_data_source(spark, root, tmp_path):
    from ndspark.operators import catalog
    from ndspark.sources.ndarray import NdArraySource

    spark.dataSource.register(NdArraySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        for node, dtype in (("child_0/child_0_0/child_0_0_1", DataType.FLOAT_ARRAY), ("all_types/uint64", DataType.UINT64_ARRAY)):
            node = root.find_by_path(node)
            df = spark.read.format("ndarray").options(path=root._store.path, node=node.node_id).load()
            assert sorted(df.collect()) == sorted(node.read(dtype, [(0, n) for n in node.dimensions]).collect())
        rows = [(0, None, 0, "r", 0, 4, 1.0, 0.0, [], [], None), (1, 0, 0, "a", int(DataType.DOUBLE_ARRAY), 4, 1.0, 0.0, [30, 9], [4, 2], None)]
        write_store(spark.createDataFrame(rows, catalog.NODES), {1: grid(spark, [30, 9])}, str(tmp_path / "s"))
        node = open_store(spark, str(tmp_path / "s")).find_by_path("a")
        df = spark.read.format("ndarray").options(path=str(tmp_path / "s"), node=1, pieces=5).load().where("i0 > 5 AND i0 <= 22 AND i1 < 5")
        assert df.rdd.getNumPartitions() == 5 and sorted(df.collect()) == sorted(node.read(DataType.DOUBLE_ARRAY, [(6, 23), (0, 5)]).collect())
        df = spark.read.format("ndarray").options(dims="100,8", chunk_dims="10,8").load()
        some = df.where("i0 >= 15 AND i0 < 32")
        assert some.rdd.getNumPartitions() == 3 and some.count() == 17 * 8
        assert {r.v for r in some.collect()} == set(range(15 * 8, 32 * 8))
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_streamed_chunks(spark, tmp_path):
    from ndspark.streaming.ingest import append_chunks

    grid(spark, [4, 4]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("i0 bigint, i1 bigint, v double").parquet(str(tmp_path / "in"))
    append_chunks(stream, [4, 4], [2, 2], str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    chunks = spark.read.parquet(str(tmp_path / "out"))
    assert cells.read_cells(chunks, [4, 4], [2, 2], [Range(0, 4), Range(0, 4)]).count() == 16
