"""Array files: the fixture tree and random arrays written, then read through files, HTTP and caches."""

import functools
import http.server
import itertools
import os
import random
import threading
from decimal import Decimal

import numpy as np
import pytest

from ndspark.operators import cells
from ndspark.plans import fixture
from ndspark.sources.arrayfile import Header, decode, encode, merged, open_cached, open_file, write_file
from ndspark.sources.bytes import DiskBlockCache, FileSource, HttpSource, LruBlockCache
from ndspark.types import Compression, DataType, StoreError


class Counting(FileSource):
    """Counts reads; stops a read when told to."""

    reads, event, last = 0, None, 0

    def get_bytes(self, offset, size):
        self.reads += 1
        if self.event and self.reads >= self.last:
            self.event.set()
        return super().get_bytes(offset, size)


def square(spark, path, header=Header.TRAILER):
    node = (0, None, 0, "data", int(DataType.FLOAT_ARRAY), int(Compression.PFOR_DELTA_2D_INT16), 1.0, 0.0, [5, 5], [2, 2], None)
    values = spark.createDataFrame([(i // 5, i % 5, float(i)) for i in range(25)], "i0 bigint, i1 bigint, v float")
    write_file([node], {0: cells.to_chunks(values, [5, 5], [2, 2])}, path, header)
    return path


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("f") / "tree.ndf")
    shapes = {r[0]: (r[8], r[9]) for r in fixture.rows()}
    write_file(fixture.rows(), {i: cells.to_chunks(df, *shapes[i]) for i, df in fixture.arrays(spark).items()}, path)
    return path


def test_tree(tree):
    root = open_file(FileSource(tree))
    assert root.name == "root" and root.number_of_children == 2 and root.child(2) is None
    assert root.find_by_path("child_0/child_0_2") is None and root.find_by_path("/") is None
    node = root.find_by_path("child_0/child_0_0/child_0_0_1")
    assert node.read_flat(DataType.FLOAT_ARRAY, [(0, 2), (0, 3)]) == pytest.approx([20.1, 20.2, 20.3, 21.1, 21.2, 21.3], abs=1e-5)
    for name, dtype, values in fixture.ARRAYS:
        got = root.find_by_path(f"all_types/{name}").read_flat(dtype, [(0, 3)])
        assert got.tolist() == pytest.approx([float(v) if isinstance(v, float) else int(v) for v in values], rel=1e-6)
    for name, dtype, _, value in fixture.SCALARS:
        node = root.find_by_path(f"all_types/{name}")
        assert node.read_scalar(dtype) == (value if isinstance(value, (str, Decimal)) else pytest.approx(value))
        assert node.read_scalar(DataType.STRING if dtype != DataType.STRING else DataType.INT8) is None


@pytest.mark.parametrize("header", [Header.TRAILER, Header.RECORD])
def test_reads_of_a_small_slice(spark, tmp_path, header):
    source = Counting(square(spark, str(tmp_path / "a"), header))
    node = open_file(source)
    assert node.read_flat(DataType.FLOAT_ARRAY, [(0, 2), (0, 2)]).tolist() == [0, 1, 5, 6]
    assert source.reads == 4 + (header == Header.RECORD)  # trailer, (header,) record, index, data
    assert node.read_flat(DataType.FLOAT_ARRAY, [(1, 4), (0, 3)]).tolist() == [5, 6, 7, 10, 11, 12, 15, 16, 17]
    for bad in ([(0, 1)] * 3, [(0, 100), (0, 100)], [(1, 1), (0, 1)]):
        with pytest.raises(StoreError):
            node.read_flat(DataType.FLOAT_ARRAY, bad)
    with pytest.raises(StoreError, match="asked for as"):
        node.read_flat(DataType.DOUBLE_ARRAY, [(0, 1), (0, 1)])
    with pytest.raises(StoreError, match="room"):
        node.read_into(DataType.FLOAT_ARRAY, [(0, 2), (0, 2)], np.zeros(3, "<f4"))
    room = np.full(6, 9, "<f4")
    node.read_into(DataType.FLOAT_ARRAY, [(0, 2), (0, 2)], room)
    assert room.tolist() == [0, 1, 5, 6, 9, 9]
    node.close()
    with pytest.raises(StoreError, match="closed"):
        node.read_flat(DataType.FLOAT_ARRAY, [(0, 1), (0, 1)])


def test_no_array_file():
    for data in (b"", b"0123456789", b"NDF1" + bytes([255] * 40), bytes(1000)):
        with pytest.raises(StoreError, match="no array file"):
            open_file(FileSource(data))


def test_a_read_stops(spark, tmp_path):
    source = Counting(square(spark, str(tmp_path / "a")))
    node = open_file(source)
    source.event, source.last = threading.Event(), source.reads + 2
    with pytest.raises(InterruptedError):
        node.read_flat(DataType.FLOAT_ARRAY, [(0, 5), (0, 5)], io_size_max=20, io_size_merge=0, stop=source.event)
    assert source.reads == source.last


def test_caches_and_prefetch(spark, tmp_path):
    path = square(spark, str(tmp_path / "a"))
    for cache in (LruBlockCache(64, 50), DiskBlockCache(str(tmp_path / "c"), 64, 50)):
        source = Counting(path)
        node = open_cached(source, cache, 1 if cache.key_kind == "number" else path)
        node.read_prefetch([(0, 5), (0, 5)])
        loaded = source.reads
        assert node.read_flat(DataType.FLOAT_ARRAY, [(0, 5), (0, 5)]).tolist() == list(range(25))
        assert source.reads == loaded <= -(-source.count() // 64)  # no block twice


def test_over_http(tree):
    class Handler(http.server.SimpleHTTPRequestHandler):
        def __init__(self, *args):
            super().__init__(*args, directory=os.path.dirname(tree))

        def log_message(self, *_):
            pass

        def do_GET(self):
            data = open(tree, "rb").read()
            a, b = self.headers["Range"].removeprefix("bytes=").split("-")
            self.send_response(206)
            self.send_header("Content-Length", str(int(b) + 1 - int(a)))
            self.end_headers()
            self.wfile.write(data[int(a) : int(b) + 1])

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = open_cached(HttpSource(f"http://127.0.0.1:{server.server_port}/tree.ndf"), LruBlockCache(512))
    assert root.find_by_path("child_0/child_0_1/child_0_1_1").read_flat(DataType.FLOAT_ARRAY, [(0, 2)]).tolist() == [1013.25, 1012.5]
    server.shutdown()


def test_cells_by_spark(spark, tree, tmp_path):
    path = square(spark, str(tmp_path / "a"))
    opener = functools.partial(FileSource, path)
    got = open_file(opener()).read(spark, opener, DataType.FLOAT_ARRAY, [(1, 4), (0, 3)], tasks=3)
    assert sorted(map(tuple, got.collect())) == [(i, j, 5.0 * i + j) for i in range(1, 4) for j in range(3)]
    opener = functools.partial(FileSource, tree)
    for name, dtype, values in fixture.ARRAYS:
        got = open_file(opener()).find_by_path(f"all_types/{name}").read(spark, opener, dtype, [(0, 3)])
        assert got.schema["v"].dataType == dtype.spark
        assert [r.v for r in got.orderBy("i0").collect()] == pytest.approx(values, rel=1e-6)


def test_every_compression_round_trips():
    rng = np.random.default_rng(1)
    for kind, dtype, shape in itertools.product(Compression, [d for d in DataType if d.readable], [(7,), (3, 4), (2, 3, 5)]):
        name = dtype.scalar.name.lower()
        record = {"compression": int(kind), "dtype": int(dtype), "scale_factor": 100.0 if "INT16" in kind.name or name in ("float", "double") else 1.0, "add_offset": 0.0}
        x = rng.integers(0, 100, shape).astype({"float": "<f4", "double": "<f8"}.get(name, name))
        got = decode(encode(x, record), list(shape), record)
        assert got.dtype == x.dtype and np.allclose(got, x, atol=0 if "LOG" not in kind.name else 3), (kind, dtype)
    record = {"compression": 0, "dtype": int(DataType.FLOAT_ARRAY), "scale_factor": 1.0, "add_offset": 0.0}
    assert np.isnan(decode(encode(np.array([np.nan, 1e9, 3], "<f4"), record), [3], record)).tolist() == [True, True, False]
    with pytest.raises(StoreError, match="decoded"):
        decode(b"no deflate", [3], record)


def test_merged_reads():
    rng = random.Random(2)
    for gap, most in itertools.product((0, 5, 100), (1, 30, 1000)):
        extents, at = [], 0
        for k in range(60):
            at += rng.choice([0, 0, 3, 50])
            extents.append((at, n := rng.randint(1, 40), k))
            at += n
        reads = list(merged(iter(extents), gap, most))
        assert [e for _, _, held in reads for e in held] == extents
        for off, size, held in reads:
            assert off == held[0][0] and off + size == held[-1][0] + held[-1][1] and (size <= most or len(held) == 1)
            assert all(b[0] - a[0] - a[1] <= gap for a, b in zip(held, held[1:]))
