"""Array files: a tree of arrays and scalars in one file, read through any byte source, cached or not.

The layout is this engine's own. Numbers are little-endian. `NDF2`, then for each array its chunks (row-major
chunk numbers, each chunk's values deflated) and an index of chunks + 1 offsets of 64 bits, then the nodes'
records as JSON, children before parents, and a trailer: `NDFT`, four zero bytes, offset and size of the
root's record. A file of one array may have its record in the header instead: `NDF1`, its size in 32 bits, the
record. Nulls and NaN are NaN in arrays of floats; other arrays can't hold nulls.
"""

from __future__ import annotations

import json
import struct
import threading
import zlib
from collections.abc import Callable, Iterator
from decimal import Decimal
from enum import IntEnum
from itertools import product
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..types import Compression, DataType, Range, StoreError, as_ranges, check_ranges
from .bytes import BlockCache, BlockCachedSource, ByteSource, run_limited

TRAILER = struct.Struct("<4s4xQQ")
#: Stands for a value that 16 bits can't hold.
ABSENT = -32768


class Header(IntEnum):
    """How a file begins."""

    INVALID = 0
    RECORD = 1
    TRAILER = 2


def header_kind(data: bytes) -> Header:
    return {b"NDF1": Header.RECORD, b"NDF2": Header.TRAILER}.get(data[:4], Header.INVALID)


def numpy_type(dtype: DataType) -> np.dtype:
    """Unsigned types keep their width in files."""
    name = DataType(dtype).scalar.name.lower()
    return np.dtype({"float": "f4", "double": "f8"}.get(name, name)).newbyteorder("<")


def encode(values: np.ndarray, record: dict) -> bytes:
    """One chunk: scaled to integers where the compression says so, less (or XOR) the row before, deflated."""
    kind, scale, offset = Compression(record["compression"]), record["scale_factor"], record["add_offset"]
    x, real = values, values.dtype.kind == "f"
    if kind in (Compression.PFOR_DELTA_2D_INT16, Compression.PFOR_DELTA_2D_INT16_LOGARITHMIC):
        x = x.astype("f8")
        if kind == Compression.PFOR_DELTA_2D_INT16_LOGARITHMIC:
            x = np.log10(1 + x)
        q = np.rint((x + offset) * scale)
        x = np.where(np.abs(q) <= 32767, q, ABSENT).astype("<i2")
    elif kind == Compression.PFOR_DELTA_2D and real:
        q, wide = np.rint((x.astype("f8") + offset) * scale), np.dtype("<i4" if x.itemsize == 4 else "<i8")
        least = np.iinfo(wide).min
        x = np.where(np.abs(q) < -float(least), q, least).astype(wide)
    if kind != Compression.NONE and len(x):
        x = x.view(f"<u{x.itemsize}")
        rows = x if x.ndim == 1 else x.reshape(-1, x.shape[-1])
        x = np.concatenate([rows[:1], rows[1:] ^ rows[:-1] if kind == Compression.FPX_XOR_2D else rows[1:] - rows[:-1]])
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def decode(data: bytes, shape: list[int], record: dict) -> np.ndarray:
    kind, scale, offset = Compression(record["compression"]), record["scale_factor"], record["add_offset"]
    kept = numpy_type(record["dtype"])
    short = kind in (Compression.PFOR_DELTA_2D_INT16, Compression.PFOR_DELTA_2D_INT16_LOGARITHMIC)
    scaled = short or (kind == Compression.PFOR_DELTA_2D and kept.kind == "f")
    stored = np.dtype("<i2") if short else np.dtype(f"<i{kept.itemsize}") if scaled else kept
    try:
        x = np.frombuffer(zlib.decompress(data), stored).reshape(shape)
    except (zlib.error, ValueError) as e:
        raise StoreError(f"a chunk of {len(data)} bytes can't be decoded") from e
    if kind != Compression.NONE:
        rows = x.view(f"<u{stored.itemsize}")
        rows = rows if rows.ndim == 1 else rows.reshape(-1, shape[-1])
        merge = np.bitwise_xor if kind == Compression.FPX_XOR_2D else np.add
        x = merge.accumulate(rows, axis=0, dtype=rows.dtype).view(stored).reshape(shape)
    if scaled:
        gone = x == (ABSENT if short else np.iinfo(stored).min)
        x = x / scale - offset
        if kind == Compression.PFOR_DELTA_2D_INT16_LOGARITHMIC:
            x = np.power(10.0, x) - 1
        if kept.kind == "f":
            x = np.where(gone, np.nan, x)
        elif gone.any():
            raise StoreError("an array of integers holds a value that 16 bits can't")
        else:
            x = np.rint(x)
    return x.astype(kept)


def grid_of(record: dict) -> list[int]:
    return [-(-n // h) for n, h in zip(record["dims"], record["chunk_dims"])]


def shape_of(record: dict, at) -> list[int]:
    return [min(h, n - c * h) for c, n, h in zip(at, record["dims"], record["chunk_dims"])]


def write_file(nodes: list, arrays: dict[int, DataFrame], path: str, header: Header = Header.TRAILER) -> None:
    """Write nodes (rows of catalog.NODES) and by node_id the chunks c0..ck, values of each array to one local file.

    Chunks come sorted from Spark, one partition at a time on the driver. Every chunk must be there. For trees
    that grow with the input, write a store.
    """
    from ..operators.catalog import NODES

    names = [f.name for f in NODES]
    rows = [dict(zip(names, n)) for n in nodes]
    children: dict = {}
    for r in sorted(rows, key=lambda r: r["ordinal"]):
        children.setdefault(r["parent_id"], []).append(r)
    if len(children.get(None, [])) != 1:
        raise StoreError("a file has one root")
    with open(path, "wb") as out:

        def put_array(r: dict, record: dict) -> None:
            grid, offsets = grid_of(record), []
            keys = [f"c{d}" for d in range(len(grid))]
            for k, row in enumerate(arrays[r["node_id"]].orderBy(*keys).toLocalIterator()):
                at = [row[c] for c in keys]
                if k >= prod(grid) or at != [int(x) for x in np.unravel_index(k, grid)]:
                    raise StoreError(f"chunk {at} is not the next one")
                kind = numpy_type(r["dtype"])
                values = [np.nan if v is None and kind.kind == "f" else int(v) if isinstance(v, Decimal) else v for v in row["values"]]
                offsets.append(out.tell())
                out.write(encode(np.array(values, kind).reshape(shape_of(record, at)), record))
            if len(offsets) != prod(grid):
                raise StoreError(f"{len(offsets)} of {prod(grid)} chunks came")
            offsets.append(out.tell())
            record["index"] = out.tell()
            out.write(np.array(offsets, "<u8").tobytes())

        def record_of(r: dict, below: list) -> dict:
            value = r["scalar"] and [str(v) if isinstance(v, Decimal) else v for v in r["scalar"]]
            return {k: r[k] for k in ("name", "dtype", "compression", "scale_factor", "add_offset", "dims", "chunk_dims")} | {"children": below, "value": value}

        if header == Header.RECORD:
            (r,) = rows
            record, room = record_of(r, []), 4096
            out.write(b"\0" * room)
            put_array(r, record)
            data = json.dumps(record).encode()
            if len(data) > room - 8:
                raise StoreError(f"a record in the header has room for {room - 8} bytes")
            out.seek(0)
            out.write(b"NDF1" + struct.pack("<I", len(data)) + data)
            return
        out.write(b"NDF2")
        extents, todo = {}, [(children[None][0], False)]
        while todo:  # children before parents, without recursion
            r, ready = todo.pop()
            below = children.get(r["node_id"], [])
            if below and not ready:
                todo += [(r, True), *[(c, False) for c in reversed(below)]]
                continue
            record = record_of(r, [extents[c["node_id"]] for c in below])
            if r["node_id"] in arrays:
                put_array(r, record)
            data = json.dumps(record).encode()
            extents[r["node_id"]] = (out.tell(), len(data))
            out.write(data)
        out.write(TRAILER.pack(b"NDFT", *extents[children[None][0]["node_id"]]))


def merged(extents, gap: int, most: int) -> Iterator[tuple[int, int, list]]:
    """Sorted (offset, size, what) -> reads (offset, size, [(offset, size, what)]): extents at most `gap` apart, up to `most` bytes unless one alone is larger."""
    first = end = 0
    held: list = []
    for off, size, what in extents:
        if held and (off - end > gap or off + size - first > most):
            yield first, end - first, held
            held = []
        if not held:
            first, end = off, off
        held.append((off, size, what))
        end = max(end, off + size)
    if held:
        yield first, end - first, held


def check_stop(stop: threading.Event | None) -> None:
    if stop is not None and stop.is_set():
        raise InterruptedError("stopped")


class FileNode:
    """The root, a group, a scalar or an array of an open file; opened by its record's extent in the file."""

    def __init__(self, source: ByteSource, extent: tuple[int, int], record: dict | None = None):
        self.source, self.extent = source, tuple(extent)
        self._record = json.loads(source.get_bytes(*extent)) if record is None else record
        self._children: dict[tuple[int, int], FileNode] = {}

    @property
    def record(self) -> dict:
        if self._record is None:
            raise StoreError("this node was closed")
        return self._record

    def close(self) -> None:
        self._record = None

    @property
    def name(self) -> str | None:
        return self.record["name"] or None

    @property
    def data_type(self) -> DataType:
        return DataType(self.record["dtype"])

    @property
    def dimensions(self) -> list[int]:
        return list(self.record["dims"] or [])

    @property
    def number_of_children(self) -> int:
        return len(self.record["children"])

    def child_at(self, extent: tuple[int, int]) -> FileNode:
        """The node of a record; each is read once."""
        if (extent := tuple(extent)) not in self._children:
            self._children[extent] = FileNode(self.source, extent)
        return self._children[extent]

    def child(self, index: int) -> FileNode | None:
        found = self.record["children"]
        return self.child_at(found[index]) if 0 <= index < len(found) else None

    def child_by_name(self, name: str) -> FileNode | None:
        return next((c for e in self.record["children"] if (c := self.child_at(e)).name == name), None)

    def find_by_path(self, path: str) -> FileNode | None:
        node, parts = self, [p for p in path.split("/") if p]
        for p in parts:
            if (node := node.child_by_name(p)) is None:
                return None
        return node if parts else None

    def read_scalar(self, dtype: DataType):
        """The value, or None if the node has another type."""
        if self.record["dtype"] != dtype or self.record["value"] is None:
            return None
        v = next(x for x in self.record["value"] if x is not None)
        return Decimal(v) if DataType(dtype) == DataType.UINT64 else v

    def _ranges(self, ranges) -> list[Range]:
        if not self.data_type.readable:
            raise StoreError(f"{self.data_type.name} holds no values to read")
        if "index" not in self.record:
            raise StoreError(f"{self.name} was written without values")
        ranges = as_ranges(ranges)
        check_ranges(ranges, self.record["dims"])
        return ranges

    def _checked(self, dtype: DataType, ranges) -> list[Range]:
        if DataType(dtype) != self.data_type:
            raise StoreError(f"values of type {self.data_type.name} were asked for as {DataType(dtype).name}")
        return self._ranges(ranges)

    def _data_reads(self, numbers, io_size_max: int, io_size_merge: int, stop) -> Iterator[tuple[int, int, list]]:
        """Reads that hold the chunks of these numbers (ascending); the index is read on the way, in merged reads as well."""
        entries = ((self.record["index"] + 8 * k, 16, k) for k in numbers)
        for off, size, held in merged(entries, io_size_merge, io_size_max):
            check_stop(stop)
            index = self.source.get_bytes(off, size)
            places = [(*struct.unpack_from("<QQ", index, at - off), k) for at, _, k in held]
            yield from merged(((a, b - a, k) for a, b, k in places), io_size_merge, io_size_max)

    def _touched(self, ranges: list[Range]) -> Iterator[int]:
        grid = grid_of(self.record)
        for at in product(*[range(r.start // h, (r.end - 1) // h + 1) for r, h in zip(ranges, self.record["chunk_dims"])]):
            yield int(np.ravel_multi_index(at, grid))

    def _pieces(self, ranges: list[Range], numbers, io_size_max: int, io_size_merge: int, stop=None):
        """(lows, values) of what the ranges take of each chunk."""
        grid = grid_of(self.record)
        for off, size, held in self._data_reads(numbers, io_size_max, io_size_merge, stop):
            check_stop(stop)
            data = self.source.get_bytes(off, size)
            for a, n, k in held:
                at = [int(x) for x in np.unravel_index(k, grid)]
                values = decode(data[a - off : a - off + n], shape_of(self.record, at), self.record)
                origin = [c * h for c, h in zip(at, self.record["chunk_dims"])]
                lows = [max(r.start, o) for r, o in zip(ranges, origin)]
                yield lows, values[tuple(slice(low - o, r.end - o) for low, r, o in zip(lows, ranges, origin))]

    def read_prefetch(self, ranges, concurrency: int = 20, io_size_max: int = 65536, io_size_merge: int = 2048, stop: threading.Event | None = None) -> None:
        """Load the blocks of the ranges' chunks into the source's cache, `concurrency` at once; nothing to do without a cache."""
        ranges = self._ranges(ranges)
        if not hasattr(self.source, "prefetch_tasks"):
            return
        reads = self._data_reads(self._touched(ranges), io_size_max, io_size_merge, stop)
        run_limited([t for off, size, _ in reads for t in self.source.prefetch_tasks(off, size)], concurrency, stop)

    def read_into(self, dtype: DataType, ranges, output: np.ndarray, prefetch: bool = True, concurrency: int = 10, io_size_max: int = 65536, io_size_merge: int = 2048, stop: threading.Event | None = None) -> None:
        """Fill a flat array from its start, row-major; what lies behind stays."""
        ranges = self._checked(dtype, ranges)
        counts = [r.count for r in ranges]
        if output.ndim != 1 or output.dtype != numpy_type(dtype) or len(output) < prod(counts):
            raise StoreError(f"{prod(counts)} values of {numpy_type(dtype)} need a flat array with room for them")
        if prefetch:
            self.read_prefetch(ranges, concurrency, io_size_max, io_size_merge, stop)
        cube = output[: prod(counts)].reshape(counts)
        for lows, values in self._pieces(ranges, self._touched(ranges), io_size_max, io_size_merge, stop):
            cube[tuple(slice(low - r.start, low - r.start + n) for low, r, n in zip(lows, ranges, values.shape))] = values

    def read_flat(self, dtype: DataType, ranges, **options) -> np.ndarray:
        """The values as a flat array, row-major; options as in read_into."""
        out = np.empty(prod(r.count for r in self._checked(dtype, ranges)), numpy_type(dtype))
        self.read_into(dtype, ranges, out, **options)
        return out

    def read(self, spark: SparkSession, opener: Callable[[], ByteSource], dtype: DataType, ranges, tasks: int = 200, io_size_max: int = 65536, io_size_merge: int = 2048) -> DataFrame:
        """Cells i0..ik, v by Spark: runs of touched chunks are dealt to tasks, and each opens the file for itself.

        opener gives a task its source, a cached one if it likes; it must work on every executor.
        """
        ranges, extent, record = self._checked(dtype, ranges), self.extent, self.record
        box = [(r.start // h, (r.end - 1) // h + 1) for r, h in zip(ranges, record["chunk_dims"])]
        total = prod(b - a for a, b in box)
        kind = DataType(dtype).spark
        schema = T.StructType([*[T.StructField(f"i{d}", T.LongType()) for d in range(len(box))], T.StructField("v", kind)])
        arrow = pa.decimal128(20, 0) if isinstance(kind, T.DecimalType) else pa.from_numpy_dtype(numpy_type(dtype) if numpy_type(dtype).kind != "u" else np.dtype(f"i{2 * numpy_type(dtype).itemsize}"))

        def chunks(batches):
            grid = grid_of(record)
            for batch in batches:
                for k in batch.column(0).to_numpy():
                    at = np.unravel_index(k, [b - a for a, b in box])
                    yield int(np.ravel_multi_index([x + a for x, (a, _) in zip(at, box)], grid))

        def run(batches):
            source = opener()
            try:
                node = FileNode(source, extent, record)
                for lows, values in node._pieces(ranges, chunks(batches), io_size_max, io_size_merge):
                    places = np.indices(values.shape).reshape(values.ndim, -1) + np.array(lows)[:, None]
                    flat = values.reshape(-1)
                    v = pa.array([Decimal(int(x)) for x in flat], arrow) if pa.types.is_decimal(arrow) else pa.array(flat.astype(arrow.to_pandas_dtype()), arrow)
                    yield pa.RecordBatch.from_arrays([*[pa.array(p) for p in places], v], names=schema.names)
            finally:
                source.close()

        return spark.range(0, total, 1, min(total, tasks)).mapInArrow(run, schema)


def open_file(source: ByteSource) -> FileNode:
    """The root node: by the trailer, or by the header of a file that keeps its record there."""
    size = source.count()
    if size >= TRAILER.size:
        mark, offset, length = TRAILER.unpack(source.get_bytes(size - TRAILER.size, TRAILER.size))
        if mark == b"NDFT" and offset + length <= size - TRAILER.size:
            return FileNode(source, (offset, length))
        head = source.get_bytes(0, 8)
        length = struct.unpack("<I", head[4:])[0]
        if header_kind(head) == Header.RECORD and 8 + length <= size:
            return FileNode(source, (8, length))
    raise StoreError("this is no array file")


def open_cached(source, cache: BlockCache, base: int | str | None = None) -> FileNode:
    """The root node of a file that is read through a cache: under the source's own key (HTTP), or the given one."""
    return open_file(source.cached(cache) if base is None else BlockCachedSource(source, cache, base))
