"""format("ndarray"): a store's array as a Spark data source that plans only the chunks a filter needs.

Register with spark.dataSource.register(NdArraySource). Needs spark.sql.python.filterPushdown.enabled; the
plain path (Node.read) needs nothing and stays inside the JVM. Chunk files are read by pyarrow, so the path
must be one that it can open.
"""

from __future__ import annotations

from math import prod

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual


class NdArraySource(DataSource):
    """Options: path and node (a store's folder and the array's node_id), pieces (tasks at most, 200).

    Without a path, dims and chunk_dims (comma-separated) give a virtual array whose values are positions in
    row-major order.
    """

    @classmethod
    def name(cls) -> str:
        return "ndarray"

    def _shape(self) -> tuple[list[int], list[int], str]:
        if "path" not in self.options:
            numbers = [[int(x) for x in self.options[k].split(",")] for k in ("dims", "chunk_dims")]
            return numbers[0], numbers[1], "bigint"
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        from ..types import DataType, StoreError

        found = ds.dataset(f"{self.options['path']}/nodes").to_table(columns=["dims", "chunk_dims", "dtype"], filter=pc.field("node_id") == int(self.options["node"])).to_pylist()
        if len(found) != 1 or not DataType(found[0]["dtype"]).readable:
            raise StoreError(f"{self.options['path']} has no array under node {self.options['node']}")
        return found[0]["dims"], found[0]["chunk_dims"], DataType(found[0]["dtype"]).spark.simpleString()

    def schema(self) -> str:
        dims, _, kind = self._shape()
        return ", ".join(f"i{d} bigint" for d in range(len(dims))) + f", v {kind}"

    def reader(self, schema) -> DataSourceReader:
        dims, chunk_dims, _ = self._shape()
        folder = f"{self.options['path']}/chunks/node={self.options['node']}" if "path" in self.options else None
        return NdArrayReader(dims, chunk_dims, folder, int(self.options.get("pieces", 200)))


class NdArrayReader(DataSourceReader):
    def __init__(self, dims: list[int], chunk_dims: list[int], folder: str | None, pieces: int):
        self.dims, self.chunk_dims, self.folder, self.pieces = dims, chunk_dims, folder, max(1, pieces)
        self.bounds = [[0, n] for n in dims]

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else ""
            if name[:1] == "i" and name[1:].isdigit() and isinstance(getattr(f, "value", None), int):
                b, v = self.bounds[int(name[1:])], f.value
                if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                    b[0] = max(b[0], v)
                if isinstance(f, GreaterThan):
                    b[0] = max(b[0], v + 1)
                if isinstance(f, (EqualTo, LessThanOrEqual)):
                    b[1] = min(b[1], v + 1)
                if isinstance(f, LessThan):
                    b[1] = min(b[1], v)
            yield f  # Spark checks the cells again

    def _box(self) -> list[tuple[int, int]]:
        """First and last chunk of each dimension that the bounds touch."""
        return [(a // h, (b - 1) // h) for (a, b), h in zip(self.bounds, self.chunk_dims)]

    def partitions(self):
        """Ranges of the touched chunks' numbers, row-major within the box: a few numbers, however many chunks."""
        if any(a >= b for a, b in self.bounds):
            return []
        n = prod(b - a + 1 for a, b in self._box())
        cuts = min(n, self.pieces)
        return [InputPartition((n * i // cuts, n * (i + 1) // cuts)) for i in range(cuts)]

    def _chunks(self, first: int, end: int):
        """(coordinates, values) of the chunks of a range; values are None for the virtual array."""
        import numpy as np

        box = self._box()
        counts = [b - a + 1 for a, b in box]
        if self.folder is None:
            for k in range(first, end):
                yield [int(x) + a for x, (a, _) in zip(np.unravel_index(k, counts), box)], None
            return
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        per = prod(counts[1:])
        rows = [(box[0][0] + first // per, box[0][0] + (end - 1) // per), *box[1:]]
        wanted = None
        for d, (a, b) in enumerate(rows):
            here = (pc.field(f"c{d}") >= a) & (pc.field(f"c{d}") <= b)
            wanted = here if wanted is None else wanted & here
        for batch in ds.dataset(self.folder).to_batches(columns=[*[f"c{d}" for d in range(len(box))], "values"], filter=wanted):
            for i in range(len(batch)):
                at = [batch.column(d)[i].as_py() for d in range(len(box))]
                if first <= int(np.ravel_multi_index([x - a for x, (a, _) in zip(at, box)], counts)) < end:
                    yield at, batch.column(len(box))[i].values

    def read(self, partition):
        import numpy as np
        import pyarrow as pa

        for at, values in self._chunks(*partition.value):
            origin = [c * h for c, h in zip(at, self.chunk_dims)]
            shape = [min(h, n - o) for h, n, o in zip(self.chunk_dims, self.dims, origin)]
            ends = [(max(a, o), min(b, o + s)) for o, s, (a, b) in zip(origin, shape, self.bounds)]
            grid = np.stack(np.meshgrid(*[np.arange(a, b) for a, b in ends], indexing="ij")).reshape(len(ends), -1)
            if values is None:
                v = pa.array(np.ravel_multi_index(grid, self.dims))
            else:
                v = values.take(pa.array(np.ravel_multi_index(grid - np.array(origin)[:, None], shape)))
            yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in grid], v], names=[*[f"i{d}" for d in range(len(ends))], "v"])
