"""A small tree with every scalar and array type, for tests and catalog queries. Fixed values."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from ..operators.catalog import NODES
from ..types import Compression, DataType

ARRAYS = [
    ("int8", DataType.INT8_ARRAY, [-8, 0, 8]),
    ("uint8", DataType.UINT8_ARRAY, [0, 8, 255]),
    ("int16", DataType.INT16_ARRAY, [-16, 0, 16]),
    ("uint16", DataType.UINT16_ARRAY, [0, 16, 65535]),
    ("int32", DataType.INT32_ARRAY, [-32, 0, 32]),
    ("uint32", DataType.UINT32_ARRAY, [0, 32, 4294967295]),
    ("int64", DataType.INT64_ARRAY, [-64, 0, 64]),
    ("uint64", DataType.UINT64_ARRAY, [Decimal(0), Decimal(64), Decimal(18446744073709551615)]),
    ("float32", DataType.FLOAT_ARRAY, [-3.14, 0.0, 2.71]),
    ("float64", DataType.DOUBLE_ARRAY, [-3.1415926535, 0.0, 2.7182818284]),
]
SCALARS = [
    ("int8_scalar", DataType.INT8, "i", -8),
    ("uint8_scalar", DataType.UINT8, "i", 255),
    ("int16_scalar", DataType.INT16, "i", -16),
    ("uint16_scalar", DataType.UINT16, "i", 65535),
    ("int32_scalar", DataType.INT32, "i", -32),
    ("uint32_scalar", DataType.UINT32, "i", 4294967295),
    ("int64_scalar", DataType.INT64, "i", -64),
    ("uint64_scalar", DataType.UINT64, "u", Decimal(18446744073709551615)),
    ("float32_scalar", DataType.FLOAT, "f", -3.14),
    ("float64_scalar", DataType.DOUBLE, "d", -3.1415926535),
    ("string_scalar", DataType.STRING, "s", "blub"),
]
SCALED = [
    (5, 3, 0, "child_0_0_1", [2, 3], [20.1, 20.2, 20.3, 21.1, 21.2, 21.3]),
    (7, 4, 1, "child_0_1_1", [2], [1013.25, 1012.5]),
]


def rows() -> list[tuple]:
    group = lambda i, parent, ordinal, name: (i, parent, ordinal, name, int(DataType.NONE), int(Compression.NONE), 1.0, 0.0, [], [], None)
    value = lambda field, v: tuple(v if f == field else None for f in "iufds")
    out = [group(0, None, 0, "root"), group(1, 0, 0, "child_0"), group(2, 0, 1, "all_types"), group(3, 1, 0, "child_0_0"), group(4, 1, 1, "child_0_1")]
    out += [(i, parent, ordinal, name, int(DataType.FLOAT_ARRAY), int(Compression.PFOR_DELTA_2D), 20.0, 0.0, dims, dims, None) for i, parent, ordinal, name, dims, _ in SCALED]
    out.append((6, 4, 0, "child_0_1_0", int(DataType.INT64), int(Compression.NONE), 1.0, 0.0, [], [], value("i", 42)))
    for k, (name, dtype, _) in enumerate(ARRAYS):
        xor = dtype in (DataType.FLOAT_ARRAY, DataType.DOUBLE_ARRAY)
        out.append((10 + k, 2, k, name, int(dtype), int(Compression.FPX_XOR_2D if xor else Compression.PFOR_DELTA_2D), 1.0, 0.0, [3], [3], None))
    out += [(30 + k, 2, len(ARRAYS) + k, name, int(dtype), int(Compression.NONE), 1.0, 0.0, [], [], value(field, v)) for k, (name, dtype, field, v) in enumerate(SCALARS)]
    return out


def nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), NODES)


def arrays(spark: SparkSession) -> dict[int, DataFrame]:
    """Cells of every array by node_id."""
    out = {}
    for i, _, _, _, dims, values in SCALED:
        if len(dims) == 2:
            cells = [(j // dims[1], j % dims[1], v) for j, v in enumerate(values)]
            out[i] = spark.createDataFrame(cells, "i0 bigint, i1 bigint, v float")
        else:
            out[i] = spark.createDataFrame(list(enumerate(values)), "i0 bigint, v float")
    for k, (_, dtype, values) in enumerate(ARRAYS):
        out[10 + k] = spark.createDataFrame(list(enumerate(values)), f"i0 bigint, v {dtype.spark.simpleString()}")
    return out
