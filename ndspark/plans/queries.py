"""Queries over the driver's tables as arrays, with their SQL."""

from __future__ import annotations

import os
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, hashing
from ..operators import cache_sim, catalog, cells, io_plan
from ..sources.arrayfile import open_cached, write_file
from ..sources.bytes import BlockCachedSource, FileSource, LruBlockCache
from ..sources.store import open_store, scratch, write_store
from ..types import Compression, DataType, Range
from . import fixture

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(spark: SparkSession, sf_dir: str) -> int:
    """Rows of embeddings: a count that Parquet footers answer."""
    return table(spark, sf_dir, "embeddings").count()


def embeddings(spark: SparkSession, sf_dir: str, *ranges: tuple[int, int], shape: tuple[int, ...] = (64,)) -> DataFrame:
    """Cells of the embeddings as an array [n, *shape], one row a chunk."""
    df, n = table(spark, sf_dir, "embeddings"), rows_of(spark, sf_dir)
    chunks = df.select(F.col("vec_id").cast("bigint").alias("c0"), *[F.lit(0).cast("bigint").alias(f"c{d + 1}") for d in range(len(shape))], F.col("embedding").alias("values"))
    full = [Range(0, n), *[Range(0, s) for s in shape]]
    wanted = [Range(*r) if r else f for r, f in zip([*ranges, *[None] * len(full)], full)]
    return cells.read_cells(chunks, [n, *shape], [1, *shape], wanted)


UNNEST = "SELECT vec_id AS i0, d AS i1, embedding[d + 1] AS v FROM embeddings, (SELECT unnest(range({}, {})) AS d) AS u"


@query(UNNEST.format(4, 12) + " WHERE vec_id >= 10 AND vec_id < 70")
def slice_2d(spark, sf_dir):
    return embeddings(spark, sf_dir, (10, 70), (4, 12))


@query("SELECT o_orderkey AS i0, o_totalprice AS v FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200")
def slice_1d(spark, sf_dir):
    return cells.column_as_cells(table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice", Range(100, 200))


@query(UNNEST.format(0, 64))
def read_full_2d(spark, sf_dir):
    return embeddings(spark, sf_dir)


@query(UNNEST.format(9, 10) + " WHERE vec_id = 42")
def point_read(spark, sf_dir):
    return embeddings(spark, sf_dir, (42, 43), (9, 10))


@query(UNNEST.format(0, 64) + " WHERE vec_id = 42")
def row_read(spark, sf_dir):
    return embeddings(spark, sf_dir, (42, 43))


@query(UNNEST.format(9, 10))
def col_read(spark, sf_dir):
    return embeddings(spark, sf_dir, None, (9, 10))


@query("SELECT (i0 - 0) * 8 + (i1 - 4) AS lin, v FROM (" + UNNEST.format(4, 12) + " WHERE vec_id < 4) AS s")
def slice_flat_rowmajor(spark, sf_dir):
    ranges = [Range(0, 4), Range(4, 12)]
    one = cells.flat(embeddings(spark, sf_dir, (0, 4), (4, 12)), ranges)
    return one.select(F.posexplode("values").alias("lin", "v")).select(F.col("lin").cast("bigint").alias("lin"), "v")


@query("SELECT vec_id AS i0, d // 8 AS i1, d % 8 AS i2, embedding[d + 1] AS v FROM embeddings, (SELECT unnest(range(0, 64)) AS d) AS u WHERE vec_id >= 10 AND vec_id < 20 AND d // 8 >= 2 AND d // 8 < 5 AND d % 8 >= 1 AND d % 8 < 7")
def slice_3d(spark, sf_dir):
    return embeddings(spark, sf_dir, (10, 20), (2, 5), (1, 7), shape=(8, 8))


#: Stores that chunk_store wrote, by application and folder of tables.
STORES: dict[tuple[str, str], str] = {}


def chunk_store(spark: SparkSession, sf_dir: str):
    """The embeddings written as a store with chunks of 64 x 16, once an application, opened again."""
    if (app := (spark.sparkContext.applicationId, sf_dir)) in STORES:
        return open_store(spark, STORES[app]).find_by_path("/embedding")
    n, path = rows_of(spark, sf_dir), scratch(spark, "store")
    root = (0, None, 0, "root", 0, 4, 1.0, 0.0, [], [], None)
    array = (1, 0, 0, "embedding", int(DataType.FLOAT_ARRAY), 4, 1.0, 0.0, [n, 64], [64, 16], None)
    write_store(spark.createDataFrame([root, array], catalog.NODES), {1: embeddings(spark, sf_dir)}, path)
    STORES[app] = path
    return open_store(spark, path).find_by_path("/embedding")


@query(UNNEST.format(4, 40) + " WHERE vec_id >= 10 AND vec_id < 200")
def slice_chunked(spark, sf_dir):
    return chunk_store(spark, sf_dir).read(DataType.FLOAT_ARRAY, [(10, 200), (4, 40)])


def cached_file(path: str):
    """A task's source: the file through an LRU cache."""
    return BlockCachedSource(FileSource(path), LruBlockCache(), path)


#: Array files that file_slice wrote, by application and folder of tables.
FILES: dict[tuple[str, str], str] = {}


@query(UNNEST.format(4, 40) + " WHERE vec_id >= 10 AND vec_id < 200")
def file_slice(spark, sf_dir):
    """The embeddings as one array file with chunks of 64 x 16, written once an application; tasks read it through caches."""
    if (app := (spark.sparkContext.applicationId, sf_dir)) not in FILES:
        path = scratch(spark, "file").removeprefix("file:")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        n = rows_of(spark, sf_dir)
        node = (0, None, 0, "embedding", int(DataType.FLOAT_ARRAY), int(Compression.FPX_XOR_2D), 1.0, 0.0, [n, 64], [64, 16], None)
        write_file([node], {0: cells.to_chunks(embeddings(spark, sf_dir), [n, 64], [64, 16])}, path)
        FILES[app] = path
    opener = partial(cached_file, FILES[app])
    return open_cached(FileSource(FILES[app]), LruBlockCache(), FILES[app]).read(spark, opener, DataType.FLOAT_ARRAY, [(10, 200), (4, 40)])


@query("""SELECT a * 4 + b AS chunk_id, a AS c0, a * 64 AS lo0, least(64, n - a * 64) AS n0, b AS c1, b * 16 AS lo1, 16::BIGINT AS n1
FROM (SELECT count(*) AS n FROM embeddings) AS s, LATERAL (SELECT unnest(range(0, (n + 63) // 64)) AS a) AS t, (SELECT unnest(range(0, 4)) AS b) AS u""")
def chunk_grid(spark, sf_dir):
    return io_plan.chunk_grid(spark, [rows_of(spark, sf_dir), 64], [64, 16]).select("chunk_id", "c0", "lo0", "n0", "c1", "lo1", "n1")


@query("SELECT a * 4 + b AS chunk_id, a AS c0, b AS c1 FROM (SELECT unnest(range(0, 2)) AS a) AS t, (SELECT unnest(range(0, 1)) AS b) AS u")
def chunks_touched(spark, sf_dir):
    grid = io_plan.chunk_grid(spark, [rows_of(spark, sf_dir), 64], [64, 16])
    return io_plan.touched_chunks(grid, [64, 16], [Range(10, 70), Range(4, 12)]).select("chunk_id", "c0", "c1")


@query(UNNEST.format(4, 12) + " WHERE vec_id >= 10 AND vec_id < 70")
def split_concat(spark, sf_dir):
    a, b = io_plan.slice_parts([Range(10, 70), Range(4, 12)], [2, 1])
    cut = lambda part: embeddings(spark, sf_dir, *[(r.start, r.end) for r in part])
    return cut(a).unionByName(cut(b))


def _values() -> str:
    text = lambda x: "NULL" if x is None else f"'{x}'"
    out = []
    for i, parent, ordinal, name, dtype, compression, scale, offset, dims, chunks, scalar in fixture.rows():
        s = scalar or (None,) * 5
        out.append(f"({i}, {parent if parent is not None else 'NULL'}, {ordinal}, {text(name)}, {dtype}, {compression}, {scale}, {offset}, '{','.join(map(str, dims))}', '{','.join(map(str, chunks))}', {text(s[0])}, {text(s[1])}, {text(s[2])}, {text(s[3])}, {text(s[4])})")
    return "WITH RECURSIVE nodes(node_id, parent_id, ordinal, name, dtype, compression, scale_factor, add_offset, dims, chunk_dims, i, u, f, d, s) AS (VALUES " + ", ".join(out) + ") "


CATALOG = _values()


def joined(column: str):
    return F.array_join(F.col(column).cast("array<string>"), ",")


@query(CATALOG + "SELECT node_id::BIGINT AS node_id, dtype, compression, scale_factor::FLOAT AS scale_factor, add_offset::FLOAT AS add_offset, dims, chunk_dims, nullif(name, '') AS name FROM nodes")
def node_metadata(spark, sf_dir):
    return catalog.metadata(fixture.nodes(spark)).withColumn("dims", joined("dims")).withColumn("chunk_dims", joined("chunk_dims"))


@query(CATALOG + "SELECT n.node_id::BIGINT AS node_id, count(c.node_id) AS children FROM nodes n LEFT JOIN nodes c ON c.parent_id = n.node_id GROUP BY n.node_id")
def children_count(spark, sf_dir):
    return catalog.children_count(fixture.nodes(spark))


@query(CATALOG + "SELECT node_id::BIGINT AS node_id, name FROM nodes WHERE parent_id = 2 AND ordinal = 3")
def children_by_index(spark, sf_dir):
    return catalog.child(fixture.nodes(spark), 2, 3).select("node_id", "name")


@query(CATALOG + "SELECT node_id::BIGINT AS node_id, ordinal FROM nodes WHERE parent_id = 0 AND name = 'all_types'")
def child_by_name(spark, sf_dir):
    return catalog.child_by_name(fixture.nodes(spark), 0, "all_types").select("node_id", "ordinal")


@query(CATALOG + ", walk(node_id, path) AS (SELECT node_id, '' FROM nodes WHERE parent_id IS NULL UNION ALL SELECT n.node_id, w.path || '/' || n.name FROM walk w JOIN nodes n ON n.parent_id = w.node_id) SELECT node_id::BIGINT AS node_id, path FROM walk WHERE path <> ''")
def node_paths(spark, sf_dir):
    return catalog.with_paths(fixture.nodes(spark))


@query(CATALOG + "SELECT c.node_id::BIGINT AS node_id, c.name FROM nodes a JOIN nodes b ON b.parent_id = a.node_id JOIN nodes c ON c.parent_id = b.node_id WHERE a.name = 'child_0' AND b.name = 'child_0_1' AND c.name = 'child_0_1_1'")
def find_by_path(spark, sf_dir):
    return catalog.find_by_path(fixture.nodes(spark), 0, "//child_0/child_0_1//child_0_1_1/").select("node_id", "name")


TYPED = [(d.name.lower(), d) for _, d, _, _ in fixture.SCALARS]


@query(CATALOG + "SELECT node_id::BIGINT AS node_id, " + ", ".join(f"CASE WHEN dtype = {int(d)} THEN {dict(UINT64='u', FLOAT='f', DOUBLE='d', STRING='s').get(d.name, 'i')} END AS {n}" for n, d in TYPED if d not in (DataType.FLOAT, DataType.DOUBLE)) + " FROM nodes")
def scalar_typed(spark, sf_dir):
    return fixture.nodes(spark).select("node_id", *[catalog.scalar(d).cast("string").alias(n) for n, d in TYPED if d not in (DataType.FLOAT, DataType.DOUBLE)])


@query(CATALOG + "SELECT node_id::BIGINT AS node_id, CASE WHEN dtype = 9 THEN f::FLOAT END AS f, CASE WHEN dtype = 10 THEN d::DOUBLE END AS d FROM nodes")
def scalar_floats(spark, sf_dir):
    return fixture.nodes(spark).select("node_id", catalog.scalar(DataType.FLOAT).alias("f"), catalog.scalar(DataType.DOUBLE).alias("d"))


@query(CATALOG + "SELECT node_id::BIGINT AS node_id, NULL::INTEGER AS v FROM nodes WHERE name = 'string_scalar'")
def scalar_type_mismatch(spark, sf_dir):
    return fixture.nodes(spark).where("name = 'string_scalar'").select("node_id", catalog.scalar(DataType.INT32).alias("v"))


@query("""SELECT c_custkey, v & 255 AS u8, v & 65535 AS u16, v & 4294967295 AS u32,
CAST(CASE WHEN v < 0 THEN v::HUGEINT + 18446744073709551616 ELSE v::HUGEINT END AS DECIMAL(20, 0)) AS u64
FROM (SELECT c_custkey, 100 - c_custkey AS v FROM customer) AS s""")
def unsigned_widen(spark, sf_dir):
    v = 100 - F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", *[catalog.widened(v, b).alias(f"u{b}") for b in (8, 16, 32, 64)])


@query("SELECT o_orderkey, CAST(round_even(o_totalprice * 0.05::DOUBLE, 0) AS SMALLINT) AS q FROM orders WHERE abs(round_even(o_totalprice * 0.05::DOUBLE, 0)) <= 32767")
def codec_scale_int16(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", codec.scale_int16(F.col("o_totalprice"), 0.05).alias("q")).where("q IS NOT NULL")


@query("SELECT o_orderkey, CAST(round_even(o_totalprice * 100::DOUBLE, 0) AS BIGINT) AS q, CAST(round_even(o_totalprice * 100::DOUBLE, 0) AS BIGINT)::DOUBLE / 100::DOUBLE AS x FROM orders")
def codec_scale_wide(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", codec.scale_wide(F.col("o_totalprice"), 100.0).alias("q"))
    return df.withColumn("x", codec.unscale(F.col("q"), 100.0))


@query("SELECT event_id, CAST(round_even(log10(1 + abs(value)) * 1000::DOUBLE, 0) AS SMALLINT) AS q FROM events")
def codec_log10(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", codec.scale_log_int16(F.abs("value"), 1000.0).alias("q"))


QUANTISED = "SELECT o_orderkey, o_orderkey // 64 AS chunk, CAST(round_even(o_totalprice, 0) AS BIGINT) AS q FROM orders"


def quantised(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr("o_orderkey div 64").alias("chunk"), codec.scale_wide(F.col("o_totalprice"), 1.0).alias("q"))


@query(f"SELECT o_orderkey, q - coalesce(lag(q) OVER (PARTITION BY chunk ORDER BY o_orderkey), 0) AS d FROM ({QUANTISED}) AS s")
def codec_delta_encode(spark, sf_dir):
    return quantised(spark, sf_dir).select("o_orderkey", codec.delta(F.col("q"), ["chunk"], [], "o_orderkey").alias("d"))


@query(f"SELECT o_orderkey, q FROM ({QUANTISED}) AS s")
def codec_delta_roundtrip(spark, sf_dir):
    df = quantised(spark, sf_dir).withColumn("d", codec.delta(F.col("q"), ["chunk"], [], "o_orderkey"))
    return df.select("o_orderkey", codec.undelta(F.col("d"), ["chunk"], [], "o_orderkey").alias("q"))


@query("SELECT o_orderkey, bit_xor(o_custkey) OVER (PARTITION BY o_orderkey // 64 ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS x FROM orders")
def codec_xor_prefix(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.expr("o_orderkey div 64").alias("chunk"))
    return df.select("o_orderkey", codec.unxor(F.col("o_custkey"), ["chunk"], [], "o_orderkey").alias("x"))


@query("SELECT event_id, value FROM events")
def codec_xor_roundtrip(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", F.expr("event_id div 64").alias("chunk"), codec.double_bits("value").alias("b"))
    df = df.withColumn("x", codec.xor(F.col("b"), ["chunk"], [], "event_id"))
    return df.select("event_id", codec.bits_double(codec.unxor(F.col("x"), ["chunk"], [], "event_id")).alias("value"))


#: The embeddings as thousandths in chunks of 64 x 16: lanes are the rows of a chunk along the second dimension's order.
GRID = "SELECT vec_id, d, vec_id // 64 AS c0, d // 16 AS c1, CAST(round_even(embedding[d + 1]::DOUBLE * 1000::DOUBLE, 0) AS BIGINT) AS q FROM embeddings, (SELECT unnest(range(0, 64)) AS d) AS u"
LANES = (["c0", "c1"], ["d"], "vec_id")


def grid(spark, sf_dir):
    """Chunked integers in two dimensions; in each chunk, every column is a lane that runs down the rows."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("d", "v")).withColumn("d", F.col("d").cast("bigint"))
    return df.select("vec_id", "d", F.expr("vec_id div 64").alias("c0"), F.expr("d div 16").alias("c1"), codec.scale_wide(F.col("v").cast("double"), 1000.0).alias("q"))


@query(f"SELECT vec_id, d, q - coalesce(lag(q) OVER (PARTITION BY c0, c1, d ORDER BY vec_id), 0) AS diff FROM ({GRID}) AS s")
def codec_delta_2d(spark, sf_dir):
    return grid(spark, sf_dir).select("vec_id", "d", codec.delta(F.col("q"), *LANES).alias("diff"))


@query(f"SELECT vec_id, d, q FROM ({GRID}) AS s")
def codec_delta_2d_roundtrip(spark, sf_dir):
    df = grid(spark, sf_dir).withColumn("diff", codec.delta(F.col("q"), *LANES))
    return df.select("vec_id", "d", codec.undelta(F.col("diff"), *LANES).alias("q"))


@query(f"SELECT vec_id, d, xor(q, coalesce(lag(q) OVER (PARTITION BY c0, c1, d ORDER BY vec_id), 0)) AS x FROM ({GRID}) AS s")
def codec_xor_2d(spark, sf_dir):
    return grid(spark, sf_dir).select("vec_id", "d", codec.xor(F.col("q"), *LANES).alias("x"))


@query("SELECT vec_id, CAST(d AS BIGINT) AS d, embedding[d + 1] AS v FROM embeddings, (SELECT unnest(range(0, 64)) AS d) AS u")
def codec_xor_2d_roundtrip(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("d", "v"))
    df = df.select("vec_id", F.col("d").cast("bigint").alias("d"), F.expr("vec_id div 64").alias("c0"), F.expr("d div 16").cast("bigint").alias("c1"), codec.float_bits("v").alias("b"))
    df = df.withColumn("x", codec.xor(F.col("b"), *LANES))
    return df.select("vec_id", "d", codec.bits_float(codec.unxor(F.col("x"), *LANES).cast("int")).alias("v"))


#: Files of 1000 documents, laid out by n_chars; a header of doc_id % 7 thousand bytes is ahead of each document.
EXTENTS = """SELECT doc_id AS id, doc_id // 1000 AS file, n_chars AS size,
CAST(sum(n_chars + doc_id % 7 * 1000) OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id) AS BIGINT) - n_chars AS off,
CAST(sum(n_chars + doc_id % 7 * 1000) OVER (PARTITION BY doc_id // 1000) AS BIGINT) AS file_size FROM documents WHERE n_chars > 0"""


def extents(spark, sf_dir):
    from pyspark.sql import Window

    df = table(spark, sf_dir, "documents").where("n_chars > 0").select(F.col("doc_id").alias("id"), F.expr("doc_id div 1000").alias("file"), F.col("n_chars").alias("size"))
    w, both = Window.partitionBy("file"), F.col("size") + F.col("id") % 7 * 1000
    return df.withColumn("off", F.sum(both).over(w.orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")).withColumn("file_size", F.sum(both).over(w))


@query(f"SELECT id, block, greatest(0, file_size - (block + 1) * 65536) AS block_start, file_size - block * 65536 AS block_end FROM (SELECT *, unnest(range((file_size - off - size) // 65536, (file_size - off - 1) // 65536 + 1)) AS block FROM ({EXTENTS}) AS e) AS b")
def block_cover(spark, sf_dir):
    return io_plan.block_cover(extents(spark, sf_dir), 65536)


COALESCED = f"""WITH e AS (SELECT * FROM ({EXTENTS}) AS x),
p AS (SELECT *, max(off + size) OVER (PARTITION BY file ORDER BY off, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM e),
g AS (SELECT *, sum(CASE WHEN off - prev <= 2048 THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY off, size ROWS UNBOUNDED PRECEDING) AS r FROM p),
c AS (SELECT file, min(off) AS start, max(off + size) AS "end", count(*) AS extents FROM g GROUP BY file, r) """


@query(COALESCED + 'SELECT file, start, "end", extents FROM c')
def io_coalesce(spark, sf_dir):
    return io_plan.coalesce_reads(extents(spark, sf_dir), 2048)


@query(COALESCED + 'SELECT file, extents, s AS start, least("end", s + 65536) AS "end" FROM (SELECT *, unnest(range(start, "end", 65536)) AS s FROM c) AS x')
def io_split(spark, sf_dir):
    return io_plan.split_reads(io_plan.coalesce_reads(extents(spark, sf_dir), 2048), 65536)


@query("""WITH a AS (SELECT event_id AS t, user_id AS k, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS pt FROM events),
n AS (SELECT a.t, count(DISTINCT b.k) AS n FROM a JOIN a AS b ON b.t > a.pt AND b.t < a.t GROUP BY a.t)
SELECT a.t, a.k, a.pt IS NOT NULL AND coalesce(n.n, 0) < 64 AS hit FROM a LEFT JOIN n ON n.t = a.t""")
def lru_hits(spark, sf_dir):
    return cache_sim.lru_hits(table(spark, sf_dir, "events"), "user_id", "event_id", 64)


MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


@query("""SELECT key, evicted FROM (SELECT event_id AS key, total > 60000 AND total - before > 60000 * 0.9::DOUBLE AS evicted FROM (
SELECT event_id, sum(size) OVER (PARTITION BY event_type) AS total,
coalesce(sum(size) OVER (PARTITION BY event_type ORDER BY epoch_us(ts), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
FROM (SELECT *, 100 + event_id % 50 AS size FROM events) AS e) AS w) AS x""")
def cache_evict_fifo(spark, sf_dir):
    entries = table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), (100 + F.col("event_id") % 50).alias("size"), F.expr(MICROS).alias("created_at"), "event_type")
    return cache_sim.evict_fifo(entries, 60000, 0.1, "event_type").select("key", "evicted")


TTL = """SELECT event_id, user_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) <= 3600000000, false) AS hit,
length(event_type) AS size FROM events"""


def ttl(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("event_id", "user_id", F.expr(MICROS).alias("us"), F.length("event_type").cast("bigint").alias("size"))
    return cache_sim.ttl_hits(log, "user_id", "us", 3_600_000_000, "event_id")


@query(f"SELECT event_id, user_id, hit FROM ({TTL}) AS s")
def cache_ttl_hits(spark, sf_dir):
    return ttl(spark, sf_dir).select("event_id", "user_id", "hit")


@query(f"SELECT count(*) AS requests, CAST(sum(hit::INT) AS BIGINT) AS hits, CAST(sum(1 - hit::INT) AS BIGINT) AS misses, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(hit::INT * size) AS BIGINT) AS hit_bytes FROM ({TTL}) AS s")
def cache_stats(spark, sf_dir):
    return cache_sim.stats(ttl(spark, sf_dir), "hit", "size")


@query("SELECT DISTINCT epoch_us(ts) // 60000000 AS minute, user_id FROM events")
def single_flight(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", F.expr(f"{MICROS} div 60000000").alias("minute"))
    return cache_sim.single_flight(log, "user_id", "minute")


def fnv_sql(column: str) -> str:
    return f"list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split({column}, ''), lambda c: ascii(c)::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"


@query(f"SELECT c_custkey, CAST({fnv_sql('c_name')} AS VARCHAR) AS h FROM customer")
def fnv1a_hash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", hashing.fnv1a64("c_name").alias("h"))


@query(f"SELECT c_custkey, CAST(xor({fnv_sql('c_name')}, {fnv_sql('c_mktsegment')}) AS VARCHAR) AS h FROM customer")
def cache_key(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", hashing.fnv1a64_xor("c_name", "c_mktsegment").alias("h"))


@query("SELECT p_partkey, 'parts' || '/block/' || p_partkey AS key FROM part")
def block_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/block/", F.lit("parts"), F.col("p_partkey").cast("string")).alias("key"))


@query("SELECT a AS attempt, CAST(least(500 * pow(2, a), 5000) AS BIGINT) AS wait_ms FROM (SELECT unnest(range(0, 10)) AS a) AS t")
def retry_backoff(spark, sf_dir):
    return spark.range(10).select(F.col("id").alias("attempt"), io_plan.backoff(F.col("id")).alias("wait_ms"))


@query("SELECT event_id, event_id // 10 AS batch FROM events")
def batch_plan(spark, sf_dir):
    return io_plan.batches(table(spark, sf_dir, "events").select("event_id"), "event_id", 10)
