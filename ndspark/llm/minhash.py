"""Links of texts by the Jaccard similarity of their word shingles: MinHash buckets propose, whole sets decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, partitions, stored
from .simhash import components, majority, shingle_hashes

#: A pair of similarity s meets in one of BANDS buckets unless all differ: (1 - s ** ROWS) ** BANDS, 6e-4 at 0.8.
BANDS, ROWS = 40, 8
_RND = np.random.default_rng(42)
MULTIPLY = _RND.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
ADD = _RND.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
#: Mixes the minima of a band, and the number of the band, to its key.
MIX = _RND.integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
#: What a task compares at a time: two slices of about so many texts and shingles at most.
TEXTS, SHINGLES = 2048, 1_000_000


def shingles(text: bytes, words: int) -> np.ndarray:
    """The distinct hashes of the shingles, sorted."""
    return np.unique(shingle_hashes(text, words).astype(np.uint64))


def band_keys(found: np.ndarray) -> np.ndarray:
    h = (found >> np.uint64(32)).astype(np.uint32)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(h), 1024):
        x = np.multiply.outer(MULTIPLY, h[i : i + 1024])
        x += ADD[:, None]
        np.minimum(low, x.min(1), out=low)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part, m in zip(low.reshape(BANDS, ROWS).T, MIX):
        key = (key ^ part) * m
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def signatures(batches, words: int):
    """row, text -> row, fp (the fingerprint), whole (a hash of the set), keys; no keys for texts without a word."""
    for batch in batches:
        for part in (batch.slice(i, 512) for i in range(0, len(batch), 512)):
            prints, whole, keys, sizes = [], [], [], [0]
            for text in part.column(1).cast(pa.binary()):
                hashes = shingle_hashes(text.as_py() or b"", words)
                found = np.unique(hashes.astype(np.uint64))
                prints.append(majority(hashes))
                whole.append(xxhash.xxh64_intdigest(found.tobytes()))
                if len(found):
                    keys.append(band_keys(found))
                sizes.append(BANDS * len(keys))
            listed = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([*keys, np.empty(0, np.int64)])))
            fp = np.frombuffer(b"".join(prints), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp), pa.array(np.array(whole, np.uint64).view(np.int64)), listed], names=["row", "fp", "whole", "keys"])


def signed_rows(df: DataFrame, row_col: str, text_col: str, words: int) -> DataFrame:
    """row, fp, whole, keys of every row, kept as a table: one pass over the texts for all that compares them."""
    text = df.select(F.col(row_col).alias("row"), F.col(text_col).alias("text"))
    return stored(text.mapInArrow(lambda it: signatures(it, words), "row bigint, fp bigint, whole bigint, keys array<bigint>"))


def bucket_stars(batches):
    """Rows (key, row), sorted -> a, b: each row of a bucket and the least one. Holds one row at a time, so a bucket may be large."""
    last = None
    for batch in batches:
        key, row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        if last is not None:
            key, row = np.concatenate([last[0], key]), np.concatenate([last[1], row])
        first = np.concatenate([[True], key[1:] != key[:-1]])
        head = row[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
        more = row != head
        yield pa.RecordBatch.from_arrays([pa.array(row[more]), pa.array(head[more])], names=["a", "b"])
        last = key[-1:], head[-1:]


def sets(batches, words: int):
    """Adds the set of shingles, 8 bytes each, in place of the text, which is the last column."""
    for batch in batches:
        for i in range(0, len(batch), 64):
            part = batch.slice(i, 64)
            found = pa.array([shingles(x.as_py() or b"", words).tobytes() for x in part.column(part.num_columns - 1).cast(pa.binary())], pa.binary())
            size = pa.array([len(x.as_py()) // 8 for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], found, size], names=[*part.schema.names[:-1], "found", "size"])


def similar(rows: np.ndarray, found: list[np.ndarray], least: float, label: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest row of its class) for the classes that pairs of a similarity of `least` or more form.

    The first `first` texts are compared with all that follow them. `label` has the classes that are known
    (a text's class is the position of one of its members); texts that are in one class already are not compared.
    """
    size = np.array([len(x) for x in found])
    start = np.concatenate([[0], np.cumsum(size)])
    words, code = np.unique(np.concatenate(found), return_inverse=True)
    mark = np.zeros(len(words), bool)
    for i in range(min(first, len(rows) - 1)):
        # beyond this ratio of sizes no pair can be that similar
        open_ = (label[i + 1 :] != label[i]) & (np.minimum(size[i + 1 :], size[i]) >= least * np.maximum(size[i + 1 :], size[i]) - 1e-9)
        others = np.flatnonzero(open_) + i + 1
        if not len(others):
            continue
        mark[code[start[i] : start[i + 1]]] = True
        if 4 * size[others].sum() > start[-1] - start[i + 1]:
            both = np.add.reduceat(mark[code[start[i + 1] :]], start[i + 1 : -1] - start[i + 1], dtype=np.int64)[others - i - 1]
        else:
            both = np.array([np.count_nonzero(mark[code[start[j] : start[j + 1]]]) for j in others])
        mark[code[start[i] : start[i + 1]]] = False
        for j in others[both >= least * (size[i] + size[others] - both) - 1e-9].tolist():
            if (p := label[i]) != (q := label[j]):
                label[label == max(p, q)] = min(p, q)
    low = np.full(len(rows), np.iinfo(np.int64).max)
    np.minimum.at(low, label, rows)
    low = low[label]
    return rows[low != rows], low[low != rows]


def in_group(table: pa.Table, least: float) -> pa.Table:
    """Texts that are not like their root (side 0) against a slice of its component (side 1). Those that are like it are one class, under its number."""
    table = table.sort_by([("side", "ascending"), ("row", "ascending")])
    core = table["core"].to_numpy()
    rows = np.where(core, table["root"][0].as_py(), table["row"].to_numpy())
    found = [np.frombuffer(x, np.uint64) for x in table["found"].to_pylist()]
    label = np.where(core, np.argmax(core), np.arange(len(rows)))
    a, b = similar(rows, found, least, label, int(np.count_nonzero(table["side"].to_numpy() == 0)))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def like_root(batches, least: float):
    """Rows with found and head (the root's set) -> with core in place of head: whether both are similar."""
    for batch in batches:
        core = []
        for x, y in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= least * max(len(x), len(y)) - 1e-9 else 0
            core.append(both >= least * (len(x) + len(y) - both) - 1e-9)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(core, pa.bool_())], names=[*batch.schema.names[:-1], "core"])


def jaccard_links(df: DataFrame, signed: DataFrame, row_col: str, text_col: str, words: int = 5, least: float = 0.8, texts: int = TEXTS) -> DataFrame:
    """a, b: enough links (a > b) for the components of the rows whose sets of shingles have at least this similarity.

    signed is what signed_rows gives for df. Rows of equal sets are linked to the first of them, and only
    that goes on. What meets in a bucket is a candidate; the texts of a component of candidates are
    compared by their whole sets: first each with the component's root, dealt out in slices of about
    `texts` texts that get a copy of the root, so copies of one text take time in proportion to their
    number. Only the texts that are not like their root, if there are any, then meet all others of the
    component, slice by slice: nothing is dropped.
    """
    text = df.select(F.col(row_col).alias("row"), F.col(text_col).alias("text"))
    total = signed.count()
    reps = stored(signed.groupBy("whole").agg(F.min(F.struct("row", "keys")).alias("x"), F.count(F.lit(1)).alias("w")).select("whole", "x.row", "x.keys", "w"))
    equal = lookup(signed.select("row", "whole"), reps.select("whole", F.col("row").alias("b"), "w"), ["whole"], "w", total, F.xxhash64("row"))
    equal = equal.where("row <> b").select(F.col("row").alias("a"), "b")
    dealt = reps.select(F.explode("keys").alias("key"), "row").repartition(partitions(df.sparkSession), "key").sortWithinPartitions("key", "row")
    near = components(dealt.mapInArrow(bucket_stars, "a bigint, b bigint"))
    members = stored(near.unionByName(near.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "row"))
    held = text.join(members, "row").select("row", "root", "text").mapInArrow(lambda it: sets(it, words), "row bigint, root bigint, found binary, size bigint")
    held = stored(held)
    slices = lambda n, size: F.greatest(F.ceil(n / texts), F.ceil(size / SHINGLES), F.lit(1)).cast("int")
    counts = held.groupBy("root").agg(slices(F.count(F.lit(1)), F.sum("size")).alias("slices"), F.count(F.lit(1)).alias("w"))
    cut = lookup(held, stored(counts), ["root"], "w", held.count(), F.xxhash64("row")).withColumn("slice", F.pmod(F.xxhash64("row"), F.col("slices")).cast("int"))
    heads = cut.where("row = root").select("root", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("found").alias("head"))
    told = cut.where("row <> root").join(heads, ["root", "slice"]).select("row", "root", "slice", "slices", "size", "found", "head")
    told = stored(told.mapInArrow(lambda it: like_root(it, least), "row bigint, root bigint, slice int, slices int, size bigint, found binary, core boolean"))
    like = told.where("core").select(F.col("row").alias("a"), F.col("root").alias("b"))
    # a single text besides its root has met all others
    open_ = told.groupBy("root").agg(F.sum((~F.col("core")).cast("bigint")).alias("rest"), F.sum(F.when(~F.col("core"), F.col("size"))).alias("rest_size"), F.count(F.lit(1)).alias("w"))
    open_ = stored(open_.where("rest > 0 AND w > 1").select("root", slices(F.col("rest"), F.col("rest_size")).alias("parts"), "w"))
    if open_.isEmpty():
        return equal.unionByName(like)
    left = lookup(told, open_, ["root"], "w", max(1, told.count()), F.xxhash64("row")).where("parts IS NOT NULL")
    part = F.pmod(F.xxhash64("row", F.lit(1)), F.col("parts")).cast("int")
    rest = left.where("NOT core").select("root", part.alias("i"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("j"), F.lit(0).alias("side"), "row", "core", "found")
    every = left.select("root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.col("slice").alias("j"), F.lit(1).alias("side"), "row", "core", "found")
    groups = rest.unionByName(every).repartition(partitions(df.sparkSession), "root", "i", "j").groupBy("root", "i", "j")
    return equal.unionByName(like).unionByName(groups.applyInArrow(lambda t: in_group(t, least), "a bigint, b bigint"))
