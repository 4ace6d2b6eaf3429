"""Line deduplication: lines that several documents share stay in one of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lookup, materialize, whole

BLANK = b" \t\n\x0b\x0c\r"


def line_keys(batches, min_chars: int):
    """(id, th, text) -> one row a line that may be dropped: id, th, pos, k1, k2 (128 bits of XXH3 of its key)."""
    for batch in batches:
        at, pos, digests = [], [], []
        for i, text in enumerate(batch.column(2).cast(pa.binary())):
            for j, line in enumerate((text.as_py() or b"").split(b"\n")):
                key = line.strip(BLANK).lower()  # of bytes: A-Z only
                if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars):
                    at.append(i)
                    pos.append(j)
                    digests.append(xxhash.xxh3_128_digest(key))
        halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        at = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(pos, pa.int32()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], names=["id", "th", "pos", "k1", "k2"])


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Drop lines whose key at least min_docs documents hold, but for those of the smallest identifier.

    A key is the line without ASCII white space at its ends and with A-Z in lower case; keys shorter
    than min_chars code points stay everywhere. Lines are exploded to 128-bit hashes, documents are
    counted per hash, the positions to drop go back to the document and the others are joined again in
    their order. Only hashes are shuffled by line, and frequent ones are dealt out (see lookup); whole
    texts move once, by document.

    Returns all columns of df, the text replaced, with _n_lines and _n_dropped.
    Null or empty text is one empty line; null stays null. Rows that share an identifier are one
    document. Rows with a null identifier take no part and stay whole. An empty table gives no row.
    """
    kind = df.schema[id_col].dataType.simpleString()
    slim = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    lines = materialize(slim.mapInArrow(lambda it: line_keys(it, min_chars), f"id {kind}, th bigint, pos int, k1 bigint, k2 bigint"))
    counts = lines.groupBy("k1", "k2", "id").agg(F.count(F.lit(1)).alias("c")).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("docs"), F.min("id").alias("keep"), F.sum("c").alias("rows"))
    shared = materialize(counts.where(F.col("docs") >= min_docs).drop("docs"))
    found = lookup(lines, shared, ["k1", "k2"], "rows", lines.count(), F.xxhash64("id"))
    drops = found.where(F.col("keep").isNotNull() & (F.col("keep") != F.col("id"))).groupBy("id", "th").agg(F.collect_set("pos").alias("_drops"))
    drops = drops.select(F.col("id").alias("_drop_id"), F.col("th").alias("_drop_th"), "_drops")
    left = df.withColumn("_th", F.xxhash64(text_col))
    both = left.join(drops, (left[id_col] == F.col("_drop_id")) & (F.col("_th") == F.col("_drop_th")), "left")
    parts = F.split(whole(text_col), "\n", -1)
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "_drops"), lambda p: F.get(parts, p)), "\n")
    n = F.octet_length(whole(text_col)) - F.octet_length(F.replace(whole(text_col), F.lit("\n"), F.lit(""))) + 1
    both = both.withColumn("_n_lines", n.cast("bigint")).withColumn("_n_dropped", F.when(F.col("_drops").isNull(), 0).otherwise(F.size("_drops")).cast("bigint"))
    both = both.withColumn(text_col, F.when(F.col("_drops").isNull(), F.col(text_col)).otherwise(kept))
    return both.select(*df.columns, "_n_lines", "_n_dropped")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(whole("text"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT doc_id, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS pos FROM d),
k AS (SELECT doc_id, line, pos, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS keep FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.line, k.pos, s.keep IS NOT NULL AND s.keep <> k.doc_id AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
