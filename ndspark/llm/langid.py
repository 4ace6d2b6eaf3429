"""Language identification by n-gram filters that hold a bitmask of languages."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, documents

ORDERS = (2, 3, 4)
MIX = np.uint64(0x9E3779B97F4A7C15)


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its lower case, and whether it is a letter."""
    points = range(sys.maxunicode + 1)
    lower = np.fromiter((ord(y) if len(y := chr(i).lower()) == 1 else i for i in points), np.uint32, len(points))
    letter = np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in points), bool, len(points))
    return lower, letter


def grams(text: str) -> np.ndarray | None:
    """Hashes of the character n-grams of the whole text: letters in lower case, all else one blank; None without a letter."""
    lower, letter = tables()
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    known = letter[points]
    if not known.any():
        return None
    points = np.where(known, lower[points], np.uint32(32))
    points = points[np.concatenate([[True], known[1:] | known[:-1]])]
    points = np.concatenate([[32], points, [32]]).astype(np.uint64)
    out, h = [], points
    for n in range(2, max(ORDERS) + 1):
        h = (h[:-1] * MIX) ^ (h[:-1] >> np.uint64(29)) ^ points[n - 1 :] if len(h) > 1 else h[:0]
        if n in ORDERS:
            out.append((h ^ (h >> np.uint64(32))) * MIX + np.uint64(n))
    return np.concatenate(out)


class Filters:
    """Bit-sliced Bloom filters: slot i holds one bit a language, so one lookup answers for all of them."""

    def __init__(self, languages: list[str], sets: list[np.ndarray], hashes: int = 3, slots_per_gram: int = 16):
        self.languages, self.hashes = languages, hashes
        self.slots = 1 << int(np.ceil(np.log2(max(64, slots_per_gram * sum(map(len, sets))))))
        self.words = -(-len(languages) // 8)  # bytes of a mask
        self.table = np.zeros((self.words, self.slots), np.uint8)
        for i, found in enumerate(sets):
            for at in self.places(found):
                self.table[i // 8, at] |= np.uint8(1 << i % 8)
        bits = np.unpackbits(self.table, axis=0, bitorder="little")[: len(languages)] if languages else np.zeros((0, self.slots))
        #: chance that a gram in no set seems to be in the language's
        self.false = bits.mean(1) ** hashes

    def places(self, h: np.ndarray) -> list[np.ndarray]:
        step = (h >> np.uint64(17)) | np.uint64(1)
        return [((h + np.uint64(k) * step) & np.uint64(self.slots - 1)).astype(np.int64) for k in range(self.hashes)]

    def shares(self, h: np.ndarray) -> np.ndarray:
        """For each language the part of the grams it holds, corrected for false positives."""
        counts, at = [], self.places(h)
        for row in self.table:
            mask = row[at[0]]
            for x in at[1:]:
                mask = mask & row[x]
            counts.append(np.bincount(mask, minlength=256) @ BITS_OF)
        part = np.concatenate(counts)[: len(self.languages)] / max(1, len(h))
        return np.clip((part - self.false) / (1 - self.false), 0, 1)

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, and the part of the text's grams that the language holds; `und`, 0, 0 if text is null or has no letter. Ties: the first in order."""
        h = grams(text) if text else None
        if h is None or not self.languages:
            return "und", 0.0, 0.0
        part = self.shares(h)
        best = int(part.argmax())
        second = np.delete(part, best).max(initial=0.0)
        return self.languages[best], float(part[best] / (part[best] + second)) if part[best] else 0.0, float(part[best])

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score."""
        return self.judge(text)[:2]


#: Bits of each byte value.
BITS_OF = (np.arange(256)[:, None] >> np.arange(8)) & 1


def doc_grams(batches):
    """(lang, text) -> lang, gram, docs: in how many documents of the batch each gram is."""
    for batch in batches:
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            h = grams(text.as_py() or "")
            if h is not None:
                by.setdefault(lang, []).append(np.unique(h))
        for lang, found in by.items():
            gram, docs = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram.astype(np.int64)), pa.array(docs)], names=["lang", "gram", "docs"])


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_docs: int = 2000, least_part: float = 0.02) -> Filters:
    """Filters of the labelled rows of df.

    Of each language about `most_docs` documents are used, chosen by a hash of the identifier; grams in
    fewer than `least_part` of them are left out, so a language has at most (grams of a document) /
    least_part. Rows with null language or no letter teach nothing.
    """
    known = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    rows = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not rows:
        return Filters([], [])
    part = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 20)) / float(1 << 20)
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in rows.items() for x in (lang, min(1.0, most_docs / n))]), F.col("lang"))
    sample = known.where(part < share)
    counts = sample.select("lang", "text").mapInArrow(doc_grams, "lang string, gram bigint, docs bigint").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
    least = F.element_at(F.create_map(*[F.lit(x) for lang, n in rows.items() for x in (lang, max(1.0, least_part * min(n, most_docs)))]), F.col("lang"))
    found = counts.where(F.col("docs") >= least).toPandas()
    languages = sorted(rows)
    return Filters(languages, [found["gram"][found["lang"] == lang].to_numpy(np.int64).astype(np.uint64) for lang in languages])


def detect(df: DataFrame, model: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of df with _lang, _score and _share (see Filters.judge). One row each row; null text or text without a letter is `und`, score 0, share 0."""
    held = df.sparkSession.sparkContext.broadcast(model)  # its size is bounded by train's parameters
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            found = [held.value.judge(x.as_py()) for x in batch.column(at)]
            new = [pa.array([x[0] for x in found], pa.string()), *[pa.array([x[k] for x in found], pa.float64()) for k in (1, 2)]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "_lang", "_score", "_share"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([*df.schema.fields]).add("_lang", StringType()).add("_score", DoubleType()).add("_share", DoubleType())
    return df.mapInArrow(run, schema)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_mod("doc_id", 3) == 1
    model = train(docs.where(~held_out))
    found = detect(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
