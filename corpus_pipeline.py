"""A training corpus from raw documents in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ndspark.llm import langid, line_dedup, mixing, packing, simhash
from ndspark.llm.common import documents, drop_folder, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: A text stays if its language holds at least this part of its n-grams. Random letters come to 0.1 to 0.2; of sf0.01's documents, which also trained the filters, none is below 0.78.
LEAST_SHARE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which some language is found; lang becomes that language. Text that is null, has no letter, or whose language
    holds less than LEAST_SHARE of its n-grams (gibberish, languages that were not learned) goes.

    Without a single labelled row no language can be told: texts with a letter stay, and lang as it is.
    """
    model = langid.train(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = langid.detect(docs, model)
    return found.where((F.col("_lang") != "und") & (F.col("_share") >= LEAST_SHARE)).withColumn("lang", F.col("_lang")).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the first of them. Documents left without any word go, if lines were dropped."""
    found = line_dedup.line_dedup(docs.select(*COLUMNS))
    kept = found.where((F.col("_n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    return simhash.near_dedup(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mix(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of at most 2048 tokens; a document that was taken twice has its pieces twice."""
    found = packing.pack(docs)
    return found.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), F.col("sequence").alias("sequence_id"), "offset")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("mixing", mix),
    ("packing", pack),
]

#: The stages train models, walk tries and solve a dual: SQL can't express run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again, and a table goes when the next one stands."""
    docs, last = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(folder := shared_folder(spark, name))
        docs = spark.read.parquet(folder)
        if last:
            drop_folder(spark, last)
        last = folder
    return STAGES[-1][1](spark, docs, sf_dir)
