"""Toxicity scores from non-negative positive-unlabelled learning."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, documents, materialize

WORD = re.compile(r"\w+")
#: Words count as features whole and by their first letters.
STEMS = (4, 5, 6, 7)


def features(text: str) -> set[str]:
    """Words of the whole text in lower case, and their beginnings, marked with *."""
    words = set(WORD.findall(text.lower()))
    return words.union(*[{w[:n] + "*" for w in words if len(w) > n} for n in STEMS])


def doc_features(batches):
    """(positive, text) -> feature, p, u: in how many positive and unlabelled documents of the batch each is."""
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for positive, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for f in features(text.as_py()):
                counts.setdefault(f, [0, 0])[not positive] += 1
        p, u = zip(*counts.values()) if counts else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(p, pa.int64()), pa.array(u, pa.int64())], names=["feature", "p", "u"])


class Model:
    """Linear classifier over the presence of features; scores any text, the empty one too."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: float):
        self.bias = float(bias)
        split = [{}, *({} for _ in STEMS)]
        for name, w in zip(names, weights.tolist()):
            (split[1 + STEMS.index(len(name) - 1)] if name.endswith("*") else split[0])[name.rstrip("*")] = w
        self.words, self.stems = split[0], list(zip(STEMS, split[1:]))

    def score(self, text: str | None) -> float:
        words = set(WORD.findall((text or "").lower()))
        total = self.bias + sum(self.words[w] for w in words & self.words.keys())
        for n, known in self.stems:
            if known:
                total += sum(known[s] for s in {w[:n] for w in words if len(w) > n} & known.keys())
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def fit(rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, n_features: int, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk with the logistic loss.

    risk = prior R_p(+) + max(0, R_u(-) - prior R_p(-)): the unlabelled rows are a mixture, from whose
    negative risk the part of the positives is taken away; where that would be below zero (overfitting)
    the step goes the other way, on that part alone.
    """
    n = len(positive)
    p, u = positive, ~positive
    np_, nu = max(1, p.sum()), max(1, u.sum())
    w, b = np.zeros(n_features), np.log(prior / (1 - prior))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(rows, w[cols], n)
        s = 1 / (1 + np.exp(-z))
        loss = np.logaddexp(0, z)  # of calling a row negative
        rest = loss[u].sum() / nu - prior * loss[p].sum() / np_
        away = np.where(p, -prior * s / np_, s / nu)
        g = np.where(p, prior * (s - 1) / np_, 0) + away if rest >= 0 else -away
        grad = np.append(np.bincount(cols, g[rows], n_features) + decay * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = 4000, unlabelled: int = 12000, most: int = 5000, least: int = 3) -> Model:
    """Model from the labelled rows with label 1 and from all rows as unlabelled.

    About `positives` and `unlabelled` documents are used, chosen by a hash of the identifier. The class
    prior is the part of label 1 in the labels. Features in at least `least` positive documents of the
    sample compete by the z-score of their two frequencies; at most `most` are used. Null texts and
    null labels teach nothing; without any positive row every score is the prior's (0 if there is none).
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) == 1).alias("positive"))
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("positive").cast("long")).alias("p")).first()
    n, p = counts.n, counts.p or 0
    if p == 0:
        return Model([], np.zeros(0), -30.0)
    prior = min(max(p / n, 1e-4), 0.9)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    part = F.pmod(F.xxhash64("id", F.lit(8)), F.lit(1 << 20)) / float(1 << 20)
    some_p = known.where("positive").where(part < positives / p).select("id")
    some_u = rows.where(part < unlabelled / max(1, rows.count()))
    # the sample is bounded by its two parameters: its identifiers can be broadcast and its texts kept
    sample = rows.join(F.broadcast(some_p), "id").select("id", F.lit(True).alias("positive"), "text").unionByName(some_u.select("id", F.lit(False).alias("positive"), "text"))
    sample = materialize(sample.select("positive", "text"))
    found = sample.mapInArrow(doc_features, "feature string, p bigint, u bigint").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where(F.col("p") >= least)
    sizes = sample.groupBy("positive").count().collect()
    size = {r.positive: float(r["count"]) for r in sizes}
    a, b = F.col("p") / size.get(True, 1.0), F.col("u") / size.get(False, 1.0)
    spread = F.sqrt(a * (1 - a) / size.get(True, 1.0) + b * (1 - b) / size.get(False, 1.0) + 1e-9)
    best = found.select("feature", ((a - b) / spread).alias("z")).where("z > 3").orderBy(F.desc("z"), "feature").limit(most).toPandas()
    names = best["feature"].tolist()
    held = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def indexed(batches):
        for batch in batches:
            at = held.value
            found = [sorted(at[f] for f in features(x.as_py()) & at.keys()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["positive", "at"])

    table: pd.DataFrame = sample.mapInArrow(indexed, "positive boolean, at array<int>").toPandas()
    cols = np.concatenate([np.zeros(0, np.int64), *table["at"]]).astype(np.int64)
    row = np.repeat(np.arange(len(table)), table["at"].map(len))
    w, bias = fit(row, cols, table["positive"].to_numpy(bool), len(names), prior)
    return Model(names, w, bias)


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of df with _score (0 to 1). Null text counts as empty."""
    from pyspark.sql.types import DoubleType, StructType

    held = df.sparkSession.sparkContext.broadcast(model)  # at most `most` features
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            found = pa.array([held.value.score(x.as_py()) for x in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "_score"])

    return df.mapInArrow(run, StructType([*df.schema.fields]).add("_score", DoubleType()))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = crc_mod("doc_id", 5) == 0
    model = train(docs.where(~held_out), labels.where(~held_out))
    found = score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), F.col("_score").alias("score"), F.when(F.col("_score") >= 0.5, 1).otherwise(0).alias("predicted"))
