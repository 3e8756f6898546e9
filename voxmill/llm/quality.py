"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.llm import common

#: Random features, ridge penalty for each training row, and the grid on which raw scores are counted for calibration.
FEATURES, RIDGE, GRID, SEED = 256, 1e-4, 1000, 11
#: Rows whose normal equations one task sums.
ROWS_PER_TASK = 200_000

#: Kinds of bytes whose shares are statistics; those of non-ASCII letters tell a lead from a continuation byte.
_KINDS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n", b".", b",", b"!?", b"|", b"-:;'\"()", bytes(range(192, 256)), bytes(range(128, 192)))
_KIND_OF = np.full(256, len(_KINDS), np.uint8)
for _k, _bytes in enumerate(_KINDS):
    _KIND_OF[list(_bytes)] = _k
STATISTICS = len(_KINDS) + 1 + 10


def statistics(text: bytes) -> list[float]:
    """Statistics of one whole text, none of which depends on its language: shares of kinds of bytes, words and lines."""
    size = len(text)
    shares = np.bincount(_KIND_OF[np.frombuffer(text, np.uint8)], minlength=len(_KINDS) + 1) / max(size, 1)
    words, lines = text.split(), text.split(b"\n")
    n, distinct = len(words), len(set(words))
    inner = sum(map(len, words))
    return [
        *shares.tolist(),
        math.log1p(n),
        math.log1p(size),
        inner / max(n, 1),
        distinct / max(n, 1),
        math.log1p(distinct) / math.log1p(max(n, 1)),
        sum(map(operator.eq, words, words[1:])) / max(n, 1),
        math.log1p(max(map(len, words), default=0)),
        len(lines) / max(n, 1),
        len(set(lines)) / len(lines),
        math.log1p(max(map(len, lines))),
    ]


def _bytes_of(texts: pd.Series) -> list[bytes]:
    return [b"" if x is None else x.encode() for x in texts]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, x)`` of every document: its statistics as an array. Null text counts as empty."""
    schema = docs.select(id_col).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            rows = pa.array([statistics(t or b"") for t in texts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], names=[id_col, "x"])

    return docs.select(id_col, text_col).mapInArrow(run, schema.add("x", T.ArrayType(T.DoubleType())))


@dataclass(frozen=True)
class Model:
    """What scoring needs: a few arrays whose size is fixed by ``FEATURES`` and ``STATISTICS``."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    levels: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        """The ridge score of rows of statistics."""
        return fourier((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """The calibrated score, from 0 to 1."""
        return np.interp(self.raw(x), self.steps, self.levels)


def fourier(z: np.ndarray) -> np.ndarray:
    """Random Fourier features of a Gaussian kernel over standardised statistics, and a constant."""
    draw = np.random.default_rng(SEED)
    w = draw.normal(scale=1 / math.sqrt(STATISTICS), size=(STATISTICS, FEATURES))
    b = draw.uniform(0, 2 * math.pi, FEATURES)
    return np.hstack([math.sqrt(2 / FEATURES) * np.cos(np.clip(z, -6, 6) @ w + b), np.ones((len(z), 1))])


def isotonic(at: np.ndarray, total: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points in order: each block's mean place and its rate of ones, which never falls."""
    blocks: list[list[float]] = []
    for x, n, y in zip(at, total, ones, strict=True):
        blocks.append([x * n, n, y])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    found = np.array(blocks)
    return found[:, 0] / found[:, 1], found[:, 2] / found[:, 1]


def normal_equations(train: DataFrame, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``Z'Z`` and ``Z'y`` of ``train(x, y)``: each task sums its rows, and the sums are added up entry by entry."""
    size = FEATURES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, STATISTICS)
            z = fourier((x - mean) / scale)
            total += z.T @ np.hstack([z, batch.column(1).to_numpy(zero_copy_only=False).reshape(-1, 1)])
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    sums = train.select("x", "y").mapInArrow(run, "i int, row array<double>")
    cells = sums.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((size, size + 1))
    for r in cells.toPandas().itertuples():  # as many cells as the model fixes, whatever the rows
        out[r.i, r.j] = r.v
    return out[:, :-1], out[:, -1]


def fit(labelled: DataFrame, fold: Column) -> Model:
    """A model from ``labelled(x, y)``: statistics and 0/1 labels. Rows where ``fold`` holds calibrate, the others fit the weights.

    Without rows, or with one label only, every score is the mean label (0.5 without rows).
    """
    labelled = common.cut(labelled.select("x", F.col("y").cast("double").alias("y"), fold.alias("fold")))
    parts = [F.col("x")[k] for k in range(STATISTICS)]
    facts = labelled.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate"), F.avg(F.when(F.col("fold"), F.col("y"))).alias("fold_rate"), *[f(p) for p in parts for f in (F.avg, F.stddev_pop)]).first()
    flat = Model(np.zeros(STATISTICS), np.ones(STATISTICS), np.zeros(FEATURES + 1), np.zeros(1), np.array([0.5 if facts.rate is None else facts.rate]))
    if facts.rate in (None, 0.0, 1.0):
        return flat
    mean, scale = np.array(facts[3::2]), np.array(facts[4::2])
    scale[scale < 1e-9] = 1
    train = labelled.filter(~F.col("fold")).repartition(max(1, -(-facts.n // ROWS_PER_TASK)))
    a, b = normal_equations(train, mean, scale)
    weights = np.linalg.solve(a + RIDGE * max(a[-1, -1], 1) * np.eye(len(b)), b)
    model = Model(mean, scale, weights, flat.steps, flat.levels)
    if facts.fold_rate is None:
        return model
    raw = labelled.filter("fold").select(F.floor(_udf(model.raw, "x") * GRID).alias("at"), "y")
    bins = raw.withColumn("at", F.greatest(F.lit(-GRID), F.least(F.lit(2 * GRID), "at"))).groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"))
    bins = bins.toPandas().sort_values("at")  # at most 3 * GRID + 1 rows
    steps, levels = isotonic((bins["at"].to_numpy() + 0.5) / GRID, bins["n"].to_numpy(float), bins["ones"].to_numpy(float))
    return Model(mean, scale, weights, steps, levels)


def _udf(f, column: str | Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(f(np.array(x.to_list(), float).reshape(-1, STATISTICS)))

    return run(column)


def score_text(model: Model, text: Column) -> Column:
    """The score of each text, null as empty."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in _bytes_of(texts)], float).reshape(-1, STATISTICS)))

    return run(text)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the remainder of the id's CRC-32 by 3 is 1: such rows are kept from fitting and calibration."""
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """The model from the statistics of documents and the labels of those that aren't held out. Null ids and labels are left out."""
    marks = labels.filter(~held_out(id_col) & F.col(label_col).isNotNull()).select(id_col, F.col(label_col).alias("y"))
    rows = stats.join(marks, id_col)
    return fit(rows, F.pmod(F.xxhash64(F.lit(SEED), id_col), F.lit(5)) == 0)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without those that score below ``threshold``. An empty table stays empty; null texts score as empty ones."""
    model = learn(common.cut(with_statistics(docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi"))), labels)
    return docs.filter(score_text(model, F.col("text")) >= threshold)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    stats = common.cut(with_statistics(common.read(spark, sf_dir, "documents")))
    model = learn(stats, common.read(spark, sf_dir, "labels"))
    scored = stats.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), _udf(model.score, "x").alias("score"))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op3_quality": op3_quality}
SQL: dict[str, str] = {}
