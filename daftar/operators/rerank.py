"""Reranking by a model: fitted on labelled pairs in Spark, and applied in batches, the model being made ready once a worker."""

from __future__ import annotations

import io

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daftar.operators.retrieval import reranked

#: Lists of this many candidates or fewer keep their order.
SHORT = 3
STEPS = 8


def fitted(pairs: DataFrame, features: str, label: str, n: int, ridge: float = 1.0) -> bytes:
    """A logistic scorer of n features, as bytes: weights, means and deviations. pairs: an array of n doubles, without nulls, and a label of 0 or 1; others are left out.

    Newton's method: each of STEPS steps is one aggregation over all pairs, of n squared sums; nothing else reaches the driver. The pairs are kept by Spark meanwhile.
    """
    known = pairs.where(F.col(label).isin(0, 1) & (F.size(features) == n) & ~F.exists(features, lambda x: x.isNull() | F.isnan(x))).select(*(F.col(features)[i].cast("double").alias(f"x{i}") for i in range(n)), F.col(label).cast("double").alias("y"))
    known.persist()  # each step reads all pairs: their features are computed once
    try:
        w, mean, deviation = _newton(known, n, ridge)
    finally:
        known.unpersist()
    out = io.BytesIO()
    np.savez(out, weights=w, mean=mean, deviation=deviation)
    return out.getvalue()


def _newton(known: DataFrame, n: int, ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and deviations from rows of x0, x1, ... and y."""
    x = [F.col(f"x{i}") for i in range(n)]
    row = known.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(x)), *(F.stddev_pop(c).alias(f"d{i}") for i, c in enumerate(x))).first()
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(n)])
    deviation = np.array([row[f"d{i}"] or 1.0 for i in range(n)])
    scaled = [F.lit(1.0), *((c - m) / d for c, m, d in zip(x, mean.tolist(), deviation.tolist(), strict=True))]
    w, penalty = np.zeros(n + 1), np.r_[1e-9, np.full(n, ridge)]
    for _ in range(STEPS if row["n"] else 0):
        z = sum((c * float(v) for c, v in zip(scaled, w, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
        held = known.select("y", p.alias("p"), *(c.alias(f"s{i}") for i, c in enumerate(scaled)))
        s = [F.col(f"s{i}") for i in range(n + 1)]
        sums = [F.sum(a * (F.col("p") - F.col("y"))).alias(f"g{i}") for i, a in enumerate(s)]
        sums += [F.sum(s[i] * s[j] * F.col("p") * (1 - F.col("p"))).alias(f"h{i}_{j}") for i in range(n + 1) for j in range(i + 1)]
        r = held.agg(*sums).first()
        hessian = np.array([[r[f"h{max(i, j)}_{min(i, j)}"] for j in range(n + 1)] for i in range(n + 1)]) + np.diag(penalty)
        w -= np.linalg.solve(hessian, np.array([r[f"g{i}"] for i in range(n + 1)]) + penalty * w)
    return w, mean, deviation


def loaded(model: bytes):
    """The scorer of a model: rows of features to scores from 0 to 1."""
    held = np.load(io.BytesIO(model))
    weights, mean, deviation = held["weights"], held["mean"], held["deviation"]

    def scores(x: np.ndarray) -> np.ndarray:
        z = np.c_[np.ones(len(x)), (x - mean) / deviation] @ weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    return scores


def model_score(features: Column, model: bytes, n: int, batch: int = 1024) -> Column:
    """The model's score of an array of n doubles, in batches; the model is read once a worker. Features must not be null."""

    def make():
        scores = loaded(model)
        return lambda x: scores(np.asarray(x, np.float64).reshape(-1, n))

    return predict_batch_udf(make, return_type=T.DoubleType(), batch_size=batch, input_tensor_shapes=[[n]])(features)


def rerank(candidates: DataFrame, features: str, model: bytes, n: int, key: str, id_col: str, k: int = 5) -> DataFrame:
    """Each list's first k by the model's score (column score), equal ones by their rank before; lists of SHORT candidates or fewer keep their order. candidates: key, id, rank, an array of n features."""
    scored = candidates.withColumn("score", model_score(F.col(features), model, n))
    return reranked(scored, F.col("score"), key, id_col, k, SHORT + 1)
