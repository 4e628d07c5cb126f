"""K-fold ensemble of linear regressions and a Monte-Carlo search for its minimum.

Least squares needs only sums of products. They are aggregated once per fold; the sums
of a training set are all folds minus one, so k models cost one pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe.functions.hashing import hash_below
from trustframe.operators.sampling import kfold
from trustframe.operators.scoring import explained_variance
from trustframe.operators.storage import settle

GUESSES = 100_000  # fixed default value


@dataclass
class FoldRegressions:
    coefficients: np.ndarray  # folds x (1 + features), intercept first
    scores: list[float]

    @property
    def weights(self) -> np.ndarray:
        return np.array(self.scores) / sum(self.scores)

    @property
    def inner_confidence(self) -> float:
        return float(np.mean(self.scores))


def _products(rows: DataFrame, dim: int) -> np.ndarray:
    """Per fold the matrix of sums of products of (1, x..., y)."""
    values = [F.lit(1.0), *[F.get("x", F.lit(i)) for i in range(dim)], F.col("y")]
    cells = [(i, j) for i in range(dim + 2) for j in range(i, dim + 2)]
    sums = rows.groupBy("fold").agg(*[F.sum(values[i] * values[j]).alias(f"c{i}_{j}") for i, j in cells])
    found = sums.orderBy("fold").collect()  # k rows
    out = np.zeros((len(found), dim + 2, dim + 2))
    for f, r in enumerate(found):
        for i, j in cells:
            out[f, i, j] = out[f, j, i] = r[f"c{i}_{j}"]
    return out


def linear_value(x: Column, beta: Sequence[float]) -> Column:
    value = F.lit(float(beta[0]))
    for i, b in enumerate(beta[1:]):
        value = value + F.lit(float(b)) * F.get(x, F.lit(i))
    return value


def fit_folds(rows: DataFrame, dim: int, k: int = 5, seed: int = 1410) -> FoldRegressions:
    """``rows`` has row_id, x, y (double)."""
    folded = settle(kfold(rows.select("row_id", "x", "y"), k, seed), "folds")
    per_fold = _products(folded, dim)
    train = per_fold.sum(axis=0)[None] - per_fold
    # least squares of the normal equations: collinear features share their weight
    beta = np.array([np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0] for m in train])
    own = F.element_at(F.array(*[linear_value(F.col("x"), b) for b in beta]), F.col("fold") + 1)
    scored = explained_variance(folded.withColumn("y_hat", own), ["fold"])
    scores = [r["explained_variance"] for r in scored.orderBy("fold").collect()]  # k rows
    return FoldRegressions(beta, scores)


def predict(rows: DataFrame, model: FoldRegressions) -> DataFrame:
    """Adds ``y_hat``: the members' predictions weighted by their scores."""
    value = F.lit(0.0)
    for w, beta in zip(model.weights, model.coefficients):
        value = value + F.lit(float(w)) * linear_value(F.col("x"), beta)
    return rows.withColumn("y_hat", value)


def monte_carlo_min(
    rows: DataFrame, model: FoldRegressions, bounds: Sequence[tuple[int, int]], guesses: int = GUESSES,
    seed: int = 1410,
) -> DataFrame:
    """One row (x, y_hat): smallest prediction over random whole points in [low, high)."""
    point = F.array(
        *[(F.lit(lo) + hash_below(hi - lo, seed, "guess", i, F.col("id"))).cast("double") for i, (lo, hi) in enumerate(bounds)]
    )
    drawn = predict(rows.sparkSession.range(guesses).withColumn("x", point), model)
    return drawn.agg(F.min_by(F.struct("x", "y_hat"), F.struct("y_hat", "id")).alias("m")).select("m.*")


def stored_minimum(rows: DataFrame, model: FoldRegressions) -> DataFrame:
    """One row (x, y_hat, y): the training row of smallest y and its prediction."""
    lowest = rows.agg(F.min_by(F.struct("x", "y"), F.struct("y", "row_id")).alias("m")).select("m.*")
    return predict(lowest, model).select("x", "y_hat", "y")
