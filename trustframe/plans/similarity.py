"""Similarity of the other classes to a base class by reconstruction error.

A reconstruction model is trained on the base class only; the mean L1 error of every
class is set in relation to the base class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe.functions.arrays import total
from trustframe.functions.hashing import hash_below, hash_int, hash_unit
from trustframe.operators.storage import settle, settle_small, with_row
from trustframe.operators.transforming import minmax_vectors

#: Rows of a mini-batch of the network (fixed default), and rows of a piece that is trained in one task.
STEP_ROWS, PIECE_ROWS = 32, 50_000


def majority_class(rows: DataFrame, label: str = "label") -> str:
    """Largest class, smallest label on ties."""
    top = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label).first()
    return top[label]


def hidden_sizes(dim: int) -> tuple[int, int]:
    """Hidden and latent width: the power of two below half the features, and its half."""
    hidden = 2 ** (math.floor(math.log2(dim)) - 1) if dim >= 1 else 0
    if hidden < 2:
        raise ValueError("the reconstruction network needs at least 4 features")
    return int(hidden), int(hidden // 2)


def _summary(errors: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """Detail (label, n, l1, relative) and the one-row metric from (label, n, l1)."""
    errors = settle_small(errors, "errors")
    base_l1 = errors.where(F.col("label") == base).agg(F.max("l1")).scalar()
    detail = errors.withColumn("relative", F.try_divide(F.col("l1"), base_l1))
    other = F.col("label") != base
    metric = detail.agg(
        F.try_divide(
            F.sum(F.when(other, F.col("n") * F.col("relative"))), F.sum(F.when(other, F.col("n")))
        ).alias("similarity")
    ).withColumn("base_class", F.lit(base))
    return detail, metric


def _class_errors(rows: DataFrame, rebuilt: Column, dim: int) -> DataFrame:
    l1 = total(F.zip_with("x", rebuilt, lambda a, b: F.abs(a - b))) / dim
    return rows.withColumn("_l1", l1).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("_l1").alias("l1"))


def _base_mean(base_rows: DataFrame, dim: int) -> DataFrame:
    return settle_small(base_rows.agg(F.array(*[F.avg(F.get("x", F.lit(i))) for i in range(dim)]).alias("mean")), "mean")


def similarity_mean(rows: DataFrame, dim: int, base: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Reconstruction by the base mean (a linear model of rank 0). Rows: label, x."""
    rows = settle(minmax_vectors(rows.withColumn("label", F.col("label").cast("string"))), "scaled")
    base = base or majority_class(rows)
    mean = _base_mean(rows.where(F.col("label") == base), dim)
    return _summary(_class_errors(with_row(rows, mean), F.col("mean"), dim), base)


def similarity_pca(
    rows: DataFrame, dim: int, base: str | None = None, latent: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Linear autoencoder: projection on the base class's first principal axes."""
    latent = latent or hidden_sizes(dim)[1]
    rows = settle(minmax_vectors(rows.withColumn("label", F.col("label").cast("string"))), "scaled")
    base = base or majority_class(rows)
    base_rows = rows.where(F.col("label") == base)
    mean = _base_mean(base_rows, dim)
    centred = with_row(base_rows, mean).select(array_to_vector(F.zip_with("x", "mean", lambda a, b: a - b)).alias("v"))
    axes = PCA(k=latent, inputCol="v", outputCol="p").fit(centred).pc.toArray()  # dim x latent numbers
    project = (axes @ axes.T).tolist()
    matrix = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in project])
    shifted = F.zip_with("x", "mean", lambda a, b: a - b)
    rebuilt = F.zip_with(
        F.transform(matrix, lambda row: total(F.zip_with(row, F.col("_c"), lambda a, b: a * b))),
        "mean",
        lambda a, b: a + b,
    )
    return _summary(_class_errors(with_row(rows, mean).withColumn("_c", shifted), rebuilt, dim), base)


def _init(dim: int, seed: int) -> list[np.ndarray]:
    hidden, latent = hidden_sizes(dim)
    rng = np.random.default_rng(seed)
    widths = [dim, hidden, latent, hidden, dim]
    out = []
    for a, b in zip(widths, widths[1:]):
        bound = 1 / math.sqrt(a)
        out += [rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)]
    return out


def _forward(params: list[np.ndarray], x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Activations before each layer, and the sigmoid output."""
    w1, b1, w2, b2, w3, b3, w4, b4 = params
    h1 = np.maximum(x @ w1 + b1, 0)
    z = h1 @ w2 + b2
    h2 = np.maximum(z @ w3 + b3, 0)
    return [x, h1, z, h2], 1 / (1 + np.exp(-(h2 @ w4 + b4)))


def _gradients(params: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    """Summed gradients of the binary cross entropy (mean over features)."""
    (x0, h1, z, h2), out = _forward(params, x)
    _, _, w2, _, w3, _, w4, _ = params
    d4 = (out - x0) / x0.shape[1]
    d3 = (d4 @ w4.T) * (h2 > 0)
    d2 = d3 @ w3.T
    d1 = (d2 @ w2.T) * (h1 > 0)
    return [g for a, d in ((x0, d1), (h1, d2), (z, d3), (h2, d4)) for g in (a.T @ d, d.sum(axis=0))]


def similarity_ae(
    rows: DataFrame, dim: int, base: str | None = None, epochs: int = 50, rate: float = 1e-3, seed: int = 1410
) -> tuple[DataFrame, DataFrame]:
    """Autoencoder with ReLU layers and sigmoid output, trained on 80 % of the base class.

    One epoch is one job. Its rows are dealt by hash into pieces of about ``PIECE_ROWS`` rows; each piece takes Adam
    steps on mini-batches of ``STEP_ROWS`` from the common weights, and weights and moments are then averaged by rows.
    So a class that fits into one piece is trained as on one machine. All base rows of the share are used in every epoch.
    Up to about 8 features the hidden layers have so few units that some seeds (1410 with 8 features among them) start with all
    of them inactive; the network then stays at the base mean.
    """
    rows = settle(minmax_vectors(rows.withColumn("label", F.col("label").cast("string"))), "scaled")
    base = base or majority_class(rows)
    chosen = rows.where((F.col("label") == base) & (hash_unit(seed, "ae", F.col("row_id")) < 0.8))
    pieces = max(1, math.ceil(chosen.count() / PIECE_ROWS))
    train = settle(
        chosen.select("x", hash_int(seed, "order", F.col("row_id")).alias("at"), hash_below(pieces, seed, "piece", F.col("row_id")).alias("piece")),
        "train",
    )
    start = _init(dim, seed)
    shapes = [p.shape for p in start]
    flat = np.concatenate([p.ravel() for p in start])
    size, steps = flat.size, 0
    state = np.concatenate([flat, np.zeros(2 * size)])  # weights and both moments

    def shaped(values: np.ndarray) -> list[np.ndarray]:
        cuts = np.cumsum([math.prod(s) for s in shapes])[:-1]
        return [p.reshape(s) for p, s in zip(np.split(values, cuts), shapes)]

    for epoch in range(epochs):
        common, taken = state, steps

        def descend(part: pd.DataFrame) -> pd.DataFrame:
            w, m, v = np.split(common.copy(), 3)
            x = np.array(part.sort_values("at")["x"].tolist(), dtype=float)
            x = x[np.random.default_rng([seed, epoch, int(part["piece"].iloc[0])]).permutation(len(x))]
            for t, at in enumerate(range(0, len(x), STEP_ROWS), taken + 1):
                batch = x[at : at + STEP_ROWS]
                g = np.concatenate([g.ravel() for g in _gradients(shaped(w), batch)]) / len(batch)
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            return pd.DataFrame({"pos": np.arange(3 * size), "v": np.concatenate([w, m, v]) * len(x), "n": len(x)})

        parts = train.groupBy("piece").applyInPandas(descend, "pos int, v double, n bigint")
        found = parts.groupBy("pos").agg((F.sum("v") / F.sum("n")).alias("v"), F.max("n").alias("n")).toPandas()  # one row per number of the state
        if not len(found):
            break
        state = found.sort_values("pos")["v"].to_numpy()
        steps += math.ceil(int(found["n"].iloc[0]) / STEP_ROWS)
    final = shaped(state[:size])

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.array(batch["x"].tolist(), dtype=float)
                yield pd.DataFrame({"label": batch["label"], "_l1": np.abs(_forward(final, x)[1] - x).mean(axis=1)})

    per_row = rows.select("label", "x").mapInPandas(errors, "label string, _l1 double")
    return _summary(per_row.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("_l1").alias("l1")), base)
