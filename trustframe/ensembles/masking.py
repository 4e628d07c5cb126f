"""Genetic selection of feature masks for an ensemble over one fitted base model.

The base model is fitted once. A mask switches features off by giving them a very
large variance, so a generation is one pass over the rows: class log densities per
feature times all distinct masks, reduced to confusion counts inside the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustframe.functions.hashing import hash_below
from trustframe.learners.bayes import GaussianBayes
from trustframe.operators.scoring import score_table_wide
from trustframe.operators.storage import settle

OFF_VARIANCE = 1e7  # variance of a masked feature (fixed value)

Pool = np.ndarray  # bool, ensembles x members x features


@dataclass
class BaseModel:
    priors: np.ndarray  # classes
    mean: np.ndarray  # classes x features
    var: np.ndarray


def base_model(rows: DataFrame, dim: int) -> BaseModel:
    """Priors, means and variances per class (classes x features numbers)."""
    table = GaussianBayes().moments(rows.drop("w"), [], dim).orderBy("y").collect()
    var = np.array([r["var"] for r in table])
    return BaseModel(
        np.array([r["n"] for r in table]), np.array([r["mean"] for r in table]),
        np.maximum(var, max(1e-9 * var.max(), 1e-300)),
    )


def hashed_pool(rows: DataFrame, ensembles: int, members: int, dim: int, seed: int = 13) -> Pool:
    """Seeded starting masks: bit = hash(ensemble, member, feature) mod 2."""
    grid = rows.sparkSession.range(ensembles * members * dim)
    bits = grid.select("id", hash_below(2, seed, "mask", F.col("id")).alias("b")).orderBy("id").collect()
    return np.array([r["b"] for r in bits], dtype=bool).reshape(ensembles, members, dim)


def member_supports(model: BaseModel, masks: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Class probabilities: masks x rows x classes."""
    diff2 = (x[:, None, :] - model.mean[None]) ** 2
    on = -0.5 * np.log(2 * np.pi * model.var)[None] - 0.5 * diff2 / model.var[None]
    off = -0.5 * np.log(2 * np.pi * OFF_VARIANCE) - 0.5 * diff2 / OFF_VARIANCE
    m = masks.astype(float)
    logs = np.einsum("ncd,md->mnc", on, m) + np.einsum("ncd,md->mnc", off, 1 - m)
    logs += np.log(model.priors)[None, None, :]
    logs -= logs.max(axis=2, keepdims=True)
    p = np.exp(logs)
    return p / p.sum(axis=2, keepdims=True)


def pool_scores(rows: DataFrame, model: BaseModel, pool: Pool, metric: str = "f1", classes: Sequence[int] | None = None) -> list[float]:
    """Score of every ensemble of the pool on ``rows``: one job for the whole pool."""
    masks, place = np.unique(pool.reshape(-1, pool.shape[2]), axis=0, return_inverse=True)
    members = place.reshape(pool.shape[:2])
    codes = np.array(classes if classes is not None else range(len(model.priors)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            step = max(1, 2_000_000 // max(1, masks.shape[0] * model.mean.size))
            for at in range(0, len(batch), step):
                part = batch.iloc[at : at + step]
                x = np.array(part["x"].tolist(), dtype=float)
                probas = member_supports(model, masks, x)
                frames = []
                for e in range(members.shape[0]):
                    pred = codes[probas[members[e]].mean(axis=0).argmax(axis=1)]
                    frames.append(pd.DataFrame({"ensemble": e, "y_true": part["y"].to_numpy(), "y_pred": pred}))
                whole = pd.concat(frames)
                yield whole.groupby(["ensemble", "y_true", "y_pred"]).size().reset_index(name="n")

    counts = rows.select("x", "y").mapInPandas(count, "ensemble int, y_true int, y_pred int, n bigint")
    conf = counts.groupBy("ensemble", "y_true", "y_pred").agg(F.sum("n").alias("n"))
    found = score_table_wide(conf, ["ensemble"]).select("ensemble", metric).collect()
    by = {r["ensemble"]: r[metric] for r in found}
    return [by[e] for e in range(pool.shape[0])]


def usage(pool: Pool) -> np.ndarray:
    """Share of features used by any member."""
    return pool.any(axis=1).mean(axis=1)


def spread(pool: Pool) -> np.ndarray:
    """Mean pairwise Hamming distance of the members, per feature."""
    size = pool.shape[1]
    on = pool.sum(axis=1)
    return (on * (size - on)).sum(axis=1) / (size * (size - 1) / 2) / pool.shape[2]


def mask_quality(
    rows: DataFrame, dim: int, pool: Pool, alpha: float = 0.0, beta: float = 0.0, metric: str = "f1"
) -> DataFrame:
    """(ensemble, score, usage, spread, quality) of one generation."""
    scores = pool_scores(rows, base_model(rows, dim), pool, metric)
    a, b = usage(pool), spread(pool)
    return rows.sparkSession.createDataFrame(
        [(i, s, float(a[i]), float(b[i]), float(s - alpha * a[i] + beta * b[i])) for i, s in enumerate(scores)],
        "ensemble int, score double, usage double, spread double, quality double",
    )


def mutate(pool: Pool, rate: float, rng: np.random.Generator) -> Pool:
    """Each mask bit turned over with chance ``rate``."""
    return pool ^ (rng.random(pool.shape) < rate)


def cross(pool: Pool, rate: float, rng: np.random.Generator) -> Pool:
    """With chance ``rate`` an ensemble takes a random half of its bits from its neighbour in a random ring."""
    ring = rng.permutation(len(pool))
    mate = np.empty(len(pool), int)
    mate[ring] = np.roll(ring, 1)
    takes = (rng.random(len(pool)) < rate)[:, None, None] & (rng.random(pool.shape) < 0.5)
    return np.where(takes, pool[mate], pool)


def tournament(quality: np.ndarray, places: int, rng: np.random.Generator) -> np.ndarray:
    """For each place the better of two ensembles drawn at random."""
    pairs = rng.integers(len(quality), size=(places, 2))
    return np.where(quality[pairs[:, 0]] >= quality[pairs[:, 1]], pairs[:, 0], pairs[:, 1])


def evolve(
    rows: DataFrame, dim: int, pool: Pool, generations: int = 50, elite: int = 1, p_cross: float = 0.025,
    p_mutate: float = 0.01, alpha: float = 0.0, beta: float = 0.0, metric: str = "f1", seed: int = 13,
) -> tuple[Pool, DataFrame]:
    """Last pool, best ensemble first, and the history (generation, ensemble, score, quality).

    The ``elite`` best pass unchanged; the other places go to winners of tournaments of two, crossed and mutated. An ensemble
    that was scored before is not scored again, and a generation's new ones share one job.
    """
    rng = np.random.default_rng(seed)
    rows = settle(rows, "rows")
    model = base_model(rows, dim)
    memory: dict[bytes, float] = {}

    def graded(current: Pool) -> tuple[Pool, np.ndarray, np.ndarray]:
        names = [e.tobytes() for e in current]
        new = [i for i, name in enumerate(names) if name not in memory and names.index(name) == i]
        if new:
            memory.update(zip([names[i] for i in new], pool_scores(rows, model, current[new], metric)))
        score = np.array([memory[name] for name in names])
        quality = score - alpha * usage(current) + beta * spread(current)
        best = np.lexsort((np.arange(len(names)), -quality))
        return current[best], score[best], quality[best]

    children, history = pool[elite:], []
    top = pool[:elite]
    for generation in range(generations):
        bred = mutate(cross(children, p_cross, rng), p_mutate, rng)
        current, score, quality = graded(np.concatenate([top, bred]))
        history += [(generation, i, float(s), float(q)) for i, (s, q) in enumerate(zip(score, quality))]
        top, children = current[:elite], current[tournament(quality, len(pool) - elite, rng)]
    table = rows.sparkSession.createDataFrame(history, "generation int, ensemble int, score double, quality double")
    return (current if generations else pool), table


def masked_vote(rows: DataFrame, model: BaseModel, masks: np.ndarray) -> DataFrame:
    """Adds y_pred: largest mean support over the members' masks."""
    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["x"].tolist(), dtype=float)
            pred = member_supports(model, masks, x).mean(axis=0).argmax(axis=1) if len(batch) else []
            yield batch.assign(y_pred=np.asarray(pred, dtype=np.int32))

    schema = T.StructType([*rows.schema.fields, T.StructField("y_pred", T.IntegerType())])
    return rows.mapInPandas(decide, schema)
