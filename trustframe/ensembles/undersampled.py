"""Ensemble on balanced parts of an imbalanced two-class table, plus one over-sampled member."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustframe.ensembles.members import Ensemble, argmax
from trustframe.functions.tails import normal_critical
from trustframe.learners.base import Learner
from trustframe.operators.ordering import running_sums
from trustframe.operators.sampling import majority_split, oversample, undersample, undersampled_folds
from trustframe.operators.scoring import confusion, score_table_wide

MODES = ("regular", "weighted", "cweighted", "nweighted", "ncweighted")


def wilcoxon(differences: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, w_plus, w_minus, z): signed-rank test of column ``d``, zeros dropped.

    Equal |d| are merged before ranking; z uses the normal approximation with tie
    correction and is not positive.
    """
    points = (
        differences.where("d <> 0")
        .withColumn("size", F.abs("d"))
        .groupBy(*keys, "size")
        .agg(F.count_if(F.col("d") > 0).alias("pos"), F.count_if(F.col("d") < 0).alias("neg"))
        .withColumn("cnt", F.col("pos") + F.col("neg"))
    )
    ranked = running_sums(points, keys, "size", ["cnt"]).withColumn(
        "mid", F.col("cnt_before") + (F.col("cnt") + 1) / 2.0
    )
    t = F.col("cnt").cast("double")
    sums = ranked.groupBy(*keys).agg(
        F.sum("cnt").alias("n"),
        F.sum(F.col("pos") * F.col("mid")).alias("w_plus"),
        F.sum(F.col("neg") * F.col("mid")).alias("w_minus"),
        F.sum(t * t * t - t).alias("ties"),
    )
    n = F.col("n").cast("double")
    spread = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2.0) / 24.0)
    z = F.try_divide(F.least("w_plus", "w_minus") - n * (n + 1) / 4.0, spread)
    return sums.withColumn("z", z).drop("ties")


@dataclass
class BalancedParts:
    """The fitted ensemble: k members on balanced parts, then the over-sampled member."""

    ensemble: Ensemble
    k: int
    weights: list[float]
    regular: bool = False  # neither the over-sampled member nor weights

    @property
    def scaled_weights(self) -> list[float]:
        return _scaled(self.weights)


def _scaled(weights: list[float]) -> list[float]:
    low, high = min(weights), max(weights)
    return [(w - low) / (high - low) + 0.01 if high > low else 0.01 for w in weights]


def fit_parts(rows: DataFrame, learner: Learner, dim: int, seed: int = 1410, regular: bool = False) -> BalancedParts:
    """All members and their weights; with ``regular`` only the balanced parts, all of weight 1, as mode "regular" sums them."""
    folds = undersampled_folds(rows, seed=seed)
    if regular:
        k = majority_split(rows)[2]
        return BalancedParts(Ensemble.fit(learner, folds, dim, 2), k, [1.0] * (k + 1), True)
    parts = folds.withColumn("w", F.lit(1.0))
    k = parts.agg(F.max("member")).first()[0] + 1
    extra = oversample(rows, seed=seed).withColumn("member", F.lit(k))
    ensemble = Ensemble.fit(learner, parts.unionByName(extra, allowMissingColumns=True), dim, 2)
    alike = ensemble.votes(rows).groupBy(F.col("y").alias("y_true"), "votes").agg(F.count(F.lit(1)).alias("n"))
    each = alike.select("y_true", F.posexplode("votes").alias("member", "y_pred"), "n")
    conf = each.groupBy("member", "y_true", "y_pred").agg(F.sum("n").alias("n"))
    bac = score_table_wide(conf, ["member"]).select("member", "bac")
    weights = [r["bac"] for r in bac.orderBy("member").collect()]  # one per member
    return BalancedParts(ensemble, k, weights)


def rank_bounds(pairs: list[tuple[int, int]], supports: DataFrame, fine: int = 7, octaves: int = 64) -> DataFrame:
    """(i, j, low, high): bounds of |z| in the signed-rank test of every pair of members on their supports of class 0.

    Tasks count positive and negative differences by the leading bits of their size (``fine`` bits of the fraction; all
    below 2**-octaves are one bin). Which ranks a bin takes is known; inside it either sign may come first and any values may be tied.
    """
    bins = (octaves << fine) + 2
    shift, least = 52 - fine, (1023 - octaves) << fine

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(pairs), 2, bins), dtype=np.int64)
        for batch in batches:
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).T.copy()
            for p, (i, j) in enumerate(pairs):
                d = values[i] - values[j]
                d = d[d != 0]
                at = np.clip((np.abs(d).view(np.int64) >> shift) - least, 0, bins - 1)
                below = d < 0
                counts[p, 0] += np.bincount(at[~below], minlength=bins)
                counts[p, 1] += np.bincount(at[below], minlength=bins)
        for p, (i, j) in enumerate(pairs):
            at = np.flatnonzero(counts[p].sum(axis=0))
            keys = [pa.array(v, pa.int32()) for v in (np.full(len(at), i), np.full(len(at), j), at)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(counts[p, 0, at]), pa.array(counts[p, 1, at])], ["i", "j", "bin", "pos", "neg"])

    first = supports.select(F.transform("esm", lambda m: F.get(m, F.lit(0))).alias("s")).where(F.forall("s", lambda v: v.isNotNull()))
    found = first.mapInArrow(count, "i int, j int, bin int, pos bigint, neg bigint").groupBy("i", "j", "bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    earlier = Window.partitionBy("i", "j").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    sums = found.withColumn("before", F.coalesce(F.sum(pos + neg).over(earlier), F.lit(0.0))).groupBy("i", "j").agg(
        F.sum(pos + neg).alias("n"), F.sum(pos * F.col("before") + pos * (pos + 1) / 2).alias("w"), F.sum(pos * neg).alias("open"),
        F.sum(F.pow(pos + neg, 3) - pos - neg).alias("ties"),
    )
    n = F.col("n")
    whole, ranks = n * (n + 1) / 2, n * (n + 1) * (2 * n + 1)
    nearest = F.least(F.col("w") + F.col("open"), whole - F.col("w"), whole / 2)
    farthest = F.least(F.col("w"), whole - F.col("w") - F.col("open"))
    return sums.select(
        "i", "j", ((whole / 2 - nearest) / F.sqrt(ranks / 24)).alias("low"),
        ((whole / 2 - farthest) / F.sqrt((ranks - F.col("ties") / 2) / 24)).alias("high"),
    )


def member_segments(rows: DataFrame, parts: BalancedParts, p_limit: float = 0.01, fine: int = 7) -> list[int]:
    """Segment of every member: a member joins the last later one whose support of class 0
    differs significantly (Wilcoxon); the over-sampled member stays alone.

    Counts of the differences by size decide nearly all pairs; the rest, if a segment hangs on it, is ranked exactly.
    """
    segments = list(range(parts.k + 1))
    if parts.k < 2:
        return segments
    limit, slack = normal_critical(p_limit), 1e-9  # of rounding in the sums
    supports = parts.ensemble.supports(rows)
    every = [(i, j) for i in range(parts.k) for j in range(i + 1, parts.k)]
    bounds = rank_bounds(every, supports, fine).collect()  # pairs of members
    for r in bounds:
        if r["low"] > limit * (1 + slack):
            segments[r["i"]] = max(segments[r["i"]], r["j"])
    unsure = [(r["i"], r["j"]) for r in bounds if r["low"] <= limit * (1 + slack) and r["high"] >= limit * (1 - slack) and r["j"] > segments[r["i"]]]
    if unsure:
        pairs = F.array(*[
            F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"),
                     (F.get(F.get("esm", F.lit(i)), F.lit(0)) - F.get(F.get("esm", F.lit(j)), F.lit(0))).alias("d"))
            for i, j in unsure
        ])
        differences = supports.select(F.explode(pairs).alias("e")).select("e.*")
        tested = wilcoxon(differences, ["i", "j"]).where(F.abs("z") > limit)
        for r in tested.select("i", "j").collect():  # pairs of members
            segments[r["i"]] = max(segments[r["i"]], r["j"])
    return segments


def decision_cube(
    parts: BalancedParts, mode: str, segments: list[int] | None = None, oversampled: bool = False
) -> Column:
    """array (member or segment) of array (class) of supports for one of ``MODES``."""
    return F.array(*[F.array(a, b) for a, b in _layers(parts, mode, segments, oversampled)])


def _layers(
    parts: BalancedParts, mode: str, segments: list[int] | None, oversampled: bool
) -> list[tuple[Column, Column]]:
    """The supports of both classes by each member or segment.

    With ``segments`` the members of a segment are merged: their weighted supports are
    averaged first, and weights and contrasts are those of the segment.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if oversampled and parts.regular:
        raise ValueError("the over-sampled member was not trained")
    if parts.regular and (mode != "regular" or segments is not None):
        raise ValueError("weights of the members were not measured")
    esm = F.col("esm")

    def pair(i: int) -> list[Column]:
        return [F.get(F.get(esm, F.lit(i)), F.lit(c)) for c in (0, 1)]

    if segments is None:
        cubes, weights = [pair(i) for i in range(parts.k + 1)], parts.weights
    else:
        cubes, weights = [], []
        for s in sorted(set(segments)):
            inside = [i for i, own in enumerate(segments) if own == s]
            sums = [
                sum((pair(i)[c] * parts.weights[i] for i in inside), F.lit(0.0)) / len(inside) for c in (0, 1)
            ]
            cubes.append(sums)
            weights.append(sum(parts.weights[i] for i in inside) / len(inside))
    scaled = _scaled(weights)
    if not oversampled:
        cubes, weights, scaled = cubes[:-1], weights[:-1], scaled[:-1]
    layers = []
    for (a, b), w, nw in zip(cubes, weights, scaled):
        factor = F.lit(1.0) if mode == "regular" else F.lit(float(nw if mode.startswith("n") else w))
        if mode in ("cweighted", "ncweighted"):
            factor = factor * F.abs(a - b)
        layers.append((a * factor, b * factor))
    return layers


def cube_vote(
    rows: DataFrame, parts: BalancedParts, mode: str = "regular", segments: list[int] | None = None,
    oversampled: bool = False,
) -> DataFrame:
    """Class of the largest summed support."""
    layers = _layers(parts, mode, segments, oversampled)
    summed = F.array(*[sum((layer[c] for layer in layers), F.lit(0.0)) for c in (0, 1)])
    return parts.ensemble.supports(rows).withColumn("y_pred", argmax(summed)).drop("esm")


def resampling_bac(train: DataFrame, test: DataFrame, learner: Learner, dim: int, seed: int = 1410) -> DataFrame:
    """(variant, bac) of the plain, under-sampled and over-sampled fit; all three train in one job."""
    variants = (
        train.withColumn("w", F.lit(1.0)).withColumn("variant", F.lit("plain"))
        .unionByName(undersample(train, seed=seed).withColumn("w", F.lit(1.0)).withColumn("variant", F.lit("under")))
        .unionByName(oversample(train, seed=seed).withColumn("variant", F.lit("over")))
    )
    model = learner.fit(variants, ["variant"], dim, 2)
    copies = test.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in ("plain", "under", "over")])))
    predicted = learner.predict(copies, model, ["variant"]).withColumnRenamed("y", "y_true")
    return score_table_wide(confusion(predicted, ["variant"]), ["variant"]).select("variant", "bac")
