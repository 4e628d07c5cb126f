"""Bootstrap ensemble of two-class centroid decisions with combination rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe.functions.arrays import dot
from trustframe.learners.centroid import NearestCentroid
from trustframe.operators.storage import settle_small, with_row

SIGMA, CLIP = 3.0, 1e-6  # fixed values


def decision_members(train: DataFrame, dim: int) -> DataFrame:
    """One row: array of (b, w) of the members' centroid decisions. ``train`` has member."""
    model = NearestCentroid().fit(train, ["member"], dim)
    c0, c1 = F.get("centers", F.lit(0))["center"], F.get("centers", F.lit(1))["center"]
    b = F.zip_with(c0, c1, lambda u, v: (u + v) / 2.0)
    lined = model.select("member", b.alias("b"), F.zip_with(c1, b, lambda u, v: u - v).alias("w"))
    return settle_small(lined.agg(F.array_sort(F.collect_list(F.struct("member", "b", "w"))).alias("m")), "decisions")


def decisions(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Adds ``d``: array<double>, one decision per member."""
    each = F.transform("m", lambda m: dot(F.zip_with("x", m["b"], lambda u, v: u - v), m["w"]))
    return with_row(rows, members).withColumn("d", each).drop("m")


def decision_scale(rows: DataFrame, members: DataFrame) -> DataFrame:
    """One row: root mean square of all members' decisions on the training rows."""
    squares = F.aggregate("d", F.lit(0.0), lambda a, v: a + v * v)
    return settle_small(
        decisions(rows, members).agg(F.sqrt(F.sum(squares) / F.sum(F.size("d"))).alias("rms")), "rms"
    )


def _shifted(rms: Column) -> Column:
    return F.transform(
        "d", lambda v: F.least(F.lit(1 - CLIP), F.greatest(F.lit(CLIP), (v / rms + SIGMA) / (2 * SIGMA)))
    )


def combined(rows: DataFrame, members: DataFrame, scale: DataFrame, rule: str) -> DataFrame:
    """Adds ``decision`` by ``rule`` (gmean, hmean, mean, rbh) and y_pred = decision > 0."""
    n = F.size("d")
    scaled = _shifted(F.col("rms"))
    if rule == "gmean":
        value = F.exp(F.aggregate(scaled, F.lit(0.0), lambda a, v: a + F.log(v)) / n)
        decision = (value - 0.5) * 2 * SIGMA
    elif rule == "hmean":
        value = n / F.aggregate(scaled, F.lit(0.0), lambda a, v: a + 1.0 / v)
        decision = (value - 0.5) * 2 * SIGMA
    elif rule == "mean":
        decision = F.aggregate("d", F.lit(0.0), lambda a, v: a + v) / n
    elif rule == "rbh":
        ordered = F.array_sort("d")
        low, high = F.array_min("d"), F.array_max("d")
        at = F.floor(n / 2).cast("int")
        upper = F.get(ordered, at)
        middle = F.when(n % 2 == 1, upper).otherwise((upper + F.get(ordered, at - 1)) / 2.0)
        up, down = high - middle, middle - low
        harmonic = F.coalesce(F.try_divide(2.0 * up * down, up + down), F.lit(0.0))
        decision = F.when(middle > high + low, high - harmonic).otherwise(low + harmonic)
    else:
        raise ValueError(f"unknown rule {rule}")
    return (
        with_row(decisions(rows, members), scale)
        .withColumn("decision", decision)
        .withColumn("y_pred", (F.col("decision") > 0).cast("int"))
        .drop("d", "rms")
    )
