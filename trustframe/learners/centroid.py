"""Nearest centroid, and the two-class centroid decision."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from trustframe.functions.arrays import dot, squared_distance
from trustframe.learners.base import Fields, Learner, weight
from trustframe.operators.storage import settle


class NearestCentroid(Learner):
    """One weighted mean per (key, class); support is the negative squared distance."""

    def fit(self, train: DataFrame, keys: Sequence[str], dim: int, n_classes: int = 0) -> DataFrame:
        return self.fit_summaries(self.summaries(train, keys, dim), keys, dim)

    def summary_fields(self, train: DataFrame, x: Column, dim: int) -> dict[str, Column]:
        """n: weight, sums: weighted sum per feature."""
        w = weight(train)
        return {"n": F.sum(w), "sums": F.array(*[F.sum(w * F.get(x, F.lit(i))) for i in range(dim)])}

    def fit_summaries(self, parts: DataFrame, keys: Sequence[str], dim: int) -> DataFrame:
        means = parts.groupBy(*keys, "y").agg(
            F.array(*[F.sum(F.get("sums", F.lit(i))) / F.sum("n") for i in range(dim)]).alias("center")
        )
        return settle(
            means.groupBy(*keys).agg(
                F.array_sort(F.collect_list(F.struct(F.col("y").alias("c"), "center"))).alias("centers")
            ),
            "centroids",
        )

    def arrays(self, model: Row) -> tuple[np.ndarray, tuple]:
        return np.array([m["c"] for m in model["centers"]]), (np.array([m["center"] for m in model["centers"]], dtype=float),)

    def scores_of(self, x: np.ndarray, held: tuple) -> np.ndarray:
        return np.stack([-((x - center) ** 2).sum(axis=1) for center in held[0]], axis=1)

    def score_classes(self, x: Column, model: Fields = F.col) -> Column:
        return F.transform(
            model("centers"),
            lambda m: F.struct(m["c"].alias("c"), (-squared_distance(x, m["center"])).alias("support")),
        )


def centroid_decision(test: DataFrame, model: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``decision`` = (x - b) . (c1 - b), b the mean of both centres, and y_pred."""
    c0, c1 = F.get("centers", F.lit(0))["center"], F.get("centers", F.lit(1))["center"]
    b = F.zip_with(c0, c1, lambda u, v: (u + v) / 2.0)
    shifted = F.zip_with("x", b, lambda u, v: u - v)
    axis = F.zip_with(c1, b, lambda u, v: u - v)
    return (
        test.join(model, list(keys))
        .withColumn("decision", dot(shifted, axis))
        .withColumn("y_pred", (F.col("decision") > 0).cast("int"))
        .drop("centers")
    )
