"""Counts that describe a labelled feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustframe.functions.arrays import pack
from trustframe.operators.storage import settle_small, with_row


def class_count(df: DataFrame, label: str = "label") -> DataFrame:
    """Number of classes; ``multiclass`` is set above two and NULL otherwise."""
    n = df.where(F.col(label).isNotNull()).groupBy(label).count().agg(F.count(F.lit(1)).alias("classes"))
    return n.withColumn("multiclass", F.when(F.col("classes") > 2, F.lit(True)))


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return (
        df.where(F.col(label).isNotNull())
        .groupBy(label)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), label)
    )


def imbalance_ratio(df: DataFrame, label: str = "label") -> DataFrame:
    """Class size over smallest class, exact and rounded half to even, and over the largest."""
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(1))
    return sizes.select(
        label,
        "n",
        (F.col("n") / F.min("n").over(every)).alias("ratio"),
        F.bround(F.col("n") / F.min("n").over(every), 0).cast("bigint").alias("ratio_rounded"),
        (F.max("n").over(every) / F.min("n").over(every)).alias("majority_over_minority"),
    )


def feature_inventory(df: DataFrame, label: str, hidden: Sequence[str] = ("row_id",)) -> DataFrame:
    """Row count, feature count without the label and feature list with it."""
    names = [c for c in df.columns if c not in hidden]
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        F.lit(len(names) - 1).cast("bigint").alias("features"),
        F.array(*[F.lit(c) for c in names]).alias("feature_list"),
    )


def row_profile(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """Row count, class count and per-column missing counts in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(label).alias("classes"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in [*features, label]],
    )


def feature_scores(df: DataFrame, features: Sequence[str], label: str = "label", k: int = 10) -> DataFrame:
    """Top-k features by one-way ANOVA F of the feature over the classes.

    One grouped aggregate gives sums per class; F follows from those.
    """
    sums = settle_small(
        df.where(F.col(label).isNotNull()).groupBy(label).agg(
            F.count(F.lit(1)).alias("n"),
            *[F.struct(
                F.avg(c).alias("m"), F.var_pop(c).alias("v")).alias(c) for c in features],
        ),
        "anova",
    )
    long = sums.select(
        "n", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("s")) for c in features])).alias("e")
    ).select("n", "e.feature", "e.s.m", "e.s.v")
    grand = long.groupBy("feature").agg(
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("classes"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand_mean"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
    )
    between = (
        long.join(grand, "feature")
        .groupBy("feature", "total", "classes", "within")
        .agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand_mean"), 2)).alias("between"))
    )
    f_value = F.try_divide(
        F.try_divide(F.col("between"), F.col("classes") - 1),
        F.try_divide(F.col("within"), F.col("total") - F.col("classes")),
    )
    return (
        between.select("feature", f_value.alias("score"))
        .orderBy(F.desc("score"), "feature")
        .limit(k)
    )


def principal_axes(rows: DataFrame, k: int, x: str = "x"):
    """Mean vector (1-row frame) and the fitted PCA model for rows centred by it.

    Spark's PCA is a distributed covariance; its ``transform`` does not centre, so
    the rows are centred first.
    """
    dim = rows.select(F.size(x).alias("d")).first()["d"]
    mean = settle_small(rows.agg(F.array(*[F.avg(F.get(x, F.lit(i))) for i in range(dim)]).alias("mean")), "mean")
    return mean, PCA(k=k, inputCol="v", outputCol="pc").fit(_centred(rows, mean, x))


def _centred(rows: DataFrame, mean: DataFrame, x: str = "x") -> DataFrame:
    return with_row(rows, mean).withColumn("v", array_to_vector(F.zip_with(x, "mean", lambda a, b: a - b)))


def pca_projection(df: DataFrame, features: Sequence[str], row_id: str = "row_id", k: int = 2) -> DataFrame:
    """Coordinates of every row on the first k principal axes of the centred features."""
    rows = df.select(row_id, pack(features).alias("x"))
    mean, model = principal_axes(rows, k)
    out = model.transform(_centred(rows, mean)).withColumn("p", vector_to_array("pc"))
    return out.select(row_id, *[F.get("p", F.lit(i)).alias(f"pc{i + 1}") for i in range(k)])


def axis_table(model, k: int) -> list[list[float]]:
    """Loadings of a PCA model: k lists of one value per feature (k*d numbers)."""
    pc = model.pc.toArray()
    return [[float(v) for v in pc[:, i]] for i in range(k)]


__all__ = [
    "class_count", "class_distribution", "imbalance_ratio", "feature_inventory", "row_profile",
    "feature_scores", "principal_axes", "pca_projection", "axis_table",
]
