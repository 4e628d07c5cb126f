"""Label codes, scaling and class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustframe.operators.storage import settle_small, with_row


def label_codes(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, y): codes 0.. in the label's own order. The window runs over distinct labels."""
    distinct = df.where(F.col(label).isNotNull()).select(label).distinct()
    order = Window.partitionBy(F.lit(1)).orderBy(label)
    return settle_small(distinct.withColumn("y", (F.row_number().over(order) - 1).cast("int")), "codes")


def label_encode(df: DataFrame, label: str = "label") -> DataFrame:
    return df.join(label_codes(df, label), label)


def class_sizes(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    return settle_small(df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_class")), "sizes")


def minmax_scale(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(x - min) / (max - min) over the whole table; a constant feature becomes 0."""
    low = [F.min(c).cast("double").alias(f"lo_{c}") for c in features]
    high = [F.max(c).cast("double").alias(f"hi_{c}") for c in features]
    found = df.agg(*low, *high).first()  # two numbers per feature

    def scaled(c: str) -> Column:
        lo, hi = found[f"lo_{c}"], found[f"hi_{c}"]
        if lo is None or hi <= lo:
            return F.when(F.col(c).isNotNull(), F.lit(0.0))
        return (F.col(c) - F.lit(lo)) / F.lit(hi - lo)

    return df.withColumns({c: scaled(c) for c in features})


def standard_scale(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(x - mean) / population std; a zero std divides by 1."""
    means = [F.avg(c).alias(f"m_{c}") for c in features]
    spreads = [F.stddev_pop(c).alias(f"s_{c}") for c in features]
    found = df.agg(*means, *spreads).first()  # two numbers per feature
    return df.withColumns(
        {c: (F.col(c) - F.lit(found[f"m_{c}"])) / F.lit(found[f"s_{c}"] or 1.0) for c in features}
    )


def minmax_vectors(rows: DataFrame, x: str = "x") -> DataFrame:
    """Min-max scaling of an array column, element by element."""
    dim = rows.select(F.size(x).alias("d")).first()["d"]
    bounds = settle_small(
        rows.agg(
            F.array(*[F.min(F.get(x, F.lit(i))) for i in range(dim)]).alias("lo"),
            F.array(*[F.max(F.get(x, F.lit(i))) for i in range(dim)]).alias("hi"),
        ),
        "bounds",
    )
    scaled = F.transform(
        F.arrays_zip(F.col(x).alias("v"), F.col("lo").alias("lo"), F.col("hi").alias("hi")),
        lambda e: F.coalesce(F.try_divide(e["v"] - e["lo"], e["hi"] - e["lo"]), F.lit(0.0)),
    )
    return with_row(rows, bounds).withColumn(x, scaled).drop("lo", "hi")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``w = n / (classes * n_class)``: every class weighs the same in total."""
    sizes = class_sizes(df.where(F.col(label).isNotNull()), [label])
    every = Window.partitionBy(F.lit(1))
    weights = settle_small(
        sizes.select(
            label,
            (F.sum("n_class").over(every) / (F.count(F.lit(1)).over(every) * F.col("n_class"))).alias("w"),
        ),
        "weights",
    )
    return df.join(weights, label)
