"""Radius-kernel classifier over a bounded memory of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustframe.learners.base import best_class
from trustframe.operators.storage import settle, settle_small, with_row

MEMORY = 250  # rows kept by default


def last_rows(rows: DataFrame, seq: str, memory: int = MEMORY) -> DataFrame:
    """The newest ``memory`` rows (a distributed top-k)."""
    return rows.orderBy(F.desc(seq)).limit(memory)


def kernel_model(memory_rows: DataFrame, dim: int) -> DataFrame:
    """One row: scaling of the memory and its scaled rows by class. At most ``memory`` rows."""
    xs = [F.get("x", F.lit(i)) for i in range(dim)]
    moments = memory_rows.agg(
        F.array(*[F.avg(v) for v in xs]).alias("mean"),
        F.array(*[F.when(F.stddev_pop(v) == 0, 1.0).otherwise(F.stddev_pop(v)) for v in xs]).alias("std"),
    )
    scale = settle_small(moments, "scale")
    classes = scaled(memory_rows, scale).groupBy("y").agg(
        F.collect_list("z").alias("rows"), F.count(F.lit(1)).alias("n")
    )
    packed = classes.agg(F.array_sort(F.collect_list(F.struct(F.col("y").alias("c"), "n", "rows"))).alias("classes"))
    return settle(
        packed.select("classes", scale.select("mean").scalar().alias("mean"), scale.select("std").scalar().alias("std")),
        "kernel",
    )


def scaled(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Adds ``z``, ``x`` on the memory's scale."""
    centred = F.zip_with("x", "mean", lambda v, m: v - m)
    z = F.zip_with(centred, "std", lambda v, s: v / s)
    return with_row(rows, model.select("mean", "std")).withColumn("z", z).drop("mean", "std")


def default_radius(test: DataFrame, model: DataFrame, dim: int) -> float:
    """Sum of the stds of the scaled test features; fixed at first use by the caller."""
    z = scaled(test, model)
    stds = [F.stddev_pop(F.get("z", F.lit(i))) for i in range(dim)]
    total = stds[0]
    for s in stds[1:]:
        total = total + s
    return z.agg(total.alias("r")).first()["r"]


def radius_kernel(test: DataFrame, model: DataFrame, radius: float) -> DataFrame:
    """Adds ``supports`` (sum of max(0, r - distance) over class rows / class rows) and y_pred.

    The memory is at most a few hundred rows in one array, so every test row is scored
    where it is, without a join.
    """
    def support(m):
        near = F.aggregate(
            m["rows"],
            F.lit(0.0),
            lambda acc, r: acc
            + F.greatest(
                F.lit(0.0),
                F.lit(radius)
                - F.sqrt(
                    F.aggregate(
                        F.zip_with("z", r, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v
                    )
                ),
            ),
        )
        return F.struct(m["c"].alias("c"), (near / m["n"]).alias("support"))

    return (
        with_row(scaled(test, model), model.select("classes"))
        .withColumn("supports", F.transform("classes", support))
        .withColumn("y_pred", best_class(F.col("supports")))
        .drop("z", "classes")
    )
