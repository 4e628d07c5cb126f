"""Exact order statistics without putting a group into one task.

A class may hold a third of all rows, so ``row_number() over (partition by class)``
would sort a third of the table in one task. These operators split every group by
the leading hex digits of its hash key (or by approximate quantiles for numeric
keys), count the pieces, and only then look inside a piece:

* ``key_cutoffs``: the key at given ranks of each group. Rows are compared with a
  cutoff map-side, so choosing "the first q rows of each class" shuffles only the
  rows of the one piece in which rank q falls.
* ``hash_rank``: the full rank, one shuffle on (group, piece).
* ``running_sums``: cumulative sums in the order of a numeric column.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustframe.operators.storage import settle, settle_small


def piece_digits(spark: SparkSession) -> int:
    """Leading hex digits that split a group into about 8 pieces per shuffle partition."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return min(5, max(1, math.ceil(math.log(parts * 8, 16))))


def _pieces(rows: DataFrame, groups: Sequence[str], key: str, digits: int) -> DataFrame:
    counts = (
        rows.groupBy(*groups, F.substring(key, 1, digits).alias("piece"))
        .agg(F.count(F.lit(1)).alias("piece_n"))
    )
    earlier = Window.partitionBy(*groups).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    return settle(
        counts.withColumn("before", F.coalesce(F.sum("piece_n").over(earlier), F.lit(0))), "pieces"
    )


def key_cutoffs(
    rows: DataFrame,
    groups: Sequence[str],
    targets: Callable[[DataFrame], DataFrame],
    key: str = "order_key",
    row_id: str = "row_id",
) -> DataFrame:
    """Keys at chosen ranks: one row (groups, [tags], target, cut) per target.

    ``targets`` maps group totals (groups, n) to (groups, [tags], target). A row is
    among the first ``target`` rows of its group iff ``struct(key, row_id) <= cut``.
    Targets below 1 give no row.
    """
    digits = piece_digits(rows.sparkSession)
    pieces = _pieces(rows, groups, key, digits)
    totals = pieces.groupBy(*groups).agg(F.sum("piece_n").alias("n"))
    wanted = targets(totals)
    located = settle_small(
        pieces.join(wanted.drop("n"), list(groups))
        .where((F.col("target") > F.col("before")) & (F.col("target") <= F.col("before") + F.col("piece_n"))),
        "located",
    )
    inside = Window.partitionBy(*groups, "piece").orderBy(key, row_id)
    edge = (
        rows.select(*groups, key, row_id, F.substring(key, 1, digits).alias("piece"))
        .join(located.select(*groups, "piece").distinct(), [*groups, "piece"], "left_semi")
        .withColumn("rn", F.row_number().over(inside))
    )
    return settle_small(
        edge.join(located, [*groups, "piece"])
        .where(F.col("rn") == F.col("target") - F.col("before"))
        .withColumn("cut", F.struct(F.col(key).alias("k"), F.col(row_id).alias("i")))
        .drop("piece", "piece_n", "before", "rn", key, row_id),
        "cutoffs",
    )


def at_most(cut: Column, key: str = "order_key", row_id: str = "row_id") -> Column:
    """True when the row's (key, row_id) is not beyond ``cut``."""
    return (F.col(key) < cut["k"]) | ((F.col(key) == cut["k"]) & (F.col(row_id) <= cut["i"]))


def first_rows(
    rows: DataFrame,
    groups: Sequence[str],
    quota: Callable[[DataFrame], DataFrame],
    key: str = "order_key",
    row_id: str = "row_id",
    flag: str | None = None,
) -> DataFrame:
    """The first ``target`` rows of every group in key order.

    ``quota`` maps (groups, n) to (groups, target). With ``flag``, all rows are kept
    and a boolean column tells the chosen ones.
    """
    cuts = key_cutoffs(rows, groups, quota, key, row_id).select(*groups, "cut")
    if flag is None:
        return rows.join(cuts, list(groups)).where(at_most(F.col("cut"), key, row_id)).drop("cut")
    return (
        rows.join(cuts, list(groups), "left")
        .withColumn(flag, F.coalesce(at_most(F.col("cut"), key, row_id), F.lit(False)))
        .drop("cut")
    )


def even_blocks(
    rows: DataFrame,
    groups: Sequence[str],
    k: int,
    out: str = "fold",
    key: str = "order_key",
    row_id: str = "row_id",
) -> DataFrame:
    """Splits each group into ``k`` contiguous blocks in key order; the first n mod k
    blocks are one row longer. No row is shuffled except at the block borders."""

    def borders(totals: DataFrame) -> DataFrame:
        part = F.explode(F.sequence(F.lit(1), F.lit(k - 1))).alias("border")
        size = F.floor(F.col("n") / k)
        return totals.select("*", part).withColumn(
            "target", (F.col("border") * size + F.least(F.col("border"), F.col("n") % k)).cast("bigint")
        )

    if k < 2:
        return rows.withColumn(out, F.lit(0))
    cuts = key_cutoffs(rows, groups, borders, key, row_id)
    per_group = settle_small(
        cuts.groupBy(*groups).agg(F.sort_array(F.collect_list("cut")).alias("cuts")), "borders"
    )
    beyond = F.size(F.filter("cuts", lambda c: ~at_most(c, key, row_id)))
    return (
        rows.join(per_group, list(groups), "left")
        .withColumn(out, F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(beyond).cast("int"))
        .drop("cuts")
    )


def hash_rank(
    rows: DataFrame,
    groups: Sequence[str],
    out: str = "rank",
    key: str = "order_key",
    row_id: str = "row_id",
) -> DataFrame:
    """Exact 1-based rank in key order inside each group, split by key prefix."""
    digits = piece_digits(rows.sparkSession)
    pieces = _pieces(rows, groups, key, digits).drop("piece_n")
    inside = Window.partitionBy(*groups, "piece").orderBy(key, row_id)
    return (
        rows.withColumn("piece", F.substring(key, 1, digits))
        .withColumn("rn", F.row_number().over(inside))
        .join(pieces, [*groups, "piece"])
        .withColumn(out, (F.col("rn") + F.col("before")).cast("bigint"))
        .drop("rn", "before", "piece")
    )


def running_sums(
    points: DataFrame,
    groups: Sequence[str],
    order: str,
    sums: Sequence[str],
    suffix: str = "_before",
    pieces: int = 64,
) -> DataFrame:
    """Adds ``<col><suffix>``: the sum of ``col`` over smaller ``order`` values of the
    group. ``points`` must hold each order value once per group (aggregate first)."""
    fractions = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    edges = settle_small(
        points.groupBy(*groups).agg(
            F.array_distinct(F.percentile_approx(order, fractions, 1000)).alias("edges")
        ),
        "edges",
    )
    placed = (
        points.join(edges, list(groups))
        .withColumn("piece", F.size(F.filter("edges", lambda e: e < F.col(order))))
        .drop("edges")
    )
    earlier = Window.partitionBy(*groups).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*groups, "piece").agg(*[F.sum(c).alias(c) for c in sums])
    offsets = settle_small(
        totals.select(
            *groups, "piece", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums]
        ),
        "offsets",
    )
    inside = (
        Window.partitionBy(*groups, "piece").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = placed.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_l_{c}") for c in sums])
    joined = local.join(offsets, [*groups, "piece"])
    return joined.select(
        *points.columns, *[(F.col(f"_l_{c}") + F.col(f"_o_{c}")).alias(f"{c}{suffix}") for c in sums]
    )
