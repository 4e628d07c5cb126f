"""Diversity of an ensemble from its predictions (row_id, model, y_true, y_pred), for each value of ``keys`` if there are any.
Predictions may also hold all models of a row in one: (row_id, y_true, votes: array<struct<model, y_pred>>).

Rows are first reduced to their pattern of right and wrong models; pairs are formed
on the distinct patterns with their counts, not on the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe.operators.storage import settle, settle_small

TINY = 1e-12  # stands in for a zero divisor of the Q-statistic


def hit_patterns(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(*keys, pattern: sorted array<struct<model, ok>>, n)."""
    def ok(y_pred: Column) -> Column:
        return (F.col("y_true") == y_pred).cast("int").alias("ok")

    if "votes" in predictions.columns:
        each = F.transform("votes", lambda v: F.struct(v["model"].alias("model"), ok(v["y_pred"])))
        single, repeated = _repeated(predictions.select(*keys, "row_id", "y_true", "votes"), [*keys, "row_id"])
        # rows are counted by their votes as they are; the pattern is made for the few different ones
        counted = single.groupBy(*keys, "y_true", "votes").agg(F.count(F.lit(1)).alias("n")).select(*keys, F.array_sort(each).alias("pattern"), "n")
        if repeated is not None:
            joined = repeated.groupBy(*keys, "row_id").agg(F.array_sort(F.flatten(F.collect_list(each))).alias("pattern"))
            counted = counted.unionByName(joined.select(*keys, "pattern", F.lit(1).cast("bigint").alias("n")))
        return settle(counted.groupBy(*keys, "pattern").agg(F.sum("n").alias("n")), "patterns")
    found = F.collect_list(F.struct("model", ok(F.col("y_pred"))))
    rows = predictions.groupBy(*keys, "row_id").agg(F.array_sort(found).alias("pattern"))
    return settle(rows.groupBy(*keys, "pattern").agg(F.count(F.lit(1)).alias("n")), "patterns")


def _repeated(rows: DataFrame, at: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose values of ``at`` stand on no other row, and all others, None if there are none.

    To tell them apart, 64-bit hashes are shuffled, not rows. Values that only share a hash count as repeated.
    """
    named = rows.withColumn("_h", F.xxhash64(*at))
    again = settle_small(named.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h"), "again")
    if again.isEmpty():
        return rows, None
    return named.join(again, "_h", "left_anti").drop("_h"), named.join(again, "_h", "left_semi").drop("_h")


def pair_tables(predictions: DataFrame, full: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """(*keys, model_a, model_b, n00, n01, n10, n11): joint correctness, a < b unless ``full``."""
    return _pair_tables(hit_patterns(predictions, keys), full, keys)


def _pair_tables(wide: DataFrame, full: bool, keys: Sequence[str]) -> DataFrame:
    pairs = (
        wide.select(*keys, "n", "pattern", F.explode("pattern").alias("a"))
        .select(*keys, "n", "a", F.explode("pattern").alias("b"))
        .select(*keys, "n", F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b"),
                F.col("a.ok").alias("ok_a"), F.col("b.ok").alias("ok_b"))
    )
    if not full:
        pairs = pairs.where("model_a < model_b")

    def cell(i: int, j: int) -> Column:
        return F.sum(F.when((F.col("ok_a") == i) & (F.col("ok_b") == j), F.col("n")).otherwise(0))

    return pairs.groupBy(*keys, "model_a", "model_b").agg(
        cell(0, 0).alias("n00"), cell(0, 1).alias("n01"), cell(1, 0).alias("n10"), cell(1, 1).alias("n11")
    )


def _n(name: str) -> Column:
    return F.col(name).cast("double")


def q_statistic() -> Column:
    same, differ = _n("n11") * _n("n00"), _n("n01") * _n("n10")
    divisor = same + differ
    return (same - differ) / F.when(divisor == 0, F.lit(TINY)).otherwise(divisor)


def pair_correlation() -> Column:
    sides = (_n("n11") + _n("n10")) * (_n("n01") + _n("n00")) * (_n("n11") + _n("n01")) * (_n("n10") + _n("n00"))
    return F.try_divide(_n("n11") * _n("n00") - _n("n01") * _n("n10"), F.sqrt(sides))


def _all() -> Column:
    return _n("n00") + _n("n01") + _n("n10") + _n("n11")


def disagreement() -> Column:
    return (_n("n01") + _n("n10")) / _all()


def double_fault() -> Column:
    return _n("n00") / _all()


def pair_measures(predictions: DataFrame, full: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    return _pair_measures(hit_patterns(predictions, keys), full, keys)


def _pair_measures(wide: DataFrame, full: bool, keys: Sequence[str]) -> DataFrame:
    return _pair_tables(wide, full, keys).select(
        *keys,
        "model_a",
        "model_b",
        q_statistic().alias("q_statistic"),
        pair_correlation().alias("correlation"),
        disagreement().alias("disagreement"),
        double_fault().alias("double_fault"),
    )


def _pattern_size() -> Column:
    return F.size("pattern")


def entropy_e(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """mean((L//2 - |right - L//2|) / (L/2)) over rows, L models; one row, or one for each value of ``keys``."""
    right = F.aggregate("pattern", F.lit(0), lambda acc, p: acc + p["ok"])
    half = F.floor(_pattern_size() / 2)
    value = (half - F.abs(right - half)) / (_pattern_size() / 2.0)
    return hit_patterns(predictions, keys).groupBy(*keys).agg((F.sum(value * F.col("n")) / F.sum("n")).alias("entropy"))


def diversity_summary(predictions: DataFrame, p: float | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """One row, or one for each value of ``keys``: entropy, kappa, kw_variance, disagreement, q_statistic.

    Kappa needs the mean member accuracy ``p``; it is measured when not given.
    """
    wide = hit_patterns(predictions, keys)
    right = F.aggregate("pattern", F.lit(0), lambda acc, e: acc + e["ok"])
    half = F.floor(_pattern_size() / 2)
    per_row = wide.groupBy(*keys).agg(
        (F.sum((half - F.abs(right - half)) / (_pattern_size() / 2.0) * F.col("n")) / F.sum("n")).alias("entropy"),
        F.max(_pattern_size()).alias("members"),
        (F.sum(right / _pattern_size() * F.col("n")) / F.sum("n")).alias("p_measured"),
    )
    pairs = _pair_measures(wide, False, keys).groupBy(*keys).agg(
        F.avg("disagreement").alias("disagreement"), F.avg("q_statistic").alias("q_statistic")
    )
    accuracy = F.col("p_measured") if p is None else F.lit(float(p))
    both = settle_small(per_row, "per_row")
    row = pairs.join(both, list(keys)) if keys else pairs.select(
        "*", *[both.select(c).scalar().alias(c) for c in ("entropy", "members", "p_measured")]
    )
    return row.select(
        *keys,
        "entropy",
        (1 - F.try_divide(F.col("disagreement"), 2 * accuracy * (1 - accuracy))).alias("kappa"),
        ((F.col("members") - 1) / (2.0 * F.col("members")) * F.col("disagreement")).alias("kw_variance"),
        "disagreement",
        "q_statistic",
    )
