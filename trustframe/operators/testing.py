"""Ranks and paired tests between models, on score tables (dataset, model, fold, metric, score)."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustframe.functions.tails import normal_critical, t_two_sided


def mean_std(scores: DataFrame, keys: Sequence[str] = ("dataset", "model", "metric")) -> DataFrame:
    """Mean and population std over folds."""
    return scores.groupBy(*keys).agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))


def mid_rank(partition: Sequence[str], order: str) -> Column:
    """Average rank of ties, ascending."""
    asc = Window.partitionBy(*partition).orderBy(order)
    ties = Window.partitionBy(*partition, order)
    return F.rank().over(asc) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def model_ranks(means: DataFrame) -> DataFrame:
    """Rank of each model per (dataset, metric) by mean score; the best has the highest."""
    return means.withColumn("rank", mid_rank(["dataset", "metric"], "mean")).select(
        "dataset", "metric", "model", "rank"
    )


def mean_ranks(ranks: DataFrame) -> DataFrame:
    return ranks.groupBy("metric", "model").agg(F.avg("rank").alias("mean_rank"))


def _differences(scores: DataFrame) -> DataFrame:
    """Score differences of every ordered pair of different models, fold by fold."""
    a = scores.select("dataset", "metric", "fold", F.col("model").alias("model_a"), F.col("score").alias("a"))
    b = scores.select("dataset", "metric", "fold", F.col("model").alias("model_b"), F.col("score").alias("b"))
    return (
        a.join(b, ["dataset", "metric", "fold"])
        .where("model_a <> model_b")
        .groupBy("dataset", "metric", "model_a", "model_b")
        .agg(
            F.count(F.lit(1)).alias("folds"),
            F.avg(F.col("a") - F.col("b")).alias("d_mean"),
            F.var_samp(F.col("a") - F.col("b")).alias("d_var"),
        )
    )


def _t_test(pairs: DataFrame, factor: Column, df: Column) -> DataFrame:
    t = F.try_divide(F.col("d_mean"), F.sqrt(factor * F.col("d_var")))
    return pairs.withColumn("t", t).withColumn("df", df.cast("int")).withColumn(
        "p_value", F.when(F.col("t").isNotNull() & (F.col("df") >= 1), t_two_sided(F.col("t"), F.col("df")))
    ).drop("d_mean", "d_var", "folds")


def ttest_corrected(scores: DataFrame, repeats: int = 5, k: int = 5) -> DataFrame:
    """Variance factor 1/(Jk) + 1/(k-1), df Jk-1. A pair without exactly J*k folds raises."""
    pairs = _differences(scores)
    wrong = F.raise_error(F.concat(F.lit(f"expected {repeats * k} scores, got "), F.col("folds").cast("string")))
    checked = pairs.withColumn(
        "d_mean", F.when(F.col("folds") == repeats * k, F.col("d_mean")).otherwise(wrong.cast("double"))
    )
    return _t_test(checked, F.lit(1 / (repeats * k) + 1 / (k - 1)), F.lit(repeats * k - 1))


def ttest_corr(scores: DataFrame, corr: float = 0.6) -> DataFrame:
    """Variance factor 1 / (k (1 - corr)), df k-1."""
    return _t_test(_differences(scores), 1.0 / (F.col("folds") * (1.0 - corr)), F.col("folds") - 1)


def ttest_paired(scores: DataFrame) -> DataFrame:
    """Variance factor 1 / J, df J-1."""
    return _t_test(_differences(scores), 1.0 / F.col("folds"), F.col("folds") - 1)


TESTS = {
    "t_test_corrected": (ttest_corrected, {"J": "repeats", "k": "k"}),
    "t_test_13": (ttest_corr, {"corr": "corr"}),
    "t_test_rel": (ttest_paired, {}),
}


def _conclusions(pairs: DataFrame, beats: Column, keys: Sequence[str], models: Sequence[str], nc: str) -> DataFrame:
    """Per model the 1-based numbers of the models it beats, ``all`` or ``nc``."""
    number = F.create_map(*[F.lit(v) for i, m in enumerate(models) for v in (m, i + 1)])
    beaten = F.array_compact(
        F.array_sort(F.collect_list(F.when(beats, F.element_at(number, F.col("model_b")))))
    )
    text = (
        F.when(F.size("beaten") == len(models) - 1, F.lit("all"))
        .when(F.size("beaten") == 0, F.lit(nc))
        .otherwise(F.array_join(F.transform("beaten", lambda v: v.cast("string")), ", "))
    )
    return (
        pairs.groupBy(*keys, F.col("model_a").alias("model"))
        .agg(beaten.alias("beaten"))
        .select(*keys, "model", text.alias("conclusion"))
    )


def paired_conclusions(
    scores: DataFrame, models: Sequence[str], test: str = "t_test_corrected", alpha: float = 0.05,
    nc: str = "---", **options: float,
) -> DataFrame | None:
    """(dataset, metric, model, conclusion); model i beats j iff p < alpha and t > 0."""
    if test not in TESTS:
        warnings.warn(f"{test} is not a supported test. Use one of: {', '.join(TESTS)}.", stacklevel=2)
        return None
    run, known = TESTS[test]
    unknown = [o for o in options if o not in known]
    if unknown:
        warnings.warn(f"{', '.join(unknown)} not supported by {test} and ignored", stacklevel=2)
    pairs = run(scores, **{known[o]: v for o, v in options.items() if o in known})
    beats = (F.col("p_value") < alpha) & (F.col("t") > 0)
    return _conclusions(pairs, beats, ["dataset", "metric"], models, nc)


def rank_sum_z(ranks: DataFrame) -> DataFrame:
    """Rank-sum z (normal approximation, no tie correction) of each ordered pair of models.

    The two samples are the models' ranks over the datasets.
    """
    a = ranks.select("metric", F.col("model").alias("model_a"))
    pairs = (
        a.distinct()
        .join(ranks.select("metric", F.col("model").alias("model_b")).distinct(), "metric")
        .where("model_a <> model_b")
    )
    sides = pairs.select("*", F.explode(F.array(F.col("model_a"), F.col("model_b"))).alias("model"))
    pooled = sides.join(ranks, ["metric", "model"]).withColumn(
        "r", mid_rank(["metric", "model_a", "model_b"], "rank")
    )
    mine = F.col("model") == F.col("model_a")
    n1, n2 = F.count_if(mine), F.count_if(~mine)
    z = (F.sum(F.when(mine, F.col("r"))) - n1 * (n1 + n2 + 1) / 2.0) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0)
    return pooled.groupBy("metric", "model_a", "model_b").agg(z.alias("z"))


def global_ranks(ranks: DataFrame, models: Sequence[str], alpha: float = 0.05, nc: str = "---") -> DataFrame:
    """(metric, model, mean_rank, conclusion) from the rank-sum test over datasets."""
    beats = F.col("z") > normal_critical(alpha)
    concluded = _conclusions(rank_sum_z(ranks), beats, ["metric"], models, nc)
    return mean_ranks(ranks).join(concluded, ["metric", "model"])


def score_table(means: DataFrame, models: Sequence[str], std: bool = False) -> DataFrame:
    """Dataset rows and model columns with 3 decimals, then the mean-rank row, per metric."""
    cell = F.format_string("%.3f", F.col("mean"))
    if std:
        cell = F.concat(cell, F.lit(" +- "), F.format_string("%.3f", F.col("std")))
    body = means.withColumn("cell", cell).groupBy("metric", "dataset").pivot("model", list(models)).agg(F.first("cell"))
    ranks = (
        mean_ranks(model_ranks(means))
        .withColumn("cell", F.format_string("%.3f", F.col("mean_rank")))
        .groupBy("metric")
        .pivot("model", list(models))
        .agg(F.first("cell"))
        .withColumn("dataset", F.lit("mean ranks"))
    )
    return body.unionByName(ranks)
