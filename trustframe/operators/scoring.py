"""Classification scores from one confusion aggregate, plus rank-based scores.

Predictions are reduced to (keys, y_true, y_pred, n) first; everything after works
on at most classes**2 rows per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustframe.operators.ordering import running_sums


def confusion(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    return predictions.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def per_class(conf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, c, tp, support, predicted) for every class seen as truth or prediction."""
    zero = F.lit(0).cast("bigint")
    views = F.array(
        F.struct(
            F.col("y_true").alias("c"),
            F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(zero).alias("tp"),
            F.col("n").alias("support"),
            zero.alias("predicted"),
        ),
        F.struct(F.col("y_pred").alias("c"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("predicted")),
    )
    return (
        conf.select(*keys, F.explode(views).alias("v"))
        .select(*keys, "v.*")
        .groupBy(*keys, "c")
        .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    )


def _or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def _f_beta(beta: float) -> Column:
    b2 = beta * beta
    return _or_zero((1 + b2) * F.col("tp"), b2 * F.col("support") + F.col("predicted"))


def score_table_wide(conf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All support-weighted and accuracy-type scores per key in one pass."""
    keys = list(keys)
    classes = per_class(conf, keys)
    totals = classes.groupBy(*keys).agg(F.sum("support").alias("total"))
    c = classes.join(totals, keys)
    weight = F.col("support") / F.col("total")
    fp = F.col("predicted") - F.col("tp")
    tn = F.col("total") - F.col("support") - fp
    s = F.col("total").cast("double")
    tp, sup, pred = (F.col(n).cast("double") for n in ("tp", "support", "predicted"))
    cov_tp = F.sum(tp) * F.max(s) - F.sum(sup * pred)
    var_t = F.pow(F.max(s), 2) - F.sum(sup * sup)
    var_p = F.pow(F.max(s), 2) - F.sum(pred * pred)
    return c.groupBy(*keys).agg(
        F.sum(weight * _or_zero(F.col("tp"), F.col("predicted"))).alias("precision"),
        F.sum(weight * _or_zero(F.col("tp"), F.col("support"))).alias("recall"),
        F.sum(weight * _f_beta(1.0)).alias("f1"),
        F.sum(weight * _f_beta(2.0)).alias("f2"),
        F.sum(weight * _or_zero(tn, tn + fp)).alias("specificity"),
        F.avg(F.when(F.col("support") > 0, F.col("tp") / F.col("support"))).alias("bac"),
        (F.sum(tp) / F.max(s)).alias("accuracy"),
        _or_zero(cov_tp, F.sqrt(var_t * var_p)).alias("mcc"),
    )


SCORES = ("precision", "recall", "f1", "f2", "specificity", "bac", "accuracy", "mcc")


def score_long(conf: DataFrame, keys: Sequence[str], metrics: Sequence[str] = SCORES) -> DataFrame:
    """(keys, metric, score)."""
    wide = score_table_wide(conf, keys)
    return wide.unpivot(list(keys), list(metrics), "metric", "score")


def balanced_accuracy_closed(conf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean recall where a class's rows count only if predicted as some true class."""
    keys = list(keys)
    truths = conf.groupBy(*keys, F.col("y_true").alias("y_pred")).agg(F.lit(1).alias("known"))
    inside = conf.join(truths, [*keys, "y_pred"], "left")
    recalls = inside.groupBy(*keys, "y_true").agg(
        F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("hit"),
        F.sum(F.when(F.col("known") == 1, F.col("n")).otherwise(0)).alias("rows"),
    )
    return recalls.groupBy(*keys).agg(F.avg(F.try_divide("hit", "rows")).alias("bac_closed"))


def tpr_fpr(conf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rates of class 1 against class 0, its prevalence, and the precision they imply."""
    def cell(t: int, p: int) -> Column:
        return F.sum(F.when((F.col("y_true") == t) & (F.col("y_pred") == p), F.col("n")).otherwise(0))

    rates = conf.groupBy(*keys).agg(
        F.try_divide(cell(1, 1), cell(1, 1) + cell(1, 0)).alias("tpr"),
        F.try_divide(cell(0, 1), cell(0, 1) + cell(0, 0)).alias("fpr"),
        F.try_divide(F.sum(F.when(F.col("y_true") == 1, F.col("n")).otherwise(0)), F.sum("n")).alias("prevalence"),
    )
    up = F.col("prevalence") * F.col("tpr")
    down = (1 - F.col("prevalence")) * F.col("fpr")
    ptf = F.when((F.col("tpr") == 0) & (F.col("fpr") == 0), F.lit(0.0)).otherwise(F.try_divide(up, up + down))
    return rates.withColumn("ptf", ptf)


def _score_points(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    return scored.groupBy(*keys, "score").agg(
        F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") != 1).alias("neg")
    )


def roc_auc(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rank-sum form: P(score of a positive > score of a negative) + half the ties.

    ``scored`` has (keys, y_true in {0, 1}, score). Equal scores are merged first.
    """
    points = running_sums(_score_points(scored, keys), keys, "score", ["neg"])
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    return points.groupBy(*keys).agg(
        F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc")
    )


def average_precision(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of precision times recall gain over falling score thresholds."""
    flipped = scored.withColumn("score", -F.col("score"))
    points = running_sums(_score_points(flipped, keys), keys, "score", ["pos", "neg"])
    seen_pos = F.col("pos_before") + F.col("pos")
    precision = seen_pos / (seen_pos + F.col("neg_before") + F.col("neg"))
    return points.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("pos") * precision), F.sum("pos")).alias("average_precision")
    )


def explained_variance(pairs: DataFrame, keys: Sequence[str], y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    return pairs.groupBy(*keys).agg(
        (1 - F.try_divide(F.var_pop(F.col(y) - F.col(y_hat)), F.var_pop(y))).alias("explained_variance")
    )


def trapezoid_auc(points: DataFrame, keys: Sequence[str], order: str, x: str, y: str) -> DataFrame:
    """Area under (x, y) in ``order``; NULL unless x is monotone. For summary tables:
    one window per key over its few levels."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = points.withColumns({"_dx": F.col(x) - F.lag(x).over(w), "_h": F.col(y) + F.lag(y).over(w)})
    area = F.sum(F.col("_dx") * F.col("_h")) / 2.0
    return step.groupBy(*keys).agg(
        F.when(F.coalesce(F.min("_dx"), F.lit(0.0)) >= 0, area)
        .when(F.max("_dx") <= 0, -area)
        .alias("area")
    )


def slope(points: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    return points.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")
    )


def label_corr(rows: DataFrame, keys: Sequence[str], a: str = "y", b: str = "y_perm") -> DataFrame:
    """Pearson correlation of two code columns; NULL when one of them is constant."""
    same = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    n, sa, sb = F.count(F.lit(1)).cast("double"), F.sum(a).cast("double"), F.sum(b).cast("double")
    sab = F.sum(F.col(a).cast("double") * F.col(b))
    saa = F.sum(F.col(a).cast("double") * F.col(a))
    sbb = F.sum(F.col(b).cast("double") * F.col(b))
    r = F.try_divide(n * sab - sa * sb, F.sqrt(n * saa - sa * sa) * F.sqrt(n * sbb - sb * sb))
    return rows.groupBy(*keys).agg(F.when(~same, r).alias("corr"))
