"""Association: do the labels belong to the features? A permutation test.

Stages, each a table: baseline scores, permuted labels, scores and label correlations
per permutation, p-values, slopes, score and status.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustframe.learners.base import Learner
from trustframe.learners.stacked import stack_labels, stacked_confusion, stacked_moments
from trustframe.learners.trees import prepared
from trustframe.operators.permuting import Spec, class_ranks, permutation_levels, permuted_labels, spec_grid
from trustframe.operators.sampling import stratified_kfold
from trustframe.operators.scoring import confusion, label_corr, score_table_wide, slope, trapezoid_auc
from trustframe.operators.storage import settle, settle_small
from trustframe.plans.evaluation import training_folds

PERCENTAGES, PERMUTATIONS, FOLDS = (50, 30, 10, 1), 100, 2  # fixed default values
P_LIMIT = 0.01
MODEL_NUMBERS = 1 << 20  # means that the models of a batch hold in a task
BATCH_ROWS = 500_000  # copies of rows up to which more pairs go into a batch: its jobs are many, whatever their size


def _fold_means(rows: DataFrame, learners: Mapping[str, Learner], keys: list[str], dim: int, n_classes: int) -> DataFrame:
    """(keys, model, score): mean over folds of the weighted F1; ``rows`` carries fold and y."""
    with_fold = [*keys, "fold"]
    parts = []
    for name, learner in learners.items():
        model = learner.fit(training_folds(rows, FOLDS), with_fold, dim, n_classes)
        predicted = learner.predict(rows, model, with_fold).withColumnRenamed("y", "y_true")
        f1 = score_table_wide(confusion(predicted, with_fold), with_fold)
        mean = f1.groupBy(*keys).agg(F.avg("f1").alias("score")) if keys else f1.agg(F.avg("f1").alias("score"))
        parts.append(mean.withColumn("model", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def association_baseline(
    rows: DataFrame, learners: Mapping[str, Learner], dim: int, n_classes: int, seed: int = 1410
) -> DataFrame:
    """(model, score) on the true labels."""
    rows = prepared(rows, learners.values(), dim)
    folds = stratified_kfold(rows, FOLDS, seed=seed)
    return _fold_means(folds, learners, [], dim, n_classes)


def _plain(rows: DataFrame, dim: int, n_classes: int) -> bool:
    """Whether numpy sums the rows as Spark does: no weights, no missing feature, labels that are class codes."""
    gap = F.col("x").isNull() | (F.size("x") != dim) | F.exists("x", lambda v: v.isNull() | F.isnan(v))
    odd = gap | F.col("y").isNull() | ~F.col("y").between(0, n_classes - 1)
    return "w" not in rows.columns and rows.where(odd).isEmpty()


def _stacked_means(
    labelled: DataFrame, features: DataFrame, learners: Mapping[str, Learner], pairs: Spec, dim: int, n_classes: int
) -> DataFrame:
    """(perm, perc, model, score) as ``_fold_means``, for learners with summaries: a row meets all ``pairs`` where it is."""
    stacked = settle(stack_labels(labelled, features, ["perm", "perc"], n_classes), "stacked")
    moments = settle(stacked_moments(stacked, len(pairs), FOLDS, dim, n_classes), "moments")
    at = ["pair", "fold"]
    parts = []
    for name, learner in learners.items():
        model = learner.fit_summaries(training_folds(moments, FOLDS), at, dim)
        f1 = score_table_wide(stacked_confusion(stacked, learner, model, len(pairs), dim, n_classes), at)
        parts.append(f1.groupBy("pair").agg(F.avg("f1").alias("score")).withColumn("model", F.lit(name)))
    numbers = labelled.sparkSession.createDataFrame([(r, i, p) for r, (i, p) in enumerate(pairs)], "pair int, perm int, perc int")
    return reduce(DataFrame.unionByName, parts).join(numbers, "pair").select("perm", "perc", "score", "model")


def permutation_tables(
    rows: DataFrame,
    learners: Mapping[str, Learner],
    dim: int,
    n_classes: int,
    spec: Spec,
    seed: int = 1410,
    redraw: bool = True,
    batch: int = 80,
) -> tuple[DataFrame, DataFrame]:
    """perm_scores (perm, perc, model, score) and perm_corr (perm, perc, corr).

    Permuted labels serve for training, testing and fold assignment. Rows are ranked once. Permutations are
    handled in batches of about ``batch`` (perm, perc) pairs, which bounds the size of
    the intermediate tables independently of the number of permutations. Learners with summaries read each row once
    per batch; the others read it once per pair and fold.
    """
    rows = prepared(rows, learners.values(), dim)
    ranked = settle(class_ranks(rows.select("row_id", "y"), seed), "ranked")
    features = rows.drop("y")
    scores, corrs = [], []
    additive = {name: m for name, m in learners.items() if m.summaries(rows.limit(0), ["row_id"], dim) is not None}
    if additive and not _plain(rows, dim, n_classes):
        additive = {}
    others = {name: m for name, m in learners.items() if name not in additive}
    if others and not additive:
        batch = max(batch, BATCH_ROWS // max(1, ranked.count()))
    batch = max(1, min(batch, MODEL_NUMBERS // (FOLDS * n_classes * dim))) if additive else batch
    for start in range(0, len(spec), batch):
        levels = permutation_levels(ranked, list(spec[start : start + batch]), seed, redraw)
        long = settle(permuted_labels(ranked, levels).drop("is_chosen"), "permuted")
        corrs.append(settle_small(label_corr(long, ["perm", "perc"]), "corr"))
        relabelled = long.drop("y").withColumnRenamed("y_perm", "y")
        folds = settle(stratified_kfold(relabelled, FOLDS, keys=["perm", "perc"], seed=seed), "folds")
        if additive:
            pairs = sorted(set(spec[start : start + batch]))
            scores.append(settle_small(_stacked_means(folds, features, additive, pairs, dim, n_classes), "scores"))
        if others:
            tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))  # given: few bytes hold much work
            whole = settle(folds.join(features, "row_id").repartition(tasks, "row_id", "perm", "perc"), "folds")
            scores.append(settle_small(_fold_means(whole, others, ["perm", "perc"], dim, n_classes), "scores"))
    return reduce(DataFrame.unionByName, scores), reduce(DataFrame.unionByName, corrs)


def perm_pvalues(baseline: DataFrame, perm_scores: DataFrame) -> DataFrame:
    """(model, perc, p_value) = (permutations reaching the baseline + 1) / (permutations + 1)."""
    joined = perm_scores.join(baseline.withColumnRenamed("score", "true_score"), "model")
    reached = F.count_if(F.col("score") >= F.col("true_score"))
    return joined.groupBy("model", "perc").agg(
        ((reached + 1.0) / (F.count(F.lit(1)) + 1)).alias("p_value")
    )


def level_means(perm_scores: DataFrame, perm_corr: DataFrame, levels: Sequence[int] = PERCENTAGES) -> DataFrame:
    """(model, level, perc, corr, score): means over permutations, levels in given order."""
    order = F.create_map(*[F.lit(v) for i, p in enumerate(levels) for v in (p, i)])
    means = perm_scores.groupBy("model", "perc").agg(F.avg("score").alias("score"))
    corr = perm_corr.groupBy("perc").agg(F.avg("corr").alias("corr"))
    return means.join(corr, "perc").withColumn("level", F.element_at(order, F.col("perc")))


def perm_slopes(points: DataFrame) -> DataFrame:
    """(model, slope, intercept, area) of mean score against mean correlation."""
    areas = trapezoid_auc(points, ["model"], "level", "corr", "score")
    return slope(points, ["model"], "corr", "score").join(areas, "model")


def association_score(points: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """One row: envelope area, max_clf_score, association, max |slope| and its model.

    ``max_clf_score`` is the envelope at the last (smallest) permutation level;
    ``baseline_f1`` is the best unpermuted score.
    """
    envelope = points.groupBy("level").agg(
        F.max("corr").alias("corr"), F.greatest(F.lit(0.0), F.max("score")).alias("score")
    ).withColumn("k", F.lit(0))
    last = envelope.groupBy("k").agg(F.max_by("score", "level").alias("max_clf_score"))
    area = trapezoid_auc(envelope, ["k"], "level", "corr", "score").join(last, "k")
    slopes = perm_slopes(points).agg(
        F.max(F.abs("slope")).alias("max_slope"),
        F.max_by("model", F.abs("slope")).alias("max_slope_model"),
        F.max_by("model", F.abs("area")).alias("max_area_model"),
    )
    steepest = settle_small(slopes, "slopes")
    out = area.select(
        F.col("area").alias("envelope_area"),
        "max_clf_score",
        ((0.5 - F.try_divide(F.col("area"), F.col("max_clf_score"))) / 0.25).alias("association"),
        *[steepest.select(c).scalar().alias(c) for c in steepest.columns],
    )
    if baseline is not None:
        best = settle_small(baseline.agg(F.max("score").alias("b")), "best")
        out = out.withColumn("baseline_f1", best.scalar())
    return out


def association_status(pvalues: DataFrame, baseline: DataFrame, models: Sequence[str], levels: int) -> DataFrame:
    """One row (status), from the p-values above the limit, counted over the models in order.

    Bad if the count is ``levels`` after some model. Else Good if the last model without any p-value above the limit
    so far has the best score so far; Mid if it has not, or if there is no such model; null if there is no model.
    """
    order = F.create_map(*[F.lit(v) for i, m in enumerate(models) for v in (m, i)])
    above = pvalues.groupBy("model").agg(F.count_if(F.col("p_value") > P_LIMIT).alias("above"))
    so_far = Window.partitionBy(F.lit(0)).orderBy("pos")  # one row per model
    counted = above.join(baseline, "model").withColumn("pos", F.element_at(order, F.col("model"))).select(
        "pos", F.sum("above").over(so_far).alias("c"), (F.col("score") >= F.greatest(F.lit(0.0), F.max("score").over(so_far))).alias("leads"),
    )
    clean_lead = F.max_by("leads", F.when(F.col("c") == 0, F.col("pos")))
    return counted.agg(
        F.when(F.bool_or(F.col("c") == levels), "Bad").when(clean_lead, "Good").when(F.bool_or(F.col("c") < levels), "Mid").alias("status")
    )


def association(
    rows: DataFrame,
    learners: Mapping[str, Learner],
    dim: int,
    n_classes: int,
    nperm: int = PERMUTATIONS,
    perc: Sequence[int] = PERCENTAGES,
    seed: int = 1410,
    redraw: bool = True,
) -> dict[str, DataFrame]:
    """All tables of the test, ``result`` being the one-row summary."""
    rows = prepared(rows, learners.values(), dim)
    baseline = settle_small(association_baseline(rows, learners, dim, n_classes, seed), "baseline")
    scores, corr = permutation_tables(rows, learners, dim, n_classes, spec_grid(nperm, perc), seed, redraw)
    pvalues = settle_small(perm_pvalues(baseline, scores), "pvalues")
    points = settle_small(level_means(scores, corr, perc), "points")
    status = association_status(pvalues, baseline, list(learners), len(perc))
    result = association_score(points, baseline).withColumn("status", settle_small(status, "status").scalar())
    return {
        "baseline": baseline, "perm_scores": scores, "perm_corr": corr, "pvalues": pvalues,
        "slopes": perm_slopes(points), "result": result,
    }

