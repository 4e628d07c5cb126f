"""Findings of the third review that were left: redundancy, cross-validation, diversity, trees."""

from __future__ import annotations

import threading

import numpy as np
import pytest

from trustframe.learners import GaussianBayes, NearestCentroid, growth
from trustframe.plans import redundancy as red


@pytest.mark.parametrize("n_classes", [2, 3, 10])
@pytest.mark.parametrize("whole", [True, False])
def test_class_weights_share_running_sums(n_classes, whole):
    """one running sum for several classes gives what one for each class gives."""
    rng = np.random.default_rng(n_classes)
    y = rng.integers(0, n_classes, 500)
    w = rng.integers(1, 4, 500).astype(float) if whole else rng.random(500)
    order, at = rng.permutation(500).astype(np.int32), np.arange(20, 480, 7)
    starts = at - rng.integers(0, 20, len(at))
    sums = growth._Weights(y, w, n_classes)
    assert (len(sums.words) < n_classes) == whole
    got = list(sums.below(order, starts, at))
    assert len(got) == n_classes
    for c, below in enumerate(got):
        exact = [np.where(y == c, w, 0.0)[order[a : b + 1]].sum() for a, b in zip(starts, at)]
        assert np.allclose(below, exact, rtol=1e-9, atol=1e-12)


def test_probes_of_all_models_run_side_by_side(spark, monkeypatch):
    """the jobs of one model do not wait for another's."""
    both, real = threading.Barrier(2, timeout=60), red.NestedSplits.scores

    def scores(self, *given):
        both.wait()
        return real(self, *given)

    monkeypatch.setattr(red.NestedSplits, "scores", scores)
    data = [(i, [float(i % 2), float(i % 5)], i % 2) for i in range(40)]
    rows = spark.createDataFrame(data, "row_id int, x array<double>, y int")
    found, _ = red.redundancy(rows, {"centroid": NearestCentroid(), "gnb": GaussianBayes()}, 2, 2, runs=2, alpha=0.5)
    assert found.count() == 2


def test_votes_of_a_row_need_no_shuffle_of_rows(spark):
    """Only row ids that stand on several rows are grouped; the tables are those of one row per model."""
    from pyspark.sql import functions as F

    from trustframe.operators import diversity

    rng = np.random.default_rng(4)
    ids = [*range(60), 7, 7, 11]  # some stand on several rows
    votes = [(f"d{i % 2}", i, 1, [("a", int(a)), ("b", int(b)), ("c", int(c))]) for i, (a, b, c) in zip(ids, rng.integers(0, 2, (len(ids), 3)))]
    wide = spark.createDataFrame(votes, "dataset string, row_id long, y_true int, votes array<struct<model string, y_pred int>>")
    long = wide.withColumn("v", F.explode("votes")).select("dataset", "row_id", "y_true", "v.model", "v.y_pred")
    for full in (False, True):
        a, b = (sorted(map(tuple, diversity.pair_tables(df, full, ["dataset"]).collect())) for df in (wide, long))
        assert a == b
    assert sorted(map(tuple, diversity.diversity_summary(wide, keys=["dataset"]).collect())) == sorted(map(tuple, diversity.diversity_summary(long, keys=["dataset"]).collect()))
    plain, none = diversity._repeated(wide.where("row_id not in (7, 11)"), ["dataset", "row_id"])
    assert none is None and "Exchange" not in plain._jdf.queryExecution().executedPlan().toString()


def test_summaries_of_all_learners_in_one_pass(spark):
    """one aggregate serves all learners, with the models that each gets alone."""
    from trustframe.learners import Projected
    from trustframe.plans import evaluation

    rng = np.random.default_rng(6)
    data = [("d", i % 3, [float(v) for v in rng.normal(size=3) + i % 2], i % 2) for i in range(90)]
    rows = spark.createDataFrame(data, "dataset string, fold int, x array<double>, y int")
    pool = {"centroid": NearestCentroid(), "pair": Projected(GaussianBayes(), [0, 2]), "gnb": GaussianBayes()}
    at = ["dataset", "fold"]
    found = evaluation.fold_summaries(rows, pool, at, 3)
    for name, learner in pool.items():
        alone = learner.summaries(rows, at, 3)
        assert found[name].columns == alone.columns
        for a, b in zip(found[name].orderBy(*at, "y").collect(), alone.orderBy(*at, "y").collect()):
            assert np.allclose(np.hstack([np.ravel(v) for v in a[1:]]), np.hstack([np.ravel(v) for v in b[1:]]))
