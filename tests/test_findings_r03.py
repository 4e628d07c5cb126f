"""Repeated row ids, exact cuts of large nodes, folds from one pass: what the third review found."""

import pytest
from pyspark.sql import functions as F
from test_trees import frame, nested, noisy, plain_tree

from trustframe.ensembles import undersampled
from trustframe.learners import DecisionTree, GaussianBayes, NearestCentroid, Projected
from trustframe.learners.growth import grow_trees
from trustframe.operators import cleaning, diversity
from trustframe.plans.evaluation import cv_predictions, cv_votes, training_folds


def test_listing_with_repeated_row_ids(spark):
    """One row id on several rows of a group, on rows of two groups, and missing."""
    rows = [("a", 1.0, None), ("a", 1.0, None), ("b", 1.0, None), ("a", 2.0, "x"), ("c", 2.0, "x"), (None, 3.0, "y"), (None, 3.0, "y"), ("d", float("nan"), "z"), ("d", float("nan"), "z")]
    df = spark.createDataFrame(rows, "row_id string, v double, label string")
    got = sorted(str(tuple(r)) for r in cleaning.duplicate_listing(df, ["v", "label"]).collect())
    assert got == ["('a', 1.0, None)", "('b', 1.0, None)", "('c', 2.0, 'x')", "('d', nan, 'z')", "(None, 3.0, 'y')"]


def test_large_nodes_are_cut_exactly(spark):
    """Cuts between quantiles, halfway between two values, as in a plain greedy tree."""
    rows = noisy(900, 3, 11)
    data = frame(spark, rows).drop("k").withColumn("w", F.lit(1.0))
    tree = grow_trees(data.withColumn("g", F.lit(0)), ["g"], 3, 3, depth=3, bins=4, task_cells=3 * 100).first().asDict()
    assert nested(tree) == plain_tree(rows, 3)


def test_votes_of_all_models_stand_in_one_row(spark):
    """Models made from summaries of the other folds predict as models trained on these folds; diversity reads either form."""
    rows = frame(spark, noisy(300, 3, 4)).withColumns({"dataset": (F.col("row_id") % 2).cast("string"), "fold": F.floor(F.col("row_id") / 2).cast("int") % 3}).drop("k")
    learners = {"centroid": NearestCentroid(), "gnb": GaussianBayes(), "tree": DecisionTree(depth=2), "pair": Projected(GaussianBayes(), [2, 0])}
    votes = cv_votes(rows, learners, 3, 3, 3)
    assert votes.count() == 600 and votes.where(F.size("votes") == 3).count() == 300
    long = cv_predictions(rows, learners, 3, 3, 3)
    got = {(r["model"], r["row_id"]): (r["dataset"], r["fold"], r["y_true"], r["y_pred"]) for r in long.collect()}
    for name, learner in learners.items():
        model = learner.fit(training_folds(rows, 3), ["dataset", "fold"], 3, 3)
        for r in learner.predict(rows, model, ["dataset", "fold"]).collect():
            assert got.pop((name, r["row_id"])) == (r["dataset"], r["fold"], r["y"], r["y_pred"])
    assert not got
    tables = [sorted(map(str, diversity.pair_tables(f, full=True, keys=["dataset"]).collect())) for f in (votes, long)]
    assert tables[0] == tables[1] and len(tables[0]) == 32


def test_regular_mode_trains_only_what_it_sums(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i * i % 11)], int(i % 5 == 0)) for i in range(60)], "row_id int, x array<double>, y int")
    lean, whole = (undersampled.fit_parts(rows, GaussianBayes(), 2, regular=r) for r in (True, False))
    votes = [{r["row_id"]: r["y_pred"] for r in undersampled.cube_vote(rows, p).collect()} for p in (lean, whole)]
    assert votes[0] == votes[1] and len(votes[0]) == 60 and lean.k == whole.k == 4
    assert lean.ensemble.votes(rows).select(F.size("votes")).first()[0] == 4
    with pytest.raises(ValueError):
        undersampled.cube_vote(rows, lean, "weighted")
