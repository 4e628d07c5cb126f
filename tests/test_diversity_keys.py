"""Diversity by key: each dataset's measures are those of its rows alone, and every dataset is there."""

import pytest

import __spark_entry__ as entry_points
from trustframe.operators import diversity


def test_each_dataset_alone(spark):
    right = {"d1": [(1, 1, 0), (1, 0, 1), (0, 0, 1), (1, 1, 1)], "d2": [(0, 1, 0), (1, 0, 0), (1, 1, 0)]}
    rows = [(d, i, f"m{m}", 1, ok) for d, table in right.items() for i, oks in enumerate(table) for m, ok in enumerate(oks)]
    frame = spark.createDataFrame(rows, "dataset string, row_id long, model string, y_true int, y_pred int")
    tables = diversity.pair_tables(frame, keys=["dataset"])
    summary = {r["dataset"]: r for r in diversity.diversity_summary(frame, keys=["dataset"]).collect()}
    assert set(summary) == set(right)
    for d in right:
        alone = frame.where(f"dataset = '{d}'")
        assert sorted(map(tuple, tables.where(f"dataset = '{d}'").drop("dataset").collect())) == sorted(map(tuple, diversity.pair_tables(alone).collect()))
        assert tuple(summary[d])[1:] == pytest.approx(tuple(diversity.diversity_summary(alone).first()))


def test_all_datasets_are_registered(spark):
    found = entry_points.queries()["pair_tables_by_dataset"](spark, "/root/testdata/sf0.001")
    assert found.select("dataset").distinct().count() == 5


def test_members_of_unequal_subspaces(spark):
    """Each member is the learner on its own features, however many the others have."""
    from pyspark.sql import functions as F

    from trustframe.ensembles.members import Ensemble
    from trustframe.learners import GaussianBayes

    rows = spark.range(60).select(
        F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("y"),
        F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: ((F.col("id") * (i + 7) + (F.col("id") % 3) * i * 3) % 17).cast("double")).alias("x"),
    )
    spaces = [[0, 1, 2], [3], [4, 2]]
    subs = spark.createDataFrame(list(enumerate(spaces)), "member int, features array<int>")
    votes = {r.row_id: r.votes for r in Ensemble.fit(GaussianBayes(), rows, 5, 3, subs).votes(rows).collect()}
    for m, features in enumerate(spaces):
        alone = rows.withColumn("x", F.array(*[F.get("x", F.lit(i)) for i in features])).withColumn("k", F.lit(0))
        learner = GaussianBayes()
        for r in learner.predict(alone, learner.fit(alone, ["k"], len(features), 3), ["k"]).collect():
            assert votes[r.row_id][m] == r.y_pred
