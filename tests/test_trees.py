"""Trees to pure leaves against a plain greedy tree in Python, and the growth of nodes too large for one task."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustframe.ensembles.members import Ensemble
from trustframe.learners import DecisionTree, Projected, RandomForest
from trustframe.learners.growth import best_cut, exact_tree, grow_trees

SCHEMA = "row_id int, x array<double>, y int, k int"


def gini(labels):
    return sum(labels.count(c) ** 2 for c in set(labels)) / len(labels)


def plain_tree(rows, room=math.inf):
    """Nested tuples (feature, threshold, left, right), or the class counts of a leaf."""
    labels = [y for _, y in rows]
    best = None
    if len(set(labels)) > 1 and room > 0:
        for f in range(len(rows[0][0])):
            values = sorted({x[f] for x, _ in rows})
            for low, high in zip(values, values[1:]):
                gain = gini([y for x, y in rows if x[f] <= low]) + gini([y for x, y in rows if x[f] > low])
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, f, (low + high) / 2)
    if best is None:
        return [labels.count(c) for c in range(3)]
    _, f, t = best
    return (f, t, plain_tree([r for r in rows if r[0][f] <= t], room - 1), plain_tree([r for r in rows if r[0][f] > t], room - 1))


def nested(tree, node=0):
    if tree["left"][node] < 0:
        return tree["counts"][node]
    return (tree["f"][node], tree["t"][node], nested(tree, tree["left"][node]), nested(tree, tree["right"][node]))


def noisy(n, dim, seed, grid=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) if grid is None else rng.integers(0, grid, size=(n, dim)).astype(float)
    y = np.where(rng.random(n) < 0.2, rng.integers(0, 3, n), (x[:, 0] > np.median(x[:, 0])).astype(int) + (x[:, -1] > 1))
    return [([float(v) for v in a], int(b)) for a, b in zip(x, y)]


def frame(spark, rows, k=0):
    return spark.createDataFrame([(i, x, y, k) for i, (x, y) in enumerate(rows)], SCHEMA)


def one_tree(model):
    return model.first()["forest"][0].asDict()


@pytest.mark.parametrize("n, dim, grid, room", [(60, 3, None, None), (80, 2, 4, None), (60, 3, None, 2), (2, 1, None, None), (50, 2, 2, None)])
def test_equals_a_plain_greedy_tree(n, dim, grid, room):
    rows = noisy(n, dim, n + dim, grid)
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    tree = exact_tree(x, y, np.ones(n), 3, dim, np.random.default_rng(0), -1 if room is None else room)
    assert nested(tree) == plain_tree(rows, math.inf if room is None else room)


def test_in_spark_with_replicates(spark):
    parts = {k: noisy(50 + k, 3, k) for k in range(3)}
    rows = frame(spark, parts[0]).unionByName(frame(spark, parts[1], 1)).unionByName(frame(spark, parts[2], 2))
    model = DecisionTree().fit(rows, ["k"], 3, 3)
    got = {r["k"]: nested(r["forest"][0].asDict()) for r in model.collect()}
    assert got == {k: plain_tree(p) for k, p in parts.items()}
    wrong = DecisionTree().predict(rows, model, ["k"]).where("y <> y_pred").count()
    assert wrong == 0  # pure leaves hold the training rows


def test_large_nodes_equal_small_ones_on_few_values(spark):
    """Up to 255 distinct values all are cut points, so growth by levels finds the same partition as one task."""
    rows = frame(spark, noisy(400, 3, 5, grid=6))
    whole, levels = DecisionTree(), DecisionTree(task_cells=3 * 150)
    test = spark.createDataFrame([(i, [float(v) for v in np.unravel_index(i, (6, 6, 6))], 0, 0) for i in range(216)], SCHEMA)

    def supports(learner):
        found = learner.supports(test, learner.fit(rows, ["k"], 3, 3), ["k"])
        return {r["row_id"]: [s["support"] for s in r["supports"]] for r in found.collect()}

    a, b = supports(whole), supports(levels)
    seen = {tuple(r["x"]) for r in rows.collect()}
    places = [r["row_id"] for r in test.collect() if tuple(r["x"]) in seen]
    assert len(places) > 100 and all(a[i] == b[i] for i in places)


def test_levels_reach_pure_leaves(spark):
    rows = frame(spark, noisy(600, 2, 9))
    learner = DecisionTree(task_cells=2 * 200)
    model = learner.fit(rows, ["k"], 2, 3)
    assert learner.predict(rows, model, ["k"]).where("y <> y_pred").count() == 0
    tree = one_tree(model)
    assert tree["depth"] > 5 and len(tree["f"]) == len(tree["counts"]) == 1 + 2 * sum(v >= 0 for v in tree["left"])


def test_hot_value_and_rows_that_cannot_be_split(spark):
    """A third of the rows share one point and disagree about its class; the node of them is a leaf."""
    rows = [([0.0, 1.0], i % 2) for i in range(100)] + noisy(200, 2, 3)
    learner = DecisionTree(task_cells=2 * 90)
    data = frame(spark, rows)
    model = learner.fit(data, ["k"], 2, 3)
    at = learner.supports(data.where("row_id = 0"), model, ["k"]).first()["supports"]
    assert [round(s["support"], 9) for s in at] == [0.5, 0.5, 0.0]
    assert learner.predict(data, model, ["k"]).where("row_id >= 100 AND y <> y_pred").count() == 0


def test_expression_and_slices_agree(spark):
    data = frame(spark, noisy(120, 4, 2))
    for learner in (DecisionTree(), RandomForest(trees=3, balanced=True, depth=3)):
        model = learner.fit(data, ["k"], 4, 3)
        test = data.unionByName(spark.createDataFrame([(900, [None, 1.0, float("nan"), 0.0], 0, 0), (901, [0.5], 1, 0), (902, None, 2, 0)], SCHEMA))
        sliced = {r["row_id"]: r["supports"] for r in learner.supports(test, model, ["k"]).collect()}
        joined = {r["row_id"]: r["s"] for r in test.join(model, "k").withColumn("s", learner.score_classes(F.col("x"))).collect()}
        for row, s in sliced.items():
            if row != 902:
                assert [v["support"] for v in s] == pytest.approx([v["support"] for v in joined[row]])
        assert len(sliced) == 123 and sum(v["support"] for v in sliced[902]) == pytest.approx(1)


def test_missing_values_and_labels(spark):
    nan = float("nan")
    data = spark.createDataFrame(
        [(0, [None, 1.0], 0, 0), (1, [1.0, 1.0], 1, 0), (2, [nan, 1.0], 2, 0), (3, [2.0, 1.0], None, 0), (4, [1.0, 1.0], 1, 0)], SCHEMA
    )
    learner = DecisionTree()
    found = learner.predict(data, learner.fit(data, ["k"], 2, 3), ["k"]).orderBy("row_id").collect()
    assert [r["y_pred"] for r in found] == [0, 1, 2, 2, 1]


def test_empty_training_and_keys_without_a_model(spark):
    data = frame(spark, noisy(20, 2, 1))
    learner = DecisionTree()
    nothing = learner.fit(data.where("k = 5"), ["k"], 2, 3)
    assert nothing.count() == 0 and learner.predict(data, nothing, ["k"]).count() == 0
    model = learner.fit(data, ["k"], 2, 3)
    assert learner.predict(data.withColumn("k", F.lit(7)), model, ["k"]).count() == 0
    assert learner.predict(data.where("k = 9"), model, ["k"]).count() == 0


def test_min_rows_and_forest(spark):
    data = frame(spark, noisy(200, 4, 8))
    coarse = one_tree(DecisionTree(min_rows=50).fit(data, ["k"], 4, 3))
    inner = [sum(c) for c, left in zip(coarse["counts"], coarse["left"]) if left >= 0]
    assert inner and min(inner) >= 50
    learner = RandomForest(trees=6, task_cells=4 * 120)
    model = learner.fit(data, ["k"], 4, 3)
    first, again = (m.first()["forest"] for m in (model, learner.fit(data.repartition(7), ["k"], 4, 3)))
    assert first == again and len(first) == 6
    assert len({str(t["f"]) for t in first}) > 3  # members differ
    assert learner.predict(data, model, ["k"]).where("y = y_pred").count() > 170


def test_features_are_drawn_among_those_that_vary():
    x = np.array([[1.0, 0.0, 1.0], [1.0, 1.0, 1.0]])
    order = np.argsort(x, axis=0, kind="stable")
    for seed in range(5):
        assert best_cut(x, np.array([0, 1]), np.ones(2), order, np.array([1.0, 1.0]), 1, np.random.default_rng(seed)) == (1, 0.5)


def test_projected_and_in_an_ensemble(spark):
    data = frame(spark, noisy(150, 3, 4))
    learner = Projected(DecisionTree(), [2, 0])
    model = learner.fit(data, ["k"], 3, 3)
    found = learner.predict(data, model, ["k"])
    assert found.where("y <> y_pred").count() == 0 and set(found.columns) == {*data.columns, "y_pred"}
    subspaces = spark.createDataFrame([(0, [0, 1]), (1, [2, 0])], "member int, features array<int>")
    ensemble = Ensemble.fit(DecisionTree(), data.drop("k", "row_id"), 3, 3, subspaces)
    votes = ensemble.votes(data).collect()
    assert all(r["votes"][1] == r["y"] for r in votes)
