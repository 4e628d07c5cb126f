"""Findings of the third review about time: trees to pure leaves, votes of many members, signed ranks, draws."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustframe.ensembles import undersampled
from trustframe.ensembles.members import Ensemble
from trustframe.learners import DecisionTree, GaussianBayes, NearestCentroid, RandomForest, growth, trees
from trustframe.learners.base import Learner
from trustframe.operators import sampling

TREES = "row_id int, x array<double>, y int, k int"


def noise(spark, n, copies=1):
    rng = np.random.default_rng(n)
    rows = [([float(v) for v in rng.integers(0, 40, 3)], int(rng.integers(0, 3))) for _ in range(n)]
    return spark.createDataFrame([(c * n + i, x, y, 0) for c in range(copies) for i, (x, y) in enumerate(rows)], TREES)


def test_equal_rows_train_once(spark, monkeypatch):
    """a tree of sixty copies of a table is grown on one, with the weights of all."""
    seen = []
    real = trees.grow_trees
    monkeypatch.setattr(trees, "grow_trees", lambda rows, *a, **b: seen.append(rows.count()) or real(rows, *a, **b))
    one, many = (DecisionTree().fit(noise(spark, 50, copies), ["k"], 3, 3).first()["forest"][0] for copies in (1, 60))
    assert seen == [50, 50]
    assert one["f"] == many["f"] and one["t"] == many["t"]
    assert [[60 * v for v in c] for c in one["counts"]] == many["counts"]


def test_a_forest_is_scored_tree_by_tree(spark):
    """no row holds a whole forest when rows are scored; a model that was written and read back scores the same."""
    data = noise(spark, 200)
    learner = RandomForest(trees=4, balanced=True)
    model = learner.fit(data, ["k"], 3, 3)
    sizes = model.by_tree.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("tree").alias("t")).collect()
    assert [tuple(r) for r in sizes] == [(0, 4, 4)]
    apart, packed = ({r["row_id"]: r["supports"] for r in learner.supports(data, m, ["k"]).collect()} for m in (model, model.select("*")))
    assert apart == packed and len(apart) == 200


@pytest.mark.parametrize("tries", [2, 1])
def test_a_level_is_split_at_once(monkeypatch, tries):
    """as many steps as levels, not as nodes; leaves are pure."""
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(4000, 2)), rng.integers(0, 3, 4000)
    calls = []
    real = growth._best_cuts
    monkeypatch.setattr(growth, "_best_cuts", lambda *a: calls.append(1) or real(*a))
    tree = growth.exact_tree(x, y, np.ones(4000), 3, tries, np.random.default_rng(0))
    assert len(calls) == tree["depth"] < 200 and len(tree["f"]) > 2000
    at = np.zeros(4000, dtype=int)
    f, t, left, right = (np.array(tree[n]) for n in ("f", "t", "left", "right"))
    for _ in range(tree["depth"]):
        at = np.where(left[at] < 0, at, np.where(x[np.arange(4000), f[at]] > t[at], right[at], left[at]))
    assert (np.array(tree["counts"])[at].argmax(axis=1) == y).all()


@pytest.mark.parametrize("learner", [GaussianBayes(), NearestCentroid()])
def test_members_score_whole_batches_as_the_expression_does(spark, learner, monkeypatch):
    """the same supports and votes, also for rows with missing values."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=3) + i % 3], i % 3, i % 4) for i in range(200)]
    train = spark.createDataFrame(rows, "row_id int, x array<double>, y int, member int")
    odd = [(900, [None, 1.0, 2.0], 0, 0), (901, [0.5], 1, 0), (902, None, 2, 0), (903, [float("nan"), 0.0, 1.0], 2, 0), (904, [3.0, 1e9, 0.0], 2, 0)]
    test = train.unionByName(spark.createDataFrame(odd, train.schema)).drop("member")
    subs = spark.createDataFrame([(0, [0, 2]), (1, [1, 1])], "member int, features array<int>")
    for ensemble in (Ensemble.fit(learner, train, 3, 3), Ensemble.fit(learner, train.drop("member"), 3, 3, subs)):
        found = []
        for arrays in (type(learner).arrays, Learner.arrays):
            monkeypatch.setattr(type(learner), "arrays", arrays)
            plan = ensemble.supports(test)._jdf.queryExecution().optimizedPlan().toString()
            assert ("ArrowEvalPython" in plan) == (arrays is not Learner.arrays)
            found.append([{r["row_id"]: r[1] for r in f.collect()} for f in (ensemble.supports(test).select("row_id", "esm"), ensemble.votes(test).select("row_id", "votes"))])
        monkeypatch.undo()
        (fast, fast_votes), (slow, slow_votes) = found
        assert fast_votes == slow_votes and fast.keys() == slow.keys() and len(fast) == 205
        for i in fast:
            if slow[i] is not None:
                assert np.allclose(np.array(fast[i], dtype=float), np.array(slow[i], dtype=float), rtol=1e-13, atol=1e-15, equal_nan=True)


def test_bounds_decide_as_exact_ranks(spark, monkeypatch):
    """no pair of rows and members is formed for pairs of members that the counts decide; the segments are those of the exact test."""
    rng = np.random.default_rng(4)
    base = rng.random(400)
    esm = np.stack([base, base + rng.normal(0.002, 0.02, 400), base + 0.01, base + rng.normal(0, 0.02, 400), np.round(base, 2), base], axis=1)
    data = spark.createDataFrame([(i, [[float(v), 1 - float(v)] for v in row]) for i, row in enumerate(esm)], "row_id int, esm array<array<double>>")
    k = 5
    differences = spark.createDataFrame([(i, j, float(row[i] - row[j])) for row in esm for i in range(k) for j in range(i + 1, k)], "i int, j int, d double")
    exact = {(r["i"], r["j"]): abs(r["z"]) for r in undersampled.wilcoxon(differences, ["i", "j"]).collect()}
    for fine in (0, 4, 9):
        bounds = {(r["i"], r["j"]): (r["low"], r["high"]) for r in undersampled.rank_bounds(list(exact), data, fine).collect()}
        assert bounds.keys() == exact.keys() and all(bounds[p][0] <= z * (1 + 1e-9) and z <= bounds[p][1] * (1 + 1e-9) for p, z in exact.items())
    wanted = list(range(k + 1))
    for (i, j), z in sorted(exact.items()):
        if z > 2.5758293035489004:
            wanted[i] = j
    ranked = []
    real = undersampled.wilcoxon
    monkeypatch.setattr(undersampled, "wilcoxon", lambda d, keys: ranked.append(d.count()) or real(d, keys))

    class Given:
        def supports(self, rows):
            return data

    parts = undersampled.BalancedParts(Given(), k, [1.0] * (k + 1))
    for fine in (0, 7):
        assert undersampled.member_segments(data, parts, fine=fine) == wanted
    assert sum(ranked) < 2 * 400 * len(exact)


def test_draws_are_dealt_once(spark):
    """slots and rows meet by one shuffle of the slots."""
    rows = spark.range(500).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("y"))
    found = sampling.stratified_bootstrap(rows, 4)
    sums = found.groupBy("member", "y").agg(F.sum("w").alias("w")).collect()
    assert {(r["member"], r["y"]): r["w"] for r in sums} == {(m, y): float(len(range(y, 500, 3))) for m in range(4) for y in range(3)}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = found.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange hashpartitioning") == 2
