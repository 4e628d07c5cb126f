"""Nested splits and the bisection against brute force in numpy, on 90 rows of three classes."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustframe.functions.arrays import lower_bound
from trustframe.learners import GaussianBayes, NearestCentroid, Projected
from trustframe.plans import redundancy as red

RUNS, SEED = 3, 7
rng = np.random.default_rng(3)
Y = np.repeat([0, 1, 2], [50, 25, 15])
X = rng.normal(size=(90, 3)) + Y[:, None] * [0.9, 0.0, 0.4]
POOL = {"centroid": NearestCentroid(), "gnb": GaussianBayes()}


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, [float(v) for v in X[i]], int(Y[i])) for i in range(len(Y))]
    return spark.createDataFrame([*data, (900, [0.0, 0.0, 0.0], None)], "row_id int, x array<double>, y int")


def train_mask(fraction, rep):
    chosen = np.zeros(len(Y), bool)
    for c in range(3):
        own = sorted(np.flatnonzero(Y == c), key=lambda i: hashlib.md5(f"{SEED}|{rep}|{i}".encode()).hexdigest())
        chosen[own[: max(1, round(fraction * len(own)))]] = True
    return chosen


def predict(model, x, y, test):
    if model == "centroid":
        support = [-((test - x[y == c].mean(0)) ** 2).sum(1) for c in range(3)]
    else:
        var = np.array([x[y == c].var(0) for c in range(3)])
        var = np.maximum(var, var.max() * 1e-9 if var.max() > 0 else 1e-9)
        support = [
            math.log((y == c).sum()) - (0.5 * np.log(2 * np.pi * var[c]) + (test - x[y == c].mean(0)) ** 2 / (2 * var[c])).sum(1)
            for c in range(3)
        ]
    return np.argmax(support, 0)


def f1(true, got):
    total = 0.0
    for c in range(3):
        hit, sup, pre = ((true == c) & (got == c)).sum(), (true == c).sum(), (got == c).sum()
        total += sup * (2 * hit / (sup + pre) if sup + pre else 0.0)
    return total / len(true)


def brute(model, fraction, features=slice(None)):
    out = []
    for rep in range(RUNS):
        m, x = train_mask(fraction, rep), X[:, features]
        if not m.all():
            out.append(f1(Y[~m], predict(model, x[m], Y[m], x[~m])))
    return out


def test_scores_of_all_fractions(rows):
    fractions = [0.9, 0.1, 0.5, 0.25]  # any order
    splits = red.NestedSplits(rows, fractions, RUNS, SEED)
    for name, learner, features in [("centroid", POOL["centroid"], slice(None)), ("gnb", POOL["gnb"], slice(None)),
                                    ("gnb", Projected(GaussianBayes(), [0, 2]), [0, 2])]:
        found = {(r.frac_id, r.rep): r.f1 for r in splits.scores(learner, fractions, 3, 3).collect()}
        want = {(i, rep): s for i, f in enumerate(fractions) for rep, s in enumerate(brute(name, f, features))}
        assert found == pytest.approx(want, abs=1e-9)


def test_training_sets_are_nested(rows):
    splits = red.NestedSplits(rows, [0.1, 0.5, 0.9], RUNS, SEED)
    got = {}
    for r in splits.train_rows([0.1, 0.5, 0.9]).select("frac_id", "rep", "row_id").collect():
        got.setdefault((r.rep, r.frac_id), set()).add(r.row_id)
    for rep in range(RUNS):
        assert got[rep, 0] < got[rep, 1] < got[rep, 2]
        for i, f in enumerate([0.1, 0.5, 0.9]):
            assert got[rep, i] == set(np.flatnonzero(train_mask(f, rep)))


def test_bisection(rows):
    alpha = 0.05
    results, evidence = red.redundancy(rows, POOL, 3, 3, runs=RUNS, alpha=alpha, seed=SEED)
    best = max(max(brute(m, 0.9)) for m in POOL)
    want, probes = {}, 0
    for m in POOL:
        low, high, good = 0.0, 1.0, None
        while high - low > alpha:
            last = (low + high) / 2
            scores = brute(m, last)
            probes += len(scores)
            if red.passes(best, scores, alpha):
                high = good = last
            else:
                low = last
        want[m] = (1 - last, None if good is None else 1 - good)
    assert {r.model: (r.redundancy, r.redundancy_passed) for r in results.collect()} == want
    assert results.first().best_score == pytest.approx(best)
    assert evidence.count() == probes


def test_lower_bound(spark):
    values = [1, 1, 4, 9, 9, 12, 40]
    for n in range(len(values) + 1):
        table = F.array(*[F.lit(v) for v in values[:n]]).cast("array<int>")
        got = spark.range(0, 42).select("id", lower_bound(table, F.col("id"), max(n, 1)).alias("at")).collect()
        assert [r["at"] for r in got] == [sum(v < i for v in values[:n]) for i in range(42)]
