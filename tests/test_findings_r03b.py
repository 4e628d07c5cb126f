"""Findings of the third review that are about size: equal rows, bounded blocks, work per row."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustframe.operators import neighbors


@pytest.mark.parametrize("p", [0.5, 1.0, 2.0, 3.0])
@pytest.mark.parametrize("dim", [2, 12])
def test_closest_is_exact(p, dim):
    """Tiles and rough sums lose no neighbour, ties go to the first."""
    rng = np.random.default_rng(3)
    ys = np.round(rng.normal(size=(2500, dim)), 1) + 1e6
    xs = np.concatenate([ys[:40], np.round(rng.normal(size=(60, dim)), 1) + 1e6])
    q, r, d = neighbors.closest(xs, ys, 4, p)
    sums = (np.abs(xs[:, None] - ys[None]) ** p).sum(axis=2)
    whole = sums if p < 1 else sums ** (1 / p)
    for i in range(len(xs)):
        near = np.sort(whole[i])[:4]
        assert np.allclose(d[q == i], near, rtol=1e-12, atol=0)
        if dim == 2:
            assert len(set(r[q == i])) == 4


def test_equal_points_are_compared_once(spark, monkeypatch):
    """F16: sixty copies of a table cost as much as one."""
    seen = []
    real = neighbors.math.isqrt
    monkeypatch.setattr(neighbors.math, "isqrt", lambda v: seen.append(v) or real(v))
    rows = spark.range(1200).select(F.col("id").alias("row_id"), F.array((F.col("id") % 20).cast("double"), F.lit(1.0)).alias("x"))
    found = neighbors.nearest(rows.withColumnRenamed("row_id", "query_id"), rows, 3, block=5).collect()
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert seen == [20 * 20 // tasks]
    assert len(found) == 3600
    got = {(r["query_id"], r["rank"]): (r["row_id"], r["distance"]) for r in found}
    assert all(got[(q, n)] == (q % 20 + 20 * (n - 1), 0.0) for q in range(1200) for n in (1, 2, 3))


def test_stacked_permutations_equal_copied_rows(spark):
    """Additive learners read each row once per batch; the scores are those of one copy per pair."""
    from trustframe.learners import GaussianBayes, NearestCentroid
    from trustframe.operators import permuting
    from trustframe.plans import association as assoc

    rng = np.random.default_rng(5)
    data = [(i, [float(v) for v in rng.normal(size=3) + (i % 3) + 1e4], i % 3) for i in range(240)]
    rows = spark.createDataFrame(data, "row_id bigint, x array<double>, y int")
    pool, spec = {"centroid": NearestCentroid(), "gnb": GaussianBayes()}, [(0, 50), (0, 10), (1, 50), (1, 10)]
    calls = []
    real = assoc._fold_means
    assoc._fold_means = lambda *a: calls.append(a) or real(*a)
    try:
        fast, corr = assoc.permutation_tables(rows, pool, 3, 3, spec, batch=3)
        assert not calls
        with_weight, same_corr = assoc.permutation_tables(rows.withColumn("w", F.lit(1.0)), pool, 3, 3, spec)
        assert calls
    finally:
        assoc._fold_means = real
    key = lambda df: {(r["perm"], r["perc"], r["model"]): r["score"] for r in df.collect()}
    a, b = key(fast), key(with_weight)
    assert a.keys() == b.keys() and len(a) == 8
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)
    assert {tuple(r) for r in corr.collect()} == {tuple(r) for r in same_corr.collect()}


def test_exchange_sees_partners_outside_the_head():
    """words that differ only by what stands among the rare words fall into different clusters."""
    from trustframe.llm.class_lm import exchange

    # 0-2 are followed by word 6 or by any other word (code 7), 3-5 by word 6 only: among the head words they look the same
    pairs = np.zeros((8, 8), np.int64)
    pairs[:3, 6], pairs[:3, 7], pairs[3:6, 6] = 50, 400, 50
    pairs[6, :6] = 20
    label = exchange(pairs, 3, rest=1)
    assert len(label) == 7 and label.max() < 3
    assert not set(label[:3]) & set(label[3:6])
    blind = exchange(pairs[:7, :7], 3)
    assert set(blind[:3]) & set(blind[3:6])
