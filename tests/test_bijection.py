"""Keyed permutations, permuted labels and the status rule."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustframe.ensembles import masking
from trustframe.operators import bijection, permuting
from trustframe.plans import association


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 333])
def test_every_key_gives_a_permutation(spark, n):
    keys = bijection.round_keys(5, F.col("t"))
    rows = spark.range(n).select(F.col("id").alias("v"), F.lit(n).cast("bigint").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("t")).withColumn("keys", keys)
    both = bijection.with_permuted(rows, "to", "v", "n", "keys").withColumn("same", bijection.permuted(F.col("v"), F.col("n"), F.col("keys")))
    got = both.select("t", "v", "to", "same").toPandas()
    assert (got.to == got.same).all()
    images = [g.sort_values("v").to.to_numpy() for _, g in got.groupby("t")]
    assert all(sorted(p) == list(range(n)) for p in images)
    if n >= 50:  # fixed points and correlations are those of random permutations
        assert np.mean([(p == np.arange(n)).sum() for p in images]) == pytest.approx(1, abs=0.7)
        assert np.std([np.corrcoef(p, np.arange(n))[0, 1] for p in images]) * n**0.5 == pytest.approx(1, abs=0.4)


def test_levels_choose_and_keep_exact_counts(spark):
    rows = spark.range(500).select(F.col("id").alias("row_id"), F.when(F.col("id") < 50, 0).when(F.col("id") < 400, 1).otherwise(2).alias("y"))
    spec = permuting.spec_grid(20, [50, 30, 1])
    moved = permuting.moved_labels(rows, spec).cache()
    sizes = moved.groupBy("perm", "perc", "y_old").count().collect()
    want = {50: (25, 175, 50), 30: (15, 105, 30), 1: (0, 4, 1)}
    assert {(r.perm, r.perc, r.y_old): r["count"] for r in sizes} == {(i, p, c): n for i, p in spec for c, n in enumerate(want[p]) if n}
    before, after = ({tuple(r) for r in moved.groupBy("perm", "perc", F.col(c).alias("y")).count().collect()} for c in ("y_old", "y_new"))
    assert before == after
    fixed = permuting.moved_labels(rows, spec, redraw=False).groupBy("perc").agg(F.count_distinct("row_id").alias("n")).collect()
    assert {r.perc: r.n for r in fixed} == {50: 250, 30: 150, 1: 5}
    assert moved.groupBy("perc").agg(F.count_distinct("row_id").alias("n")).where("perc = 50").first().n > 490


def test_a_pair_that_moves_no_label_is_drawn_again(spark):
    rows = spark.range(4).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("y"))
    out = permuting.moved_labels(rows, permuting.spec_grid(200, [50]))
    still = out.groupBy("perm").agg(F.count_if(F.col("y_old") != F.col("y_new")).alias("n")).where("n = 0").count()
    assert still < 30  # two rows of two classes: half of the draws move none, five draws in a row one in 32


def status(spark, above, scores, levels=4):
    p = spark.createDataFrame([(m, 0.5 if i < n else 0.001) for m, n in zip("abc", above) for i in range(levels)], "model string, p_value double")
    return association.association_status(p, spark.createDataFrame(list(zip("abc", scores)), "model string, score double"), "abc", levels).first().status


@pytest.mark.parametrize("above, scores, want", [
    ((0, 0, 0), (0.5, 0.6, 0.7), "Good"), ((0, 0, 0), (0.5, 0.9, 0.7), "Mid"), ((0, 0, 0), (0.9, 0.5, 0.9), "Good"), ((0, 1, 0), (0.5, 0.9, 0.1), "Good"),
    ((1, 0, 0), (0.5, 0.9, 0.1), "Mid"), ((0, 4, 0), (0.5, 0.6, 0.7), "Bad"), ((2, 2, 1), (0.5, 0.6, 0.7), "Bad"), ((2, 3, 0), (0.5, 0.6, 0.7), "Mid"), ((4, 0, 0), (0.5, 0.6, 0.7), "Bad"),
])
def test_status_rule(spark, above, scores, want):
    assert status(spark, above, scores) == want


def test_steps_of_the_mask_search():
    rng = np.random.default_rng(1)
    pool = rng.random((6, 3, 40)) < 0.5
    assert (masking.mutate(pool, 0.0, rng) == pool).all() and (masking.mutate(pool, 1.0, rng) != pool).all()
    assert (masking.cross(pool, 0.0, rng) == pool).all() and (masking.cross(pool, 1.0, rng) != pool).any()
    won = masking.tournament(np.array([0.1, 0.9, 0.2]), 3000, rng)
    assert (won == 1).mean() == pytest.approx(5 / 9, abs=0.05) and (won == 0).mean() == pytest.approx(1 / 9, abs=0.05)
