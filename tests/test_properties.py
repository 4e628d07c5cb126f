"""Properties over the small tables, and brute force for what SQL does not cover."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustframe.checks import tables
from trustframe.ensembles import masking, subspaces
from trustframe.ensembles.members import Ensemble, hard_vote, soft_vote
from trustframe.learners import Boosting, DecisionTree, GaussianBayes, NearestCentroid, RandomForest
from trustframe.operators import ordering, permuting, sampling
from trustframe.operators.neighbors import nearest
from trustframe.operators.storage import settle, settle_small, with_row
from trustframe.streaming import chunks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lines(spark):
    return settle(tables.vectors(spark, SF), "lines")


@pytest.fixture(scope="module")
def blobs(spark):
    """Three separable classes in two features plus two features of noise."""
    rng = np.random.default_rng(5)
    centres = np.array([[0.0, 0.0], [6.0, 0.0], [0.0, 6.0]])
    rows = [
        (i, [float(v) for v in (*(centres[i % 3] + rng.normal(0, 1, 2)), *rng.normal(0, 1, 2))], i % 3) for i in range(600)
    ]
    return settle(spark.createDataFrame(rows, "row_id int, x array<double>, y int").withColumn("k", F.lit(0)), "blobs")


def accuracy(predicted):
    return predicted.agg(F.avg((F.col("y") == F.col("y_pred")).cast("double"))).first()[0]


@pytest.mark.parametrize("learner", [
    NearestCentroid(), GaussianBayes(), DecisionTree(depth=4), RandomForest(trees=8, depth=4), Boosting(rounds=3, depth=2),
    RandomForest(trees=4, depth=3, balanced=True),
])
def test_learners_separate_blobs(blobs, learner):
    model = learner.fit(blobs, ["k"], 4, 3)
    assert accuracy(learner.predict(blobs, model, ["k"])) > 0.95
    supports = learner.supports(blobs, model, ["k"]).limit(5).collect()
    assert all({s["c"] for s in r["supports"]} == {0, 1, 2} for r in supports)


def test_replicates_are_independent(blobs):
    """A stacked fit gives each replicate the model it would get alone."""
    both = sampling.replicate(blobs.drop("k"), [0, 1], "k").where("k = 0 OR row_id % 2 = 0")
    learner = DecisionTree(depth=3)
    from trustframe.learners.trees import prepared

    ready = prepared(both, [learner], 4)
    stacked = learner.fit(ready, ["k"], 4, 3)
    alone = learner.fit(ready.where("k = 1"), ["k"], 4, 3)
    test = blobs.drop("k").withColumn("k", F.lit(1))
    a = learner.predict(test, stacked, ["k"]).select("row_id", "y_pred").orderBy("row_id").collect()
    b = learner.predict(test, alone, ["k"]).select("row_id", "y_pred").orderBy("row_id").collect()
    assert a == b


def test_shuffled_labels_give_chance(blobs):
    mixed = blobs.withColumn("y", F.pmod(F.hash(F.col("row_id") * 31 + 7), F.lit(3)))
    learner = GaussianBayes()
    assert accuracy(learner.predict(mixed, learner.fit(mixed, ["k"], 4, 3), ["k"])) < 0.5


def test_permutation_keeps_label_counts(lines):
    out = permuting.permute_labels(lines, permuting.spec_grid(2, [50, 1]))
    before = out.groupBy("perm", "perc", "y").count().collect()
    after = out.groupBy("perm", "perc", F.col("y_perm").alias("y")).count().collect()
    assert sorted(map(tuple, before)) == sorted(map(tuple, after))
    assert out.where("y <> y_perm").select("perm", "perc").distinct().count() == 4


@pytest.mark.parametrize("parts", [1, 8, 200])
def test_same_result_under_any_partitioning(spark, lines, parts):
    """Also with more pieces per class: the digits follow the shuffle partitions."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        folds = sampling.stratified_kfold(lines.repartition(parts).select("row_id", "y"), 5)
        ranks = ordering.hash_rank(sampling.keyed(folds, 3), ["y"])
        total = ranks.agg(
            F.sum(F.crc32(F.concat_ws("|", "row_id", "fold", "rank").cast("binary"))).alias("s")
        ).first()["s"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    seen = test_same_result_under_any_partitioning.__dict__.setdefault("seen", total)
    assert total == seen


def test_hot_group_ranks(spark):
    """One class holds nearly all rows; ranks stay exact and complete."""
    rows = spark.range(20000).select(F.col("id").alias("row_id"), (F.col("id") % 50 == 0).cast("int").alias("y"))
    ranked = ordering.hash_rank(sampling.keyed(rows, 1), ["y"])
    found = ranked.groupBy("y").agg(F.count_distinct("rank").alias("d"), F.max("rank").alias("m"), F.count("*").alias("n"))
    assert all(r["d"] == r["m"] == r["n"] for r in found.collect())


def test_running_sums_match_numpy(spark):
    rng = np.random.default_rng(2)
    values = np.unique(rng.normal(size=3000))
    df = spark.createDataFrame([("g", float(v), 1) for v in values], "g string, v double, n int")
    out = ordering.running_sums(df, ["g"], "v", ["n"], pieces=7).orderBy("v").collect()
    assert [r["n_before"] for r in out] == list(range(len(values)))


@pytest.mark.parametrize(("p", "block"), [(2.0, 4096), (2.0, 40), (1.0, 60), (0.5, 50)])
def test_nearest_is_exact(spark, p, block):
    """Brute force, with a dense spot that holds a third of the rows."""
    rng = np.random.default_rng(3)
    base = np.concatenate([rng.normal(size=(200, 3)), np.repeat([[0.5, 0.5, 0.5]], 100, axis=0)])
    asked = rng.normal(size=(40, 3))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "row_id int, x array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id int, x array<double>")
    got = {}
    for r in nearest(queries, rows, 5, p, block).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["row_id"]
    for q, v in enumerate(asked):
        d = (np.abs(base - v) ** p).sum(axis=1)
        want = sorted(range(len(base)), key=lambda i: (d[i], i))[:5]
        assert [got[q][k] for k in range(1, 6)] == want


def test_nearest_with_few_base_rows(spark):
    rows = spark.createDataFrame([(1, [0.0])], "row_id int, x array<double>")
    queries = spark.createDataFrame([(7, [3.0])], "query_id int, x array<double>")
    assert [tuple(r) for r in nearest(queries, rows, 5).collect()] == [(7, 1, 1, 3.0)]


def test_votes_agree_on_clear_rows(blobs):
    train = sampling.stratified_bootstrap(blobs.drop("k"), 3)
    ensemble = Ensemble.fit(GaussianBayes(), train, 4, 3)
    assert accuracy(soft_vote(blobs, ensemble)) > 0.95 and accuracy(hard_vote(blobs, ensemble)) > 0.95


def test_bootstrap_draws_n_rows(lines):
    drawn = sampling.bootstrap(lines.select("row_id", "y"), 4)
    n = lines.count()
    assert {r["s"] for r in drawn.groupBy("member").agg(F.sum("w").alias("s")).collect()} == {float(n)}
    strata = sampling.stratified_bootstrap(lines.select("row_id", "y"), 2).groupBy("member", "y").agg(F.sum("w").alias("s"))
    sizes = {r["y"]: r["count"] for r in lines.groupBy("y").count().collect()}
    assert all(r["s"] == sizes[r["y"]] for r in strata.collect())


def test_masks(blobs):
    pool = masking.hashed_pool(blobs, 4, 3, 4)
    assert pool.shape == (4, 3, 4)
    final, history = masking.evolve(blobs.select("row_id", "x", "y"), 4, pool, generations=5, p_mutate=0.2, p_cross=0.5)
    best = [r["s"] for r in history.groupBy("generation").agg(F.max("score").alias("s")).orderBy("generation").collect()]
    assert best == sorted(best)
    model = masking.base_model(blobs, 4)
    voted = masking.masked_vote(blobs.select("row_id", "x", "y"), model, final[0])
    assert accuracy(voted) > 0.9
    pairs = [(a != b).sum() for e in pool for i, a in enumerate(e) for b in e[i + 1 :]]
    assert masking.spread(pool) == pytest.approx(np.array(pairs).reshape(4, 3).sum(axis=1) / 3 / 4)


def test_subspaces_follow_the_shares(spark):
    shares = subspaces.subspace_shares(spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 9.0)], "feature int, importance double"))
    drawn = subspaces.weighted_subspaces(shares, 30, 2)
    assert {v for r in drawn.collect() for v in r["features"]} == {2}
    worst = subspaces.subspace_shares(spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 9.0)], "feature int, importance double"), True)
    assert {r["feature"]: r["p"] for r in worst.collect()} == {0: 0.5, 1: 0.5, 2: 0.0}


def test_settle_small_beyond_its_limit(spark):
    df = spark.range(50).withColumn("m", F.create_map(F.lit(1), F.col("id")))
    for limit in (10, 100):
        out = settle_small(df, limit=limit)
        assert out.schema.simpleString() == df.schema.simpleString() and out.count() == 50
    assert with_row(spark.range(3), settle_small(spark.range(1).select(F.lit(4).alias("v")))).agg(F.sum("v")).first()[0] == 12


def test_stream_replay_and_first_index(spark, tmp_path):
    """A chunk whose only selected row has index 0 still trains; a replay changes nothing."""
    schema = T.StructType.fromDDL("row_id bigint, x array<double>, y int")
    first = spark.createDataFrame([(i, [float(i % 2) + i / 100], i % 2) for i in range(40)], schema)
    second = spark.createDataFrame([(0, [0.7], 1), (41, [9.0], 1)], schema)
    learner = chunks.ActiveLearner(spark, GaussianBayes(), 1, 2, lambda s: s.where("row_id = 0"), str(tmp_path / "state"))
    for batch, chunk in ((0, first), (1, second), (1, second)):
        learner.add(chunk, batch)
    assert learner.labelled.count() == 41 and learner.used == 0.5
    again = chunks.ActiveLearner(spark, GaussianBayes(), 1, 2, lambda s: s, str(tmp_path / "state"))
    assert again.labelled.count() == 41


def test_memory_keeps_newest(spark, tmp_path):
    folder = tmp_path / "in"
    for c in range(3):
        spark.range(c * 10, c * 10 + 10).coalesce(1).write.mode("append").parquet(str(folder))
    memory = chunks.RowMemory(spark, "id", 12)
    memory.run(chunks.file_chunks(spark, str(folder), spark.range(1).schema), str(tmp_path / "offsets")).awaitTermination()
    assert sorted(r["id"] for r in memory.rows.collect()) == list(range(18, 30))
