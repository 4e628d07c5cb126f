"""Hand-made frames, one per rule that is easy to get wrong."""

import math
import warnings

import pytest
from pyspark.sql import functions as F

from trustframe.config import ReportConfig
from trustframe.ensembles import regression, undersampled
from trustframe.functions.tails import normal_critical, t_two_sided, with_normal_p
from trustframe.learners import Boosting, DecisionTree, NearestCentroid, Projected, RandomForest
from trustframe.operators import cleaning, diversity, permuting, profiling, sampling, scoring, testing, transforming
from trustframe.operators.neighbors import knn_classify
from trustframe.plans import association, redundancy, similarity
from trustframe.plans.evaluation import cv_predictions
from trustframe.plans.report import catalogue_report, clean, dataset_report
from trustframe.sources import features as sources
from trustframe.sources import sinks

NAN, INF = float("nan"), float("inf")


def one(df):
    return df.first().asDict()


@pytest.fixture(scope="module")
def messy(spark):
    rows = [
        (1, 1.0, 2.0, "a"), (2, 1.0, 2.0, "a"), (3, 1.0, 2.0, "b"), (4, NAN, 2.0, "a"), (5, None, 2.0, "a"),
        (6, INF, 2.0, "a"), (7, -INF, 2.0, "a"), (8, 3.0, 1.0, None), (9, 0.0, 1.0, "b"), (10, -0.0, 1.0, "b"),
        (11, 1.0, 2.0, "a"),
    ]
    return spark.createDataFrame(rows, "row_id bigint, f double, g double, label string")


def test_missing_and_duplicates(messy):
    raw = cleaning.nan_to_null(messy, ["f", "g"])
    columns = ["f", "g", "label"]
    assert one(profiling.class_count(raw)) == {"classes": 2, "multiclass": None}
    # 2 and 11 copy 1; 5 copies 4 (NaN = NULL); 10 copies 9 (-0.0 = 0.0); inf and -inf are no copies
    assert one(cleaning.duplicate_count(raw, columns)) == {"duplicates": 4}
    assert {r["row_id"] for r in cleaning.duplicate_listing(raw, columns).collect()} == {2, 11, 5, 10}
    unique = cleaning.normalize_missing(cleaning.dedupe(raw, columns), ["f", "g"])
    assert one(cleaning.missing_rows(unique, columns)) == {"missing_rows": 4}
    assert {r["row_id"] for r in cleaning.drop_missing(unique, columns).collect()} == {1, 3, 9}
    assert one(cleaning.duplicate_count(cleaning.drop_missing(unique, columns), ["f", "g"])) == {"duplicates": 1}


def test_report_row(messy):
    report = dataset_report(messy, ["f", "g"], ReportConfig(metrics=(), min_sample_limit=1))
    row = one(report)
    assert (row["classes"], row["multiclass"], row["duplicated"], row["missing"]) == (2, None, 4, 4)
    assert row["original_samples"] == {"a": 7, "b": 3}
    assert row["analyzed_samples"] == {"a": 1, "b": 2}
    assert row["filtered_classes"] == 1
    found = one(catalogue_report(report))
    assert found["advanced_metrics"]["redundancy"] is None
    assert "1 small classes, 4 duplicated" in found["generic_info"]["key_observations"]
    assert "analyzed_samples" in one(sinks.report_json(report))["report"]


def test_plugged_metric(messy):
    def rows_metric(sample, features, config):
        return sample.agg(F.count(F.lit(1)).alias("rows"))

    found = dataset_report(messy, ["f", "g"], ReportConfig(metrics=("rows",), min_sample_limit=0), {"rows": rows_metric})
    assert one(found)["rows"]["rows"] == 3


def test_cap_and_rare_class(spark):
    df = spark.range(10 + 11 + 30).select(
        F.col("id").alias("row_id"), F.lit(1.0).alias("f"),
        F.when(F.col("id") < 10, "ten").when(F.col("id") < 21, "eleven").otherwise("thirty").alias("label"),
    )
    kept = sampling.rare_class_filter(df, min_rows=10)
    assert {r["label"] for r in kept.select("label").distinct().collect()} == {"eleven", "thirty"}
    sizes = {r["label"]: r["count"] for r in sampling.capped_sample(df, limit=11).groupBy("label").count().collect()}
    assert sizes == {"ten": 10, "eleven": 11, "thirty": 11}
    config = ReportConfig(sampling_limit=11, delete_duplicated=False, metrics=())
    assert one(dataset_report(df, ["f"], config))["analyzed_samples"] == {"ten": 10, "eleven": 11, "thirty": 11}
    assert clean(df, ["f"], config)[1].count() == 22


def test_scaling_constant_feature(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 3.0)], "row_id int, c double, v double")
    assert [r["c"] for r in transforming.minmax_scale(df, ["c", "v"]).collect()] == [0.0, 0.0]
    assert sorted(r["v"] for r in transforming.standard_scale(df, ["c", "v"]).collect()) == [-1.0, 1.0]
    assert {r["c"] for r in transforming.standard_scale(df, ["c"]).collect()} == {0.0}


def test_numeric_labels_keep_their_order(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([10, 2, 33])], "row_id int, label int")
    assert {r["label"]: r["y"] for r in transforming.label_encode(df).collect()} == {2: 0, 10: 1, 33: 2}


def test_half_even_shares(spark):
    rows = spark.range(20).select(F.col("id").alias("row_id"), (F.col("id") >= 5).cast("int").alias("y"))
    chosen = permuting.moved_labels(rows, [(0, 50)])
    assert {r["y_old"]: r["count"] for r in chosen.groupBy("y_old").count().collect()} == {0: 2, 1: 8}


def test_permutation_that_cannot_change(spark):
    rows = spark.range(6).select(F.col("id").alias("row_id"), F.lit(0).alias("y"))
    out = permuting.permute_labels(rows, [(0, 50), (0, 1)])
    assert out.count() == 12 and out.where("y_perm <> 0").count() == 0
    assert one(scoring.label_corr(out, ["perm", "perc"]))["corr"] is None


def test_score_corners(spark):
    rows = [(0, 0), (0, 0), (1, 0), (1, 3)]
    conf = scoring.confusion(spark.createDataFrame([("m", *r) for r in rows], "model string, y_true int, y_pred int"), ["model"])
    wide = one(scoring.score_table_wide(conf, ["model"]))
    assert wide["f1"] == pytest.approx(0.5 * 0.8)
    assert wide["bac"] == pytest.approx(0.5)
    # the prediction of class 3 lies outside the true classes and does not count
    assert one(scoring.balanced_accuracy_closed(conf, ["model"]))["bac_closed"] == pytest.approx(0.5)


def test_rank_scores_with_ties(spark):
    rows = [("m", 1, 0.9), ("m", 0, 0.5), ("m", 1, 0.5), ("m", 0, 0.1)]
    df = spark.createDataFrame(rows, "model string, y_true int, score double")
    assert one(scoring.roc_auc(df, ["model"]))["roc_auc"] == pytest.approx(0.875)
    assert one(scoring.average_precision(df, ["model"]))["average_precision"] == pytest.approx(0.5 + 0.5 * 2 / 3)


def test_area_needs_monotone_x(spark):
    down = spark.createDataFrame([("m", i, 2.0 - i, 1.0) for i in range(3)], "m string, k int, x double, y double")
    assert one(scoring.trapezoid_auc(down, ["m"], "k", "x", "y"))["area"] == pytest.approx(2.0)
    zigzag = spark.createDataFrame([("m", 0, 0.0, 1.0), ("m", 1, 2.0, 1.0), ("m", 2, 1.0, 1.0)], down.schema)
    assert one(scoring.trapezoid_auc(zigzag, ["m"], "k", "x", "y"))["area"] is None


def scores(spark, table):
    rows = [("d", m, f, "f1", float(v)) for m, values in table.items() for f, v in enumerate(values)]
    return spark.createDataFrame(rows, "dataset string, model string, fold int, metric string, score double")


def test_ranks_and_conclusions(spark):
    s = scores(spark, {"a": [0.9, 0.91, 0.92, 0.9], "b": [0.5, 0.52, 0.49, 0.5], "c": [0.5, 0.52, 0.49, 0.5]})
    ranks = {r["model"]: r["rank"] for r in testing.model_ranks(testing.mean_std(s)).collect()}
    assert ranks == {"a": 3.0, "b": 1.5, "c": 1.5}
    found = testing.paired_conclusions(s, ["a", "b", "c"], "t_test_rel")
    assert {r["model"]: r["conclusion"] for r in found.collect()} == {"a": "all", "b": "---", "c": "---"}
    equal = testing.ttest_paired(s).where("model_a = 'b' AND model_b = 'c'")
    assert one(equal)["t"] is None
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert testing.paired_conclusions(s, ["a", "b", "c"], "nope") is None
        testing.paired_conclusions(s, ["a", "b", "c"], "t_test_13", corr=0.2, other=1)
    assert len(seen) == 2
    with pytest.raises(Exception, match="expected 25 scores"):
        testing.ttest_corrected(s).collect()


def test_tails(spark):
    # fixed two-sided tails of Student's t and the normal distribution
    known = [(2.776445105, 4, 0.05), (3.182446305, 3, 0.05), (12.70620474, 1, 0.05), (2.063898562, 24, 0.05)]
    df = spark.createDataFrame(known, "t double, df int, p double")
    for r in df.withColumn("q", t_two_sided(F.col("t"), F.col("df"))).collect():
        assert r["q"] == pytest.approx(r["p"], abs=1e-7)
    assert normal_critical(0.05) == pytest.approx(1.959963984540054)
    z = with_normal_p(spark.createDataFrame([(1.959963984540054,)], "z double"), "z")
    assert one(z)["p_value"] == pytest.approx(0.05)


def status(spark, table):
    """table: model -> (p-values, score)."""
    p = [(m, i, float(v)) for m, (values, _) in table.items() for i, v in enumerate(values)]
    base = [(m, float(s)) for m, (_, s) in table.items()]
    return one(association.association_status(
        spark.createDataFrame(p, "model string, perc int, p_value double"),
        spark.createDataFrame(base, "model string, score double"), list(table), len(next(iter(table.values()))[0]),
    ))["status"]


def test_status_rules(spark):
    low, high = 0.005, 0.5
    assert status(spark, {"a": ([low, low], 0.9)}) == "Good"
    assert status(spark, {"a": ([low, low], 0.9), "b": ([low, low], 0.5)}) == "Mid"
    assert status(spark, {"a": ([low, low], 0.9), "b": ([low, high], 0.5)}) == "Good"
    assert status(spark, {"a": ([high, high], 0.9)}) == "Bad"
    assert status(spark, {"a": ([low, high], 0.9), "b": ([high, high], 0.9)}) == "Mid"


def test_redundancy_limits(spark):
    rows = spark.range(400).select(
        F.col("id").alias("row_id"), F.array((F.col("id") % 2) * 10.0 + F.col("id") / 1000).alias("x"),
        (F.col("id") % 2).cast("int").alias("y"),
    )
    results, evidence = redundancy.redundancy(rows, {"c": NearestCentroid()}, 1, 2, runs=2)
    assert one(results)["redundancy"] == pytest.approx(127 / 128)
    assert evidence.count() == 14
    assert redundancy.passes(1.0, [0.995, 0.2]) is False and redundancy.passes(1.0, []) is False


def test_similarity_corners(spark):
    single = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, "a", [2.0, 1.0])], "row_id int, label string, x array<double>")
    assert one(similarity.similarity_mean(single, 2)[1])["similarity"] is None
    flat = spark.createDataFrame(
        [(1, "a", [1.0]), (2, "a", [1.0]), (3, "b", [2.0])], "row_id int, label string, x array<double>"
    )
    assert one(similarity.similarity_mean(flat, 1)[1])["similarity"] is None
    with pytest.raises(ValueError, match="at least 4"):
        similarity.hidden_sizes(3)
    assert similarity.hidden_sizes(42) == (16, 8) and similarity.hidden_sizes(79) == (32, 16)


def test_network_beats_the_mean(spark):
    """Two groups of correlated features: the trained network rebuilds the base class far better than its mean does."""
    t = F.pmod(F.col("id") * 37, F.lit(401)) / 400.0
    x = F.array(*[t] * 8, *[1.0 - t] * 8)
    rows = spark.range(1500).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 < 2, "base").otherwise("other").alias("label"), x.alias("x"))
    l1 = {
        name: {r["label"]: r["l1"] for r in fit(rows, 16)[0].collect()}["base"]
        for name, fit in (("mean", similarity.similarity_mean), ("network", similarity.similarity_ae))
    }
    assert l1["network"] < 0.6 * l1["mean"]


def test_diversity_corners(spark):
    rows = [(i, m, 1, 1) for i in range(4) for m in "ab"]
    right = spark.createDataFrame(rows, "row_id int, model string, y_true int, y_pred int")
    pair = one(diversity.pair_measures(right))
    assert pair["q_statistic"] == 0.0 and pair["correlation"] is None and pair["disagreement"] == 0.0
    summary = one(diversity.diversity_summary(right))
    assert summary["kappa"] is None and summary["entropy"] == 0.0
    three = spark.createDataFrame([(0, m, 1, int(m == "a")) for m in "abc"], right.schema)
    assert one(diversity.entropy_e(three))["entropy"] == pytest.approx(1 / 1.5)


def test_neighbour_vote_tie_takes_lowest_class(spark):
    base = spark.createDataFrame([(1, [0.0], 1), (2, [2.0], 0)], "row_id int, x array<double>, y int")
    query = spark.createDataFrame([(9, [1.0])], "query_id int, x array<double>")
    assert one(knn_classify(query, base, 2))["y_pred"] == 0


def test_wilcoxon_drops_zeros(spark):
    d = spark.createDataFrame([("p", v) for v in (0.0, 1.0, -1.0, 2.0, 3.0)], "k string, d double")
    found = one(undersampled.wilcoxon(d, ["k"]))
    assert (found["n"], found["w_plus"], found["w_minus"]) == (4, 8.5, 1.5)
    assert found["z"] == pytest.approx((1.5 - 5) / math.sqrt((4 * 5 * 9 - 6 / 2) / 24))


def test_dataset_collection(spark, tmp_path):
    for name, classes in (("one", 2), ("two", 3)):
        lines = [f"{i}.0,{i % 7}.5,{i % classes}" for i in range(30)]
        (tmp_path / f"{name}.csv").write_text("\n".join(lines))
    (tmp_path / "not a dataset!.csv").write_text("1.0,2.0,0")
    loaded = sources.load_collection(spark, str(tmp_path))
    found = {r["dataset"]: (r["rows"], r["features"], r["classes"]) for r in sources.dataset_catalogue(loaded).collect()}
    assert found == {"one": (30, 2, 2), "two": (30, 2, 3)}
    assert sources.select_datasets(loaded, ["two"]).count() == 30
    assert sources.select_datasets(loaded, ("all", ["binary", "balanced"])).select("dataset").distinct().count() == 1
    with pytest.raises(ValueError):
        sources.select_datasets(loaded, ("some", ["binary"]))


def test_collection_of_other_widths(spark, tmp_path):
    (tmp_path / "three.csv").write_text("1,2,3,1\n\n4,oops,6,0\n")
    (tmp_path / "two.csv").write_text("1.5, 2.5, 1\n")
    (tmp_path / "parts.csv").mkdir()
    (tmp_path / "parts.csv" / "part-0.csv").write_text("7,1\n")
    loaded = sources.load_collection(spark, str(tmp_path))
    found = sorted((r["dataset"], r["x"], r["y"]) for r in loaded.orderBy("dataset", "y").collect())
    assert found == [("parts", [7.0], 1), ("three", [1.0, 2.0, 3.0], 1), ("three", [4.0, None, 6.0], 0), ("two", [1.5, 2.5], 1)]
    (tmp_path / "two.csv").write_text("1,2,1\n1,2,3,1\n")
    with pytest.raises(ValueError, match="two has rows of 3 to 4 columns"):
        sources.load_collection(spark, str(tmp_path))


def test_trees_without_a_split(spark):
    """Constant features or a single class: every row gets the shares of the classes."""
    flat = spark.createDataFrame([(i, [1.0, 2.0], int(i < 3), 0) for i in range(10)], "row_id int, x array<double>, y int, k int")
    pure = flat.withColumns({"x": F.array(F.col("row_id").cast("double"), F.lit(2.0)), "y": F.lit(0)})
    for rows, others in ((flat, False), (pure, True)):
        for learner in (DecisionTree(), RandomForest(trees=2), Boosting(rounds=2)):
            supports = learner.supports(rows, learner.fit(rows, ["k"], 2, 2), ["k"]).select("supports").distinct().collect()
            assert len(supports) == 1 or others
            assert all(len(r["supports"]) == 2 for r in supports)


def test_bins_of_each_replicate(spark):
    """A member whose features have another scale does not move the cuts of the others."""
    rows = spark.range(1000).select(
        F.col("id").alias("row_id"), F.array(F.col("id") / 1000.0).alias("x"), (F.col("id") >= 500).cast("int").alias("y"), F.lit(0).alias("k")
    )
    large = rows.withColumns({"x": F.array(F.pmod(F.col("row_id") * 7, F.lit(1000)) * 1e6), "k": F.lit(1)})
    learner = DecisionTree(depth=1)

    def right(train):
        found = learner.predict(rows, learner.fit(train, ["k"], 1, 2), ["k"])
        return one(found.agg(F.avg((F.col("y") == F.col("y_pred")).cast("double")).alias("a")))["a"]

    assert right(rows.unionByName(large)) == right(rows) > 0.98


def test_projected_tree_beside_a_tree(spark):
    rows = spark.range(200).select(
        F.lit("d").alias("dataset"), F.col("id").alias("row_id"), F.array(F.lit(0.0), (F.col("id") % 2) * 1e6).alias("x"),
        (F.col("id") % 2).cast("int").alias("y"), F.pmod(F.floor(F.col("id") / 2), F.lit(2)).cast("int").alias("fold"),
    )
    found = cv_predictions(rows, {"all": DecisionTree(depth=1), "second": Projected(DecisionTree(depth=1), [1])}, 2, 2, 2)
    assert found.count() == 400 and found.where("y_true <> y_pred").count() == 0


def test_collinear_regression(spark):
    rows = spark.range(50).select(
        F.col("id").alias("row_id"), F.array(F.col("id") * 1.0, F.col("id") * 2.0).alias("x"), (F.col("id") * 3.0 + 1).alias("y")
    )
    found = regression.predict(rows, regression.fit_folds(rows, 2))
    assert one(found.agg(F.max(F.abs(F.col("y_hat") - F.col("y"))).alias("e")))["e"] < 1e-6


def test_prediction_store(spark, tmp_path):
    rows = spark.createDataFrame([("d", i, [float(i)], i % 2) for i in range(10)], "dataset string, row_id int, x array<double>, y int")
    prints = sinks.data_fingerprint(rows, ["dataset"])
    assert one(prints) == one(sinks.data_fingerprint(rows.repartition(5).orderBy(F.desc("row_id")), ["dataset"]))
    plan = sinks.planned_work(prints, {"a": "k=1", "b": ""}, 2, 1, 7)
    path = str(tmp_path / "store")
    assert sinks.stored(spark, path) is None and sinks.pending_work(plan, None).count() == 4
    sinks.store_predictions(plan.where("model = 'a'").withColumn("y_pred", F.lit(0)), path)
    assert {r["model"] for r in sinks.pending_work(plan, sinks.stored(spark, path)).collect()} == {"b"}
    assert sinks.planned_work(prints, {"a": ""}, 2, 1, None).where("fingerprint IS NOT NULL").count() == 0
