"""Learners, cross-validation, statistical tests, diversity."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustframe.checks import kept, query
from trustframe.checks.models_sql import centroid_cte, f1_cte, folds_cte, gnb_cte, train_cte, tree_cte
from trustframe.checks.profile_checks import COLLECTION, collection_lines, with_row_ids
from trustframe.checks.tables import POINTS, STATUS, VECTORS, points, status_vectors, table, vectors, with_
from trustframe.learners import Boosting, DecisionTree, GaussianBayes, NearestCentroid, Projected, RandomForest
from trustframe.learners.centroid import centroid_decision as decide
from trustframe.learners.kernel import default_radius, kernel_model, last_rows
from trustframe.learners.kernel import radius_kernel as kernel
from trustframe.operators import diversity, testing
from trustframe.operators.neighbors import knn_classify, nearest
from trustframe.operators.sampling import stratified_kfold
from trustframe.operators.storage import settle
from trustframe.plans.evaluation import cv_predictions as cv
from trustframe.plans.evaluation import cv_scores as scores_of
from trustframe.plans.evaluation import cv_votes

K = 5
MODELS = ["centroid", "gnb", "gnb_pair"]


@kept
def folded(spark, folder):
    """Only the joined lines are written; a pass over them makes row ids and folds anew."""
    rows = settle(collection_lines(spark, folder), "collection")
    return stratified_kfold(with_row_ids(rows), K, keys=["dataset"])


def learners():
    return {"centroid": NearestCentroid(), "gnb": GaussianBayes(), "gnb_pair": Projected(GaussianBayes(), [0, 2])}


def predicted(spark, folder):
    return cv(folded(spark, folder), learners(), K, 4, 3)


def voted(spark, folder):
    """The predictions of all models of a row in one."""
    return cv_votes(folded(spark, folder), learners(), K, 4, 3)


KEYS = ["dataset", "fold"]
CV = ",\n".join([
    COLLECTION, folds_cte("collection", K, ["dataset"]), train_cte(K),
    centroid_cte(KEYS, [1, 2, 3, 4], "cp"), gnb_cte(KEYS, [1, 2, 3, 4], "gp"), gnb_cte(KEYS, [1, 3], "hp"),
    """pred AS (SELECT dataset, fold, 'centroid' AS model, row_id, y_true, y_pred FROM cp
      UNION ALL SELECT dataset, fold, 'gnb', row_id, y_true, y_pred FROM gp
      UNION ALL SELECT dataset, fold, 'gnb_pair', row_id, y_true, y_pred FROM hp)""",
])
SCORES = CV + ",\n" + f1_cte(["dataset", "fold", "model"], "pred", "f1s") + """,
  scores AS (SELECT dataset, model, fold, 'f1' AS metric, f1 AS score FROM f1s)"""
MEANS = SCORES + """,
  means AS (SELECT dataset, model, metric, avg(score) AS mean, stddev_pop(score) AS std FROM scores GROUP BY ALL)"""
RANKS = MEANS + """,
  ranks AS (SELECT dataset, metric, model, rank() OVER (PARTITION BY dataset, metric ORDER BY mean)
    + (count(*) OVER (PARTITION BY dataset, metric, mean) - 1) / 2.0 AS rank FROM means)"""


@kept
def scores(spark, folder):
    return settle(scores_of(predicted(spark, folder)), "scores")


def means(spark, folder):
    return testing.mean_std(scores(spark, folder))


@kept
def ranks(spark, folder):
    return settle(testing.model_ranks(means(spark, folder)), "ranks")


@query(with_(CV, select="SELECT * FROM pred"))
def cv_predictions(spark, folder):
    return predicted(spark, folder)


@query(with_(SCORES, select="SELECT * REPLACE (round(score, 6) AS score) FROM scores"))
def cv_scores(spark, folder):
    return scores(spark, folder).withColumn("score", F.round("score", 6))


@query(with_(MEANS, select="SELECT * REPLACE (round(mean, 6) AS mean, round(std, 6) AS std) FROM means"))
def cv_mean_std(spark, folder):
    return means(spark, folder).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(with_(RANKS, select="SELECT dataset, metric, model, CAST(rank AS DOUBLE) AS rank FROM ranks"))
def model_ranks(spark, folder):
    return ranks(spark, folder)


@query(with_(RANKS, select="SELECT metric, model, round(avg(rank), 6) AS mean_rank FROM ranks GROUP BY ALL"))
def mean_ranks(spark, folder):
    return testing.mean_ranks(ranks(spark, folder)).withColumn("mean_rank", F.round("mean_rank", 6))


DIFFS = SCORES + """,
  diffs AS (SELECT a.dataset, a.metric, a.model AS model_a, b.model AS model_b, count(*) AS n, avg(a.score - b.score) AS dm,
    var_samp(a.score - b.score) AS dv FROM scores a JOIN scores b ON a.dataset = b.dataset AND a.metric = b.metric AND a.fold = b.fold
    AND a.model <> b.model GROUP BY ALL)"""
# two-sided tail of Student's t for df = 4: sin(theta) * (1 + cos^2(theta) / 2)
P4 = "1 - sin(atan(abs(t) / 2)) * (1 + cos(atan(abs(t) / 2)) ** 2 / 2)"


def _t_sql(factor: str) -> str:
    return DIFFS + f""",
  tests AS (SELECT *, {P4} AS p FROM (SELECT dataset, metric, model_a, model_b, dm / sqrt(({factor}) * dv) AS t, 4 AS df FROM diffs))"""


def _rounded(df):
    return df.withColumns({"t": F.round("t", 5), "p_value": F.round("p_value", 6)})


TESTS_OUT = "SELECT dataset, metric, model_a, model_b, round(t, 5) AS t, df, round(p, 6) AS p_value FROM tests"


@query(with_(_t_sql("1.0 / 5 + 1.0 / 4"), select=TESTS_OUT))
def ttest_corrected(spark, folder):
    return _rounded(testing.ttest_corrected(scores(spark, folder), 1, 5))


@query(with_(_t_sql("1 / (n * (1 - 0.6))"), select=TESTS_OUT))
def ttest_corr(spark, folder):
    return _rounded(testing.ttest_corr(scores(spark, folder)))


@query(with_(_t_sql("1.0 / n"), select=TESTS_OUT))
def ttest_paired(spark, folder):
    return _rounded(testing.ttest_paired(scores(spark, folder)))


NUMBER = "CASE model_b WHEN 'centroid' THEN 1 WHEN 'gnb' THEN 2 ELSE 3 END"


@query(with_(_t_sql("1.0 / n"), select=f"""SELECT dataset, metric, model_a AS model, CASE count(*) FILTER (p < 0.05 AND t > 0) WHEN 2 THEN 'all'
  WHEN 0 THEN '---' ELSE string_agg(CAST({NUMBER} AS VARCHAR), ', ' ORDER BY {NUMBER}) FILTER (p < 0.05 AND t > 0) END AS conclusion
  FROM tests GROUP BY ALL"""))
def paired_conclusions(spark, folder):
    return testing.paired_conclusions(scores(spark, folder), MODELS, "t_test_rel")


@query(with_(RANKS, """sides AS (SELECT a.metric, a.model AS model_a, b.model AS model_b, s.model AS model, s.rank,
    rank() OVER (PARTITION BY a.metric, a.model, b.model ORDER BY s.rank) + (count(*) OVER (PARTITION BY a.metric, a.model, b.model, s.rank) - 1) / 2.0 AS r
    FROM (SELECT DISTINCT metric, model FROM ranks) a JOIN (SELECT DISTINCT metric, model FROM ranks) b ON a.metric = b.metric AND a.model <> b.model
    JOIN ranks s ON s.metric = a.metric AND s.model IN (a.model, b.model))""",
  """zs AS (SELECT metric, model_a, model_b, (sum(r) FILTER (model = model_a) - 5 * 11 / 2.0) / sqrt(25 * 11 / 12.0) AS z FROM sides GROUP BY ALL)""",
  select=f"""SELECT r.metric, r.model, round(any_value(r.m), 6) AS mean_rank, CASE count(*) FILTER (z > 1.959963984540054) WHEN 2 THEN 'all'
  WHEN 0 THEN '---' ELSE string_agg(CAST({NUMBER} AS VARCHAR), ', ' ORDER BY {NUMBER}) FILTER (z > 1.959963984540054) END AS conclusion
  FROM (SELECT metric, model, avg(rank) AS m FROM ranks GROUP BY ALL) r JOIN zs ON zs.metric = r.metric AND zs.model_a = r.model
  GROUP BY r.metric, r.model"""))
def global_ranks(spark, folder):
    return testing.global_ranks(ranks(spark, folder), MODELS).withColumn("mean_rank", F.round("mean_rank", 6))


@query(with_(RANKS, """cells AS (SELECT metric, dataset, model, printf('%.3f', mean) AS cell FROM means
    UNION ALL SELECT metric, 'mean ranks', model, printf('%.3f', avg(rank)) FROM ranks GROUP BY metric, model)""",
  select="""SELECT metric, dataset, max(cell) FILTER (model = 'centroid') AS centroid, max(cell) FILTER (model = 'gnb') AS gnb,
  max(cell) FILTER (model = 'gnb_pair') AS gnb_pair FROM cells GROUP BY metric, dataset"""))
def score_table(spark, folder):
    return testing.score_table(means(spark, folder), MODELS)


# ---- learners on the whole table, tested on the second of two folds ----

HALVES = ",\n".join([folds_cte("vectors", 2, out="halves"), "train AS (SELECT * FROM halves WHERE fold = 0)", "test AS (SELECT * FROM halves WHERE fold = 1)"])


def halves(rows):
    """Rows are written before folds are made, which takes several passes over them."""
    both = settle(stratified_kfold(settle(rows, "rows"), 2), "halves").withColumn("k", F.lit(0))
    return both.where("fold = 0"), both.where("fold = 1")


def _predict(learner, rows, dim, n_classes):
    train, test = halves(rows)
    model = learner.fit(train, ["k"], dim, n_classes)
    return learner.predict(test, model, ["k"]).select("row_id", F.col("y").alias("y_true"), "y_pred")


@query(with_(STATUS, HALVES, "c AS (SELECT y, i, avg(x[i]) AS m FROM train, (SELECT unnest(range(1, 5)) AS i) GROUP BY ALL)",
  "p AS (SELECT i, max(m) FILTER (y = 1) AS c1, avg(m) AS b FROM c GROUP BY i)",
  select="""SELECT row_id, round(sum((x[i] - b) * (c1 - b)), 4) AS decision, CAST(sum((x[i] - b) * (c1 - b)) > 0 AS INTEGER) AS y_pred
  FROM test, p GROUP BY row_id"""))
def centroid_decision(spark, folder):
    train, test = halves(status_vectors(spark, folder))
    found = decide(test, NearestCentroid().fit(train, ["k"], 4), ["k"])
    return found.select("row_id", F.round("decision", 4).alias("decision"), "y_pred")


@query(with_(POINTS, HALVES, centroid_cte([], range(1, 65)), select="SELECT * FROM cpred"))
def centroid_predict(spark, folder):
    return _predict(NearestCentroid(), points(spark, folder), 64, 10)


@query(with_(VECTORS, HALVES, gnb_cte([], range(1, 5)), select="SELECT * FROM gpred"))
def gnb_predict(spark, folder):
    return _predict(GaussianBayes(), vectors(spark, folder), 4, 3)


SUBS = [[0, 1, 2], [3], [7, 9]]


@query(with_(POINTS, HALVES, *[gnb_cte([], [i + 1 for i in s], f"g{j}") for j, s in enumerate(SUBS)],
  select=" UNION ALL ".join(f"SELECT row_id, {j} AS subspace, y_pred FROM g{j}" for j in range(3))))
def gnb_subspaces(spark, folder):
    learner = GaussianBayes()
    train, test = halves(points(spark, folder))
    found = learner.predict_subspaces(test, learner.fit(train, ["k"], 64), ["k"], SUBS)
    return found.select("row_id", "subspace", "y_pred")


@query(with_(POINTS, "memory AS (SELECT * FROM vectors ORDER BY row_id DESC LIMIT 250)",
  "sc AS (SELECT i, avg(x[i]) AS m, stddev_pop(x[i]) AS s FROM memory, (SELECT unnest(range(1, 65)) AS i) GROUP BY i)",
  "z AS (SELECT row_id, i, (x[i] - m) / s AS z FROM vectors JOIN sc ON true)",
  "rad AS (SELECT sum(s) AS r FROM (SELECT stddev_pop(z) AS s FROM z GROUP BY i))",
  "zl AS (SELECT row_id, list(z ORDER BY i) AS z FROM z GROUP BY row_id)",
  "n AS (SELECT y, count(*) AS n FROM memory GROUP BY y)",
  "sup AS (SELECT t.row_id, m.y AS c, sum(greatest(0, r - list_distance(t.z, mz.z))) / any_value(n) AS s FROM zl t, memory m JOIN zl mz ON m.row_id = mz.row_id JOIN n ON n.y = m.y, rad GROUP BY t.row_id, m.y)",
  select="SELECT row_id, CAST(arg_max(c, s) AS INTEGER) AS y_pred, round(max(s), 5) AS support FROM sup GROUP BY row_id"))
def radius_kernel(spark, folder):
    rows = points(spark, folder)
    model = kernel_model(last_rows(rows, "row_id"), 64)
    found = kernel(rows, model, default_radius(rows, model, 64))
    best = F.array_max(F.transform("supports", lambda s: s["support"]))
    return found.select("row_id", "y_pred", F.round(best, 5).alias("support"))


def _knn_sql(k: int, p: float) -> str:
    return with_(POINTS, HALVES,
      f"""nn AS (SELECT t.row_id, b.row_id AS other, b.y, row_number() OVER (PARTITION BY t.row_id ORDER BY
        list_sum(list_transform(list_zip(t.x, b.x), lambda e: abs(e[1] - e[2]) ** {p})), b.row_id) AS rn FROM test t, train b)""",
      f"votes AS (SELECT row_id, y, count(*) AS v FROM nn WHERE rn <= {k} GROUP BY ALL)",
      select=f"""SELECT row_id, CAST(arg_max(y, v * 100 - y) AS INTEGER) AS y_pred, round(max(v) / {k}, 6) AS support FROM votes GROUP BY row_id""")


def _knn(spark, folder, k, p):
    train, test = halves(points(spark, folder))
    found = knn_classify(test.withColumnRenamed("row_id", "query_id"), train, k, p)
    return found.select(F.col("query_id").alias("row_id"), "y_pred", F.round("support", 6).alias("support"))


@query(_knn_sql(5, 2))
def knn_minkowski(spark, folder):
    return _knn(spark, folder, 5, 2.0)


@query(_knn_sql(7, 0.5))
def knn_fractional(spark, folder):
    return _knn(spark, folder, 7, 0.5)


@query(with_("""v AS (SELECT p_partkey AS row_id, [p_retailprice, p_size * 10.0] AS x FROM part)""",
  """nn AS (SELECT a.row_id AS query_id, b.row_id, row_number() OVER (PARTITION BY a.row_id ORDER BY
    (a.x[1] - b.x[1]) ** 2 + (a.x[2] - b.x[2]) ** 2, b.row_id) AS rank,
    sqrt((a.x[1] - b.x[1]) ** 2 + (a.x[2] - b.x[2]) ** 2) AS distance FROM v a, v b)""",
  select="SELECT query_id, rank, row_id, round(distance, 6) AS distance FROM nn WHERE rank <= 3"))
def nearest_parts(spark, folder):
    """Many pivots and shards: small blocks on two features."""
    rows = table(spark, folder, "part").select(
        F.col("p_partkey").alias("row_id"), F.array(F.col("p_retailprice"), F.col("p_size") * 10.0).alias("x")
    )
    found = nearest(rows.withColumnRenamed("row_id", "query_id"), rows, 3, block=100)
    return found.withColumn("distance", F.round("distance", 6))


@query()
def tree_predict(spark, folder):
    """To pure leaves."""
    return _predict(DecisionTree(), vectors(spark, folder), 4, 3)


@query(with_(VECTORS, HALVES, tree_cte(2, range(1, 5), 3), select="SELECT * FROM tpred"))
def tree_two_levels(spark, folder):
    return _predict(DecisionTree(depth=2), vectors(spark, folder), 4, 3)


@query(with_(POINTS, HALVES, tree_cte(3, range(1, 65), 10), select="SELECT * FROM tpred"))
def tree_three_levels(spark, folder):
    """64 features, ten classes."""
    return _predict(DecisionTree(depth=3), points(spark, folder), 64, 10)


@query()
def forest_predict(spark, folder):
    """Trees to pure leaves on balanced weights."""
    return _predict(RandomForest(balanced=True), vectors(spark, folder), 4, 3)


@query()
def boost_predict(spark, folder):
    return _predict(Boosting(rounds=3, depth=2), vectors(spark, folder), 4, 3)


# ---- diversity of the three models on each dataset of the collection ----

EACH = CV + """,
  pairs AS (SELECT dataset, a.model AS model_a, b.model AS model_b, count(*) FILTER (NOT ka AND NOT kb) AS n00, count(*) FILTER (NOT ka AND kb) AS n01,
    count(*) FILTER (ka AND NOT kb) AS n10, count(*) FILTER (ka AND kb) AS n11 FROM (SELECT *, y_true = y_pred AS ka FROM pred) a
    JOIN (SELECT *, y_true = y_pred AS kb FROM pred) b USING (dataset, row_id) GROUP BY ALL),
  half AS (SELECT * FROM pairs WHERE model_a < model_b)"""
TABLE = ["n00", "n01", "n10", "n11"]
BY = ["dataset"]


@query(with_(EACH, select=f"SELECT dataset, model_a, model_b, {', '.join(TABLE)} FROM half"))
def pair_tables(spark, folder):
    return diversity.pair_tables(voted(spark, folder), keys=BY)


@query(with_(EACH, select=f"SELECT dataset, model_a, model_b, {', '.join(TABLE)} FROM pairs"))
def pair_tables_full(spark, folder):
    return diversity.pair_tables(voted(spark, folder), full=True, keys=BY)


Q = "(n11 * n00 - n01 * n10) / CASE WHEN n11 * n00 + n01 * n10 = 0 THEN 1e-12 ELSE n11 * n00 + n01 * n10 END"
DIS = "(n01 + n10) / (n00 + n01 + n10 + n11)"
MEASURES = {
    "q_statistic": ("q_statistic", Q),
    "pair_correlation": ("correlation", "(n11 * n00 - n01 * n10) / sqrt(CAST(n11 + n10 AS DOUBLE) * (n01 + n00) * (n11 + n01) * (n10 + n00))"),
    "disagreement": ("disagreement", DIS),
    "double_fault": ("double_fault", "n00 / (n00 + n01 + n10 + n11)"),
}


def _measure(name: str, column: str, expr: str) -> None:
    @query(with_(EACH, select=f"SELECT dataset, model_a, model_b, round({expr}, 6) AS {column} FROM half"), name=name)
    def run(spark, folder):
        found = diversity.pair_measures(voted(spark, folder), keys=BY)
        return found.select("dataset", "model_a", "model_b", F.round(column, 6).alias(column))


for _name, (_column, _expr) in MEASURES.items():
    _measure(_name, _column, _expr)

SUMMED = ["entropy", "kappa", "kw_variance", "disagreement", "q_statistic"]
ENTROPY = """ent AS (SELECT dataset, avg((1 - abs(c - 1)) / 1.5) AS e, avg(c / 3) AS p
    FROM (SELECT dataset, row_id, count(*) FILTER (y_true = y_pred) AS c FROM pred GROUP BY dataset, row_id) GROUP BY dataset)"""
SUMMARY = f"""summary AS (SELECT dataset, any_value(e) AS entropy, 1 - avg({DIS}) / (2 * any_value(p * (1 - p))) AS kappa, 2.0 / 6 * avg({DIS}) AS kw_variance,
    avg({DIS}) AS disagreement, avg({Q}) AS q_statistic FROM half JOIN ent USING (dataset) GROUP BY dataset)"""


def _summary(columns):
    out = ", ".join(f"round({c}, 6) AS {c}" for c in columns)
    return with_(EACH, ENTROPY, SUMMARY, select=f"SELECT dataset, {out} FROM summary")


def _summarised(spark, folder, columns):
    found = diversity.diversity_summary(voted(spark, folder), keys=BY)
    return found.select("dataset", *[F.round(c, 6).alias(c) for c in columns])


@query(_summary(["entropy"]))
def entropy_e(spark, folder):
    return diversity.entropy_e(voted(spark, folder), keys=BY).withColumn("entropy", F.round("entropy", 6))


@query(_summary(["kw_variance"]))
def kw_variance(spark, folder):
    return _summarised(spark, folder, ["kw_variance"])


@query(_summary(["kappa"]))
def interrater_k(spark, folder):
    return _summarised(spark, folder, ["kappa"])


@query(_summary(SUMMED))
def diversity_summary(spark, folder):
    return _summarised(spark, folder, SUMMED)


# ---- the same tables with all measures at once ----


@query(with_(EACH, select=f"SELECT dataset, model_a, model_b, {', '.join(TABLE)} FROM pairs"))
def pair_tables_by_dataset(spark, folder):
    return diversity.pair_tables(voted(spark, folder), full=True, keys=BY)


@query(with_(EACH, select="SELECT dataset, model_a, model_b, " + ", ".join(f"round({e}, 6) AS {c}" for c, e in MEASURES.values()) + " FROM half"))
def pair_measures_by_dataset(spark, folder):
    found = diversity.pair_measures(voted(spark, folder), keys=BY)
    return found.select("dataset", "model_a", "model_b", *[F.round(c, 6).alias(c) for c, _ in MEASURES.values()])


@query(_summary(SUMMED))
def diversity_by_dataset(spark, folder):
    return _summarised(spark, folder, SUMMED)
