"""Ensembles and dynamic selection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from trustframe.checks import query
from trustframe.checks.evaluation_checks import HALVES, halves
from trustframe.checks.models_sql import gnb_cte
from trustframe.checks.sampling_checks import BOOT, OVER, PARTS, RANDOM_SUBS, STRAT_BOOT, UNDER
from trustframe.checks.tables import (
    IMBALANCED, POINTS, STATUS, hash_sql, imbalanced, points, status_vectors, table, with_,
)
from trustframe.ensembles import combining, local, masking, regression, selecting, subspaces, undersampled
from trustframe.ensembles.members import Ensemble, member_predictions, resampled_fit, soft_vote
from trustframe.ensembles.members import hard_vote as hard
from trustframe.learners import DecisionTree, GaussianBayes
from trustframe.operators import sampling
from trustframe.operators.diversity import diversity_summary
from trustframe.operators.storage import settle

GNB = GaussianBayes()
ALL4, ALL64 = range(1, 5), range(1, 65)


def two(rows):
    """Two classes from ten: y = label > 4."""
    return rows.withColumn("y", (F.col("y") > 4).cast("int"))


TWO = "vectors AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS x, CAST(label > 4 AS INTEGER) AS y FROM embeddings)"


# ---- random subspaces ----

@query(with_(POINTS, RANDOM_SUBS.replace("range(20)", "range(10)"),
  "train AS (SELECT member, row_id, list_transform(features, lambda f: x[f + 1]) AS x, y FROM vectors, subs)",
  "test AS (SELECT * FROM train)", gnb_cte(["member"], [1, 2, 3]),
  "v AS (SELECT row_id, c, avg(p) AS p FROM gpred_s GROUP BY ALL)",
  select="SELECT row_id, CAST(arg_max(c, p) AS INTEGER) AS y_pred, round(max(p), 6) AS support FROM v GROUP BY row_id"))
def random_subspace_vote(spark, folder):
    rows = points(spark, folder)
    ensemble = Ensemble.fit(GNB, rows, 64, 10, subspaces.random_subspaces(spark, 64, 10, 3))
    found = soft_vote(rows, ensemble)
    return found.select("row_id", "y_pred", F.round(F.array_max("support"), 6).alias("support"))


@query()
def subspace_diversity(spark, folder):
    """Diversity of members that see different features."""
    rows = points(spark, folder)
    ensemble = Ensemble.fit(GNB, rows, 64, 10, subspaces.random_subspaces(spark, 64, 10, 3))
    return diversity_summary(member_predictions(rows, ensemble))


# ---- stratified bagging ----

BAGS = [IMBALANCED, STRAT_BOOT.replace("range(10)", "range(5)"),
  "train AS (SELECT member, row_id, x, vectors.y, w FROM boot JOIN vectors USING (row_id))",
  "test AS (SELECT CAST(m AS INTEGER) AS member, row_id, x, y FROM vectors, (SELECT unnest(range(5)) AS m))",
  gnb_cte(["member"], ALL4, w="w")]


def bagged(spark, folder):
    rows = settle(imbalanced(spark, folder), "rows")
    train = sampling.stratified_bootstrap(rows, 5)
    return rows, Ensemble.fit(GNB, train, 4, 2)


@query(with_(*BAGS, "v AS (SELECT row_id, c, avg(p) AS p FROM gpred_s GROUP BY ALL)",
  select="SELECT row_id, CAST(arg_max(c, p) AS INTEGER) AS y_pred, round(max(p), 5) AS support FROM v GROUP BY row_id"), name="soft_vote")
def soft_vote_bagging(spark, folder):
    rows, ensemble = bagged(spark, folder)
    return soft_vote(rows, ensemble).select("row_id", "y_pred", F.round(F.array_max("support"), 5).alias("support"))


@query(with_(*BAGS, select="SELECT row_id, CAST(count(*) FILTER (y_pred = 1) > 2 AS INTEGER) AS y_pred FROM gpred GROUP BY row_id"), name="hard_vote")
def hard_vote_bagging(spark, folder):
    rows, ensemble = bagged(spark, folder)
    return hard(rows, ensemble).select("row_id", "y_pred")


# ---- balanced parts ----

@query(with_(IMBALANCED, PARTS, "train AS (SELECT * FROM parts)",
  "test AS (SELECT CAST(m AS INTEGER) AS member, row_id, x, y FROM vectors, (SELECT unnest(range(k)) AS m FROM k))", gnb_cte(["member"], ALL4),
  "v AS (SELECT row_id, c, sum(p) AS p FROM gpred_s GROUP BY ALL)",
  select="SELECT row_id, CAST(arg_max(c, p) AS INTEGER) AS y_pred FROM v GROUP BY row_id"))
def umce_vote(spark, folder):
    """Regular mode without the over-sampled member."""
    rows = settle(imbalanced(spark, folder), "rows")
    parts = undersampled.fit_parts(rows, GNB, 4, regular=True)
    return undersampled.cube_vote(rows, parts).select("row_id", "y_pred")


BAC = """bac AS (SELECT member, avg(r) AS w FROM (SELECT member, y_true, avg(CAST(y_true = y_pred AS DOUBLE)) AS r FROM gpred GROUP BY ALL) GROUP BY member)"""
ALL_PARTS = [IMBALANCED, PARTS, OVER,
  "train AS (SELECT member, x, y, CAST(1 AS DOUBLE) AS w FROM parts UNION ALL SELECT CAST(k AS INTEGER), x, y, w FROM over_, k)",
  "test AS (SELECT CAST(m AS INTEGER) AS member, row_id, x, y FROM vectors, (SELECT unnest(range(k + 1)) AS m FROM k))",
  gnb_cte(["member"], ALL4, w="w"), BAC]


@query(with_(*ALL_PARTS,
  "nw AS (SELECT member, coalesce((w - min(w) OVER ()) / nullif(max(w) OVER () - min(w) OVER (), 0), 0) + 0.01 AS nw FROM bac)",
  "con AS (SELECT member, row_id, abs(sum(CASE WHEN c = 0 THEN p ELSE -p END)) AS con FROM gpred_s GROUP BY ALL)",
  "v AS (SELECT s.row_id, s.c, sum(p * nw * con) AS p FROM gpred_s s JOIN nw USING (member) JOIN con ON con.member = s.member AND con.row_id = s.row_id GROUP BY ALL)",
  select="SELECT row_id, CAST(arg_max(c, p) AS INTEGER) AS y_pred FROM v GROUP BY row_id"))
def umce_vote_contrast(spark, folder):
    """Scaled weights times contrast, with the over-sampled member."""
    rows = settle(imbalanced(spark, folder), "rows")
    parts = undersampled.fit_parts(rows, GNB, 4)
    return undersampled.cube_vote(rows, parts, "ncweighted", oversampled=True).select("row_id", "y_pred")


@query()
def umce_vote_reduced(spark, folder):
    """Members merged to segments by the signed-rank test."""
    rows = settle(imbalanced(spark, folder), "rows")
    parts = undersampled.fit_parts(rows, GNB, 4)
    segments = undersampled.member_segments(rows, parts)
    return undersampled.cube_vote(rows, parts, "weighted", segments).select("row_id", "y_pred")


@query(with_("""d AS (SELECT l_returnflag AS g, l_quantity - 25.5 AS d FROM lineitem WHERE l_quantity <> 25.5)""",
  """r AS (SELECT g, d, rank() OVER (PARTITION BY g ORDER BY abs(d)) + (count(*) OVER (PARTITION BY g, abs(d)) - 1) / 2.0 AS r FROM d)""",
  """t AS (SELECT g, sum(n * n * n - n) AS ties FROM (SELECT g, CAST(count(*) AS DOUBLE) AS n FROM d GROUP BY g, abs(d)) GROUP BY g)""",
  """s AS (SELECT g, count(*) AS n, sum(r) FILTER (d > 0) AS wp, sum(r) FILTER (d < 0) AS wm FROM r GROUP BY g)""",
  select="""SELECT g, n, round(CAST(wp AS DOUBLE), 3) AS w_plus, round(CAST(wm AS DOUBLE), 3) AS w_minus,
  round((least(wp, wm) - CAST(n AS DOUBLE) * (n + 1) / 4) / sqrt((CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) - ties / 2) / 24), 5) AS z FROM s JOIN t USING (g)"""))
def wilcoxon(spark, folder):
    d = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_quantity") - 25.5).alias("d"))
    found = undersampled.wilcoxon(d, ["g"])
    return found.select("g", "n", F.round("w_plus", 3).alias("w_plus"), F.round("w_minus", 3).alias("w_minus"), F.round("z", 5).alias("z"))


HALF_IMB = [IMBALANCED.replace("vectors AS", "whole AS"), HALVES.replace("FROM vectors", "FROM whole"),
  "vectors AS (SELECT row_id, x, y FROM train)"]


@query(with_(*HALF_IMB, UNDER, OVER,
  """vtrain AS (SELECT 'plain' AS variant, x, y, CAST(1 AS DOUBLE) AS w FROM vectors UNION ALL SELECT 'under', x, y, CAST(1 AS DOUBLE) FROM under
    UNION ALL SELECT 'over', x, y, w FROM over_)""",
  "vtest AS (SELECT v AS variant, row_id, x, y FROM test, (SELECT unnest(['plain', 'under', 'over']) AS v))",
  gnb_cte(["variant"], ALL4, "g", "vtrain", "vtest", w="w"),
  select="""SELECT variant, round(avg(r), 6) AS bac FROM (SELECT variant, y_true, avg(CAST(y_true = y_pred AS DOUBLE)) AS r FROM g GROUP BY ALL) GROUP BY variant"""))
def resampling_bac(spark, folder):
    train, test = halves(imbalanced(spark, folder))
    found = undersampled.resampling_bac(train.select("row_id", "x", "y"), test.select("row_id", "x", "y"), GNB, 4)
    return found.withColumn("bac", F.round("bac", 6))


@query(with_(IMBALANCED, UNDER, "train AS (SELECT 0 AS member, x, y FROM under)", "test AS (SELECT 0 AS member, row_id, x, y FROM vectors)",
  gnb_cte(["member"], ALL4), select="SELECT row_id, y_pred FROM gpred"), name="resampled_fit")
def resampled_fit_predict(spark, folder):
    rows = imbalanced(spark, folder)
    model = resampled_fit(GNB, sampling.undersample(rows), 4, 2)
    return GNB.predict(rows.withColumn("member", F.lit(0)), model, ["member"]).select("row_id", "y_pred")


# ---- combination rules on bootstrap decisions ----

DECISIONS = [STATUS, BOOT, """c AS (SELECT member, v.y, i, sum(w * x[i]) / sum(w) AS m FROM boot JOIN vectors v USING (row_id),
    (SELECT unnest(range(1, 5)) AS i) GROUP BY ALL)""",
  "ax AS (SELECT member, i, avg(m) AS b, max(m) FILTER (y = 1) - avg(m) AS w FROM c GROUP BY member, i)",
  "d AS (SELECT row_id, member, sum((x[i] - b) * w) AS d FROM vectors, ax GROUP BY ALL)",
  "rms AS (SELECT sqrt(avg(d * d)) AS rms FROM d)",
  "s AS (SELECT row_id, d, least(1 - 1e-6, greatest(1e-6, (d / rms + 3) / 6)) AS s FROM d, rms)"]
RULES = {
    "geo_mean_vote": ("gmean", "(exp(avg(ln(s))) - 0.5) * 6"),
    "harmonic_vote": ("hmean", "(1 / avg(1 / s) - 0.5) * 6"),
    "mean_vote": ("mean", "avg(d)"),
    "robust_vote": ("rbh", """CASE WHEN median(d) > max(d) + min(d) THEN max(d) - h ELSE min(d) + h END"""),
}


def _rule(name: str, rule: str, expr: str) -> None:
    harmonic = "2 * (max(d) - median(d)) * (median(d) - min(d)) / (max(d) - min(d))"
    expr = expr.replace(" h ", f" coalesce({harmonic}, 0) ")
    sql = with_(*DECISIONS, select=f"SELECT row_id, round({expr}, 4) AS decision FROM s GROUP BY row_id")

    @query(sql, name=name)
    def run(spark, folder):
        rows = settle(status_vectors(spark, folder), "rows")
        members = combining.decision_members(sampling.bootstrap(rows, 3), 4)
        found = combining.combined(rows, members, combining.decision_scale(rows, members), rule)
        return found.select("row_id", F.round("decision", 4).alias("decision"))


for _name, (_r, _e) in RULES.items():
    _rule(_name, _r, _e)


# ---- dynamic selection: three members on feature blocks ----

BLOCKS = [list(range(0, 22)), list(range(22, 43)), list(range(43, 64))]
SELECT = [POINTS, HALVES, *[gnb_cte([], [i + 1 for i in b], f"m{j}", test="halves") for j, b in enumerate(BLOCKS)],
  "votes AS (" + " UNION ALL ".join(f"SELECT {j} AS member, row_id, y_true, y_pred FROM m{j}" for j in range(3)) + ")",
  """near AS (SELECT * FROM (SELECT q.row_id AS q, b.row_id AS other, row_number() OVER (PARTITION BY q.row_id ORDER BY list_distance(q.x, b.x), b.row_id) AS rk
    FROM test q, train b) WHERE rk <= 7)"""]


def selection(spark, folder):
    train, test = halves(points(spark, folder))
    train, test = train.select("row_id", "x", "y"), test.select("row_id", "x", "y")
    blocks = spark.createDataFrame([(i, b) for i, b in enumerate(BLOCKS)], "member int, features array<int>")
    return test, train, Ensemble.fit(GNB, train, 64, 10, blocks)


@query(with_(*SELECT, "comp AS (SELECT q, member, count(*) FILTER (y_true = y_pred) AS w FROM near JOIN votes ON other = row_id GROUP BY ALL)",
  "tally AS (SELECT q, y_pred, sum(w) AS s FROM comp JOIN votes v ON v.row_id = q AND v.member = comp.member GROUP BY ALL)",
  select="SELECT q AS row_id, CASE WHEN max(s) = 0 THEN 0 ELSE CAST(arg_max(y_pred, s * 100 - y_pred) AS INTEGER) END AS y_pred FROM tally GROUP BY q"))
def dynamic_union(spark, folder):
    test, train, ensemble = selection(spark, folder)
    return selecting.dynamic_union(test, train, ensemble, 7).select("row_id", "y_pred")


@query(with_(*SELECT, """run AS (SELECT q, member, coalesce(min(rk) FILTER (y_true <> y_pred) - 1, 7) AS run FROM near JOIN votes ON other = row_id GROUP BY ALL)""",
  "best AS (SELECT *, max(run) OVER (PARTITION BY q) AS top FROM run)",
  "tally AS (SELECT q, y_pred, count(*) AS s FROM best JOIN votes v ON v.row_id = q AND v.member = best.member WHERE run = top GROUP BY ALL)",
  select="SELECT q AS row_id, CAST(arg_max(y_pred, s * 100 - y_pred) AS INTEGER) AS y_pred FROM tally GROUP BY q"))
def dynamic_eliminate(spark, folder):
    test, train, ensemble = selection(spark, folder)
    return selecting.dynamic_eliminate(test, train, ensemble, 7).select("row_id", "y_pred")


# ---- masks, clusters, principal axes, regression ----

POOL = np.array([[[(e + m + f) % 3 > 0 for f in range(4)] for m in range(3)] for e in range(4)])


@query(with_(STATUS, "train AS (SELECT * FROM vectors)", """mo AS (SELECT y AS c, i, CAST(count(*) AS DOUBLE) AS n, avg(x[i]) AS m, var_pop(x[i]) AS v FROM vectors,
    (SELECT unnest(range(1, 5)) AS i) GROUP BY ALL)""",
  """mv AS (SELECT e, k AS member, c, i, n, m, CASE WHEN (e + k + i - 1) % 3 > 0 THEN greatest(v, (SELECT max(v) FROM mo) * 1e-9) ELSE 1e7 END AS v FROM mo, (SELECT unnest(range(4)) AS e),
    (SELECT unnest(range(3)) AS k))""",
  "lj AS (SELECT e, member, row_id, y, c, ln(any_value(n)) + sum(-0.5 * ln(2 * pi() * v) - (x[i] - m) ** 2 / (2 * v)) AS s FROM vectors, mv GROUP BY ALL)",
  "ex AS (SELECT *, exp(s - max(s) OVER (PARTITION BY e, member, row_id)) AS z FROM lj)",
  "pr AS (SELECT e, row_id, y, c, avg(p) AS p FROM (SELECT *, z / sum(z) OVER (PARTITION BY e, member, row_id) AS p FROM ex) GROUP BY ALL)",
  "pd AS (SELECT e, row_id, y AS y_true, arg_max(c, p) AS y_pred FROM pr GROUP BY ALL)",
  """fc AS (SELECT e, c, CAST(count(*) FILTER (y_true = c AND y_pred = c) AS DOUBLE) AS tp, CAST(count(*) FILTER (y_true = c) AS DOUBLE) AS sup,
    CAST(count(*) FILTER (y_pred = c) AS DOUBLE) AS pre FROM pd, (SELECT unnest([0, 1]) AS c) GROUP BY ALL)""",
  "bits AS (SELECT e, i, count(*) FILTER ((e + k + i) % 3 > 0) AS b FROM (SELECT unnest(range(4)) AS e), (SELECT unnest(range(3)) AS k), (SELECT unnest(range(4)) AS i) GROUP BY ALL)",
  "reg AS (SELECT e, avg(CAST(b > 0 AS DOUBLE)) AS usage, sum(b * (3 - b)) / 3 / 4 AS spread FROM bits GROUP BY e)",
  "sc AS (SELECT e, sum(sup * 2 * tp / (sup + pre)) / sum(sup) AS score FROM fc GROUP BY e)",
  select="""SELECT CAST(e AS INTEGER) AS ensemble, round(score, 6) AS score, round(usage, 6) AS usage, round(spread, 6) AS spread,
  round(score - 0.1 * usage + 0.05 * spread, 6) AS quality FROM sc JOIN reg USING (e)"""))
def mask_quality(spark, folder):
    found = masking.mask_quality(status_vectors(spark, folder), 4, POOL, 0.1, 0.05)
    return found.select("ensemble", *[F.round(c, 6).alias(c) for c in ("score", "usage", "spread", "quality")])


@query()
def mask_evolution(spark, folder):
    rows = two(points(spark, folder))
    pool = masking.hashed_pool(rows, 8, 3, 64)
    return masking.evolve(rows, 64, pool, generations=4)[1]


@query()
def cluster_members(spark, folder):
    rows = two(points(spark, folder))
    return local.cluster_members(rows, GNB, 64)[0]


@query()
def pca_subspaces(spark, folder):
    return subspaces.pca_subspaces(points(spark, folder))


@query()
def pca_subspaces_evr(spark, folder):
    return subspaces.pca_subspaces_evr(points(spark, folder), 0.3)


@query()
def pca_vote(spark, folder):
    rows = settle(two(points(spark, folder)), "rows")
    return subspaces.margin_vote(rows, subspaces.pca_subspaces(rows), 10).select("row_id", "margin", "y_pred")


@query()
def random_margin_vote(spark, folder):
    rows = settle(two(points(spark, folder)), "rows")
    return subspaces.margin_vote(rows, subspaces.random_subspaces(spark, 64, 4, 4), 10).select("row_id", "margin", "y_pred")


@query()
def nonuniform_vote(spark, folder):
    """Trees on subspaces drawn by logistic importance."""
    rows = settle(two(points(spark, folder)), "rows")
    shares = subspaces.subspace_shares(subspaces.logistic_importance(rows, 64))
    ensemble = Ensemble.fit(DecisionTree(), rows, 64, 2, subspaces.weighted_subspaces(shares, 10, 2))
    return soft_vote(rows, ensemble).select("row_id", "y_pred")


REG = """folds AS (SELECT row_id, q, p, CAST(ntile(5) OVER (ORDER BY md5(concat_ws('|', 1410, row_id)), row_id) - 1 AS INTEGER) AS fold FROM
    (SELECT row_id, x[1] AS q, x[2] AS p FROM vectors)),
  fit AS (SELECT f, regr_slope(p, q) AS b, regr_intercept(p, q) AS a FROM folds, (SELECT unnest(range(5)) AS f) WHERE fold <> f GROUP BY f),
  sc AS (SELECT f, a, b, 1 - var_pop(p - (a + b * q)) / var_pop(p) AS s FROM folds JOIN fit ON fold = f GROUP BY f, a, b),
  w AS (SELECT sum(s * a) / sum(s) AS a, sum(s * b) / sum(s) AS b FROM sc)"""


def _regression(spark, folder):
    rows = settle(status_vectors(spark, folder).select(
        "row_id", F.array(F.get("x", F.lit(0))).alias("x"), F.get("x", F.lit(1)).alias("y")), "rows")
    return rows, regression.fit_folds(rows, 1)


@query(with_(STATUS, REG, "g AS (SELECT id, 1 + " + hash_sql("1410", "'guess'", "0", "id") + " % 49 AS q FROM (SELECT unnest(range(100000)) AS id))",
  select="SELECT CAST(q AS DOUBLE) AS x, round(a + b * q, 3) AS y_hat FROM g, w ORDER BY a + b * q, id LIMIT 1"))
def monte_carlo_min(spark, folder):
    rows, model = _regression(spark, folder)
    found = regression.monte_carlo_min(rows, model, [(1, 50)])
    return found.select(F.get("x", F.lit(0)).alias("x"), F.round("y_hat", 3).alias("y_hat"))


@query(with_(STATUS, REG, select="SELECT row_id, round(w.a + w.b * q, 3) AS y_hat FROM folds, w"))
def regression_predict(spark, folder):
    rows, model = _regression(spark, folder)
    return regression.predict(rows, model).select("row_id", F.round("y_hat", 3).alias("y_hat"))


@query(with_(STATUS, REG, select="SELECT q AS x, round(w.a + w.b * q, 3) AS y_hat, p AS y FROM folds, w ORDER BY p, row_id LIMIT 1"))
def stored_minimum(spark, folder):
    rows, model = _regression(spark, folder)
    found = regression.stored_minimum(rows, model)
    return found.select(F.get("x", F.lit(0)).alias("x"), F.round("y_hat", 3).alias("y_hat"), "y")
