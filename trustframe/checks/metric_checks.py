"""Redundancy, association and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustframe.checks import kept, query
from trustframe.checks.models_sql import centroid_cte, f1_cte, folds_cte, gnb_cte, train_cte
from trustframe.checks.sampling_checks import md5_sql, permuted_sql
from trustframe.checks.tables import FEATURES, POINTS, lines, points, vectors, with_
from trustframe.functions.arrays import pack
from trustframe.learners import Boosting, DecisionTree, GaussianBayes, NearestCentroid, RandomForest
from trustframe.operators import permuting
from trustframe.operators.storage import settle
from trustframe.plans import association as assoc
from trustframe.plans import redundancy as red
from trustframe.plans import similarity as sim

@kept
def baseline(spark, folder):
    return settle(assoc.association_baseline(points(spark, folder), POOL, 64, 10), "baseline")


POOL = {"centroid": NearestCentroid(), "gnb": GaussianBayes()}
PERC = assoc.PERCENTAGES
DIMS = range(1, 65)


def splits_sql(fractions: str, runs: int) -> str:
    """Nested splits: one order per run and class, whatever the fraction."""
    return f"""ranked AS (SELECT row_id, x, y, CAST(rep AS INTEGER) AS rep, count(*) OVER (PARTITION BY rep, y) AS n,
      row_number() OVER (PARTITION BY rep, y ORDER BY {md5_sql('1410', 'rep', 'row_id')}, row_id) AS rank FROM vectors, (SELECT unnest(range({runs})) AS rep)),
  marked AS (SELECT row_id, x, y, rep, CAST(f.i AS INTEGER) AS frac_id, rank <= greatest(1, round_even(f.fr * n, 0)) AS is_train
      FROM ranked, (SELECT unnest(range(len({fractions}))) AS i, CAST(unnest({fractions}) AS DOUBLE) AS fr) f),
  train AS (SELECT * FROM marked WHERE is_train), test AS (SELECT * FROM marked WHERE NOT is_train)"""


FK = ["frac_id", "rep"]


@query(with_(POINTS, splits_sql("[0.9, 0.5]", 5), centroid_cte(FK, DIMS), f1_cte(FK, "cpred"),
  select="SELECT frac_id, rep, round(f1, 6) AS f1 FROM f1"))
def redundancy_probe(spark, folder):
    found = red.split_scores(points(spark, folder), NearestCentroid(), [0.9, 0.5], 5, 64, 10)
    return found.withColumn("f1", F.round("f1", 6))


def both_sql(fractions: str) -> str:
    """``scored`` (model, fraction, f1) of both closed-form learners and ``top`` (best)."""
    return ",\n".join([POINTS, splits_sql(fractions, 5), centroid_cte(FK, DIMS), f1_cte(FK, "cpred", "cf"), gnb_cte(FK, DIMS), f1_cte(FK, "gpred", "gf"),
      f"""scored AS (SELECT model, CAST({fractions}[frac_id + 1] AS DOUBLE) AS fraction, f1 FROM
        (SELECT 'centroid' AS model, frac_id, f1 FROM cf UNION ALL SELECT 'gnb', frac_id, f1 FROM gf))""",
      "top AS (SELECT max(f1) AS best FROM scored WHERE fraction = 0.9)",
      "passed AS (SELECT model, fraction, bool_and(best - f1 < 0.01 * best) AS ok FROM scored, top GROUP BY model, fraction)"])


@query(with_(both_sql("[0.001, 0.01, 0.1, 0.2, 0.5, 0.75, 0.9]"),
  select="SELECT min(fraction) FILTER (ok) AS fraction, round(1 - min(fraction) FILTER (ok), 6) AS redundancy FROM passed"))
def redundancy_grid(spark, folder):
    found = red.redundancy_grid(points(spark, folder), POOL, 64, 10)
    return found.withColumn("redundancy", F.round("redundancy", 6))


@query()
def redundancy(spark, folder):
    """Three learners at the defaults: 5 runs, tolerance 0.01, 7 halvings."""
    return red.redundancy(vectors(spark, folder), {**POOL, "tree": DecisionTree()}, 4, 3)[0]


@query()
def redundancy_tree(spark, folder):
    """A stacked tree: scores of all runs and fractions of the grid, trained in one job per level."""
    return red.split_scores(points(spark, folder), DecisionTree(), red.GRID, red.RUNS, 64, 10)


BASELINE = ",\n".join([POINTS, folds_cte("vectors", 2, out="btest"), train_cte(2, "btest", "btrain"),
  centroid_cte(["fold"], DIMS, "bc", "btrain", "btest"), gnb_cte(["fold"], DIMS, "bg", "btrain", "btest"),
  f1_cte(["fold"], "bc", "bcf"), f1_cte(["fold"], "bg", "bgf"),
  "baseline AS (SELECT 'centroid' AS model, avg(f1) AS score FROM bcf UNION ALL SELECT 'gnb', avg(f1) FROM bgf)"])


@query(with_(BASELINE, select="SELECT model, round(score, 6) AS score FROM baseline"))
def association_baseline(spark, folder):
    return baseline(spark, folder).withColumn("score", F.round("score", 6))


NPERM = assoc.PERMUTATIONS
PK = ["perm", "perc", "fold"]
PERMS = ",\n".join([BASELINE, permuted_sql(perms=NPERM, levels="50, 30, 10, 1"),
  "relabelled AS (SELECT perm, perc, row_id, x, y_perm AS y FROM permuted)",
  folds_cte("relabelled", 2, ["perm", "perc"]), train_cte(2),
  centroid_cte(PK, DIMS, "pc"), gnb_cte(PK, DIMS, "pg"), f1_cte(PK, "pc", "pcf"), f1_cte(PK, "pg", "pgf"),
  """perm_scores AS (SELECT perm, perc, 'centroid' AS model, avg(f1) AS score FROM pcf GROUP BY ALL
    UNION ALL SELECT perm, perc, 'gnb', avg(f1) FROM pgf GROUP BY ALL)""",
  "perm_corr AS (SELECT perm, perc, corr(y, y_perm) AS corr FROM permuted GROUP BY ALL)",
  """pvalues AS (SELECT s.model, perc, (count(*) FILTER (s.score >= b.score) + 1) / (count(*) + 1) AS p_value FROM perm_scores s
    JOIN baseline b ON s.model = b.model GROUP BY ALL)""",
  """pts AS (SELECT s.model, s.perc, list_position([50, 30, 10, 1], s.perc) - 1 AS level, avg(s.score) AS score,
    (SELECT avg(corr) FROM perm_corr c WHERE c.perc = s.perc) AS corr FROM perm_scores s GROUP BY ALL)""",
  """strips AS (SELECT model, (corr - lag(corr) OVER (PARTITION BY model ORDER BY level)) * (score + lag(score) OVER (PARTITION BY model ORDER BY level)) / 2 AS a FROM pts)""",
  """slopes AS (SELECT p.model, regr_slope(score, corr) AS slope, regr_intercept(score, corr) AS intercept,
    (SELECT sum(a) FROM strips t WHERE t.model = p.model) AS area FROM pts p GROUP BY p.model)""",
  "env AS (SELECT level, any_value(corr) AS corr, greatest(0, max(score)) AS score FROM pts GROUP BY level)",
  "envs AS (SELECT level, score, (corr - lag(corr) OVER (ORDER BY level)) * (score + lag(score) OVER (ORDER BY level)) / 2 AS a FROM env)",
  """result AS (SELECT sum(a) AS envelope_area, max(score) FILTER (level = 3) AS max_clf_score FROM envs)"""])


@kept
def permuted(spark, folder):
    rows = points(spark, folder)
    spec = permuting.spec_grid(NPERM, PERC)
    scores, corr = assoc.permutation_tables(rows, POOL, 64, 10, spec)
    return rows, scores, corr


@query(with_(PERMS, select="SELECT perm, perc, model, round(score, 6) AS score FROM perm_scores"))
def perm_scores(spark, folder):
    return permuted(spark, folder)[1].withColumn("score", F.round("score", 6))


@query(with_(PERMS, select="SELECT perm, perc, round(corr, 6) AS corr FROM perm_corr"))
def perm_corr(spark, folder):
    return permuted(spark, folder)[2].withColumn("corr", F.round("corr", 6))


@query(with_(PERMS, select="SELECT model, perc, round(p_value, 6) AS p_value FROM pvalues"))
def perm_pvalues(spark, folder):
    _, scores, _ = permuted(spark, folder)
    found = assoc.perm_pvalues(baseline(spark, folder), scores)
    return found.withColumn("p_value", F.round("p_value", 6))


@query(with_(PERMS, select="SELECT model, round(slope, 5) AS slope, round(intercept, 5) AS intercept, round(area, 6) AS area FROM slopes"))
def perm_slopes(spark, folder):
    _, scores, corr = permuted(spark, folder)
    found = assoc.perm_slopes(assoc.level_means(scores, corr, PERC))
    return found.select("model", F.round("slope", 5).alias("slope"), F.round("intercept", 5).alias("intercept"), F.round("area", 6).alias("area"))


@query(with_(PERMS, select="""SELECT round(envelope_area, 6) AS envelope_area, round(max_clf_score, 6) AS max_clf_score,
  round((0.5 - envelope_area / max_clf_score) / 0.25, 5) AS association, round((SELECT max(abs(slope)) FROM slopes), 5) AS max_slope,
  (SELECT arg_max(model, abs(slope)) FROM slopes) AS max_slope_model, (SELECT arg_max(model, abs(area)) FROM slopes) AS max_area_model,
  round((SELECT max(score) FROM baseline), 6) AS baseline_f1 FROM result"""))
def association_score(spark, folder):
    _, scores, corr = permuted(spark, folder)
    found = assoc.association_score(assoc.level_means(scores, corr, PERC), baseline(spark, folder))
    return found.withColumns({
        "envelope_area": F.round("envelope_area", 6), "max_clf_score": F.round("max_clf_score", 6),
        "association": F.round("association", 5), "max_slope": F.round("max_slope", 5), "baseline_f1": F.round("baseline_f1", 6),
    })


@query(with_(PERMS, """m AS (SELECT p.model, CASE p.model WHEN 'centroid' THEN 0 ELSE 1 END AS pos, count(*) FILTER (p_value > 0.01) AS above, any_value(b.score) AS score FROM pvalues p
    JOIN baseline b ON p.model = b.model GROUP BY p.model)""",
  "run AS (SELECT pos, sum(above) OVER (ORDER BY pos) AS c, score >= max(score) OVER (ORDER BY pos) AS leads FROM m)",
  select="""SELECT CASE WHEN bool_or(c = 4) THEN 'Bad' WHEN arg_max(leads, pos) FILTER (c = 0) THEN 'Good' WHEN bool_or(c < 4) THEN 'Mid' END AS status FROM run"""))
def association_status(spark, folder):
    _, scores, _ = permuted(spark, folder)
    true = baseline(spark, folder)
    return assoc.association_status(assoc.perm_pvalues(true, scores), true, list(POOL), len(PERC))


@query()
def association(spark, folder):
    """The whole test with the three tree learners at the defaults: 100 permutations at 4 percentages."""
    learners = {"DT": DecisionTree(), "RF": RandomForest(balanced=True), "XGB": Boosting()}
    return assoc.association(points(spark, folder), learners, 64, 10)["result"]


SIM = """scaled AS (SELECT label, list_transform(list_zip(x, lo, hi), lambda e: (e[1] - e[2]) / (e[3] - e[2])) AS x FROM
    (SELECT y AS label, x FROM vectors), (SELECT list(lo ORDER BY i) AS lo, list(hi ORDER BY i) AS hi FROM
      (SELECT i, min(x[i]) AS lo, max(x[i]) AS hi FROM vectors, (SELECT unnest(range(1, 65)) AS i) GROUP BY i))),
  base AS (SELECT label AS b FROM scaled GROUP BY label ORDER BY count(*) DESC, CAST(label AS VARCHAR) LIMIT 1),
  bm AS (SELECT i, avg(x[i]) AS m FROM scaled, base, (SELECT unnest(range(1, 65)) AS i) WHERE label = b GROUP BY i),
  err AS (SELECT label, count(*) / 64 AS n, avg(abs(x[i] - m)) AS l1 FROM scaled, bm GROUP BY label),
  rel AS (SELECT label, n, l1, l1 / (SELECT l1 FROM err, base WHERE label = b) AS relative FROM err)"""


def _labelled(spark, folder):
    return points(spark, folder).withColumnRenamed("y", "label")


@query(with_(POINTS, SIM, select="""SELECT round(sum(n * relative) / sum(n), 6) AS similarity, CAST(any_value(b) AS VARCHAR) AS base_class
  FROM rel, base WHERE label <> b"""))
def similarity_mean(spark, folder):
    return sim.similarity_mean(_labelled(spark, folder), 64)[1].withColumn("similarity", F.round("similarity", 6))


@query(with_(POINTS, SIM, select="""SELECT CAST(label AS VARCHAR) AS label, CAST(n AS BIGINT) AS n, round(l1, 6) AS l1, round(relative, 6) AS relative FROM rel"""))
def similarity_detail(spark, folder):
    found = sim.similarity_mean(_labelled(spark, folder), 64)[0]
    return found.withColumns({"l1": F.round("l1", 6), "relative": F.round("relative", 6)})


@query()
def similarity_pca(spark, folder):
    rows = lines(spark, folder).select("row_id", "label", pack(FEATURES).alias("x"))
    return sim.similarity_pca(rows, 4)[1]


@query()
def similarity_ae(spark, folder):
    return sim.similarity_ae(_labelled(spark, folder), 64)[1]
