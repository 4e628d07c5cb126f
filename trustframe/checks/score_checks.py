"""Scores on the predictions of a rule over the lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustframe.checks import query
from trustframe.checks.tables import table, with_
from trustframe.operators import scoring

KEYS = ["model"]

# Two rules predict the return flag code from quantity and discount; class 2 is never
# predicted by the second, and class 3 is predicted without existing.
PRED = """pred AS (SELECT 'a' AS model, t.* , CASE WHEN l_quantity < 17 THEN 0 WHEN l_quantity < 34 THEN 1 ELSE 2 END AS y_pred FROM t
  UNION ALL SELECT 'b', t.*, CASE WHEN l_discount < 0.03 THEN 0 WHEN l_discount < 0.09 THEN 1 ELSE 3 END FROM t)"""
T = """t AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y_true, l_quantity, l_discount, l_extendedprice
  FROM lineitem)"""
CONF = "conf AS (SELECT model, y_true, y_pred, count(*) AS n FROM pred GROUP BY ALL)"
CLASSES = """cls AS (SELECT model, c, CAST(coalesce(sum(n) FILTER (y_true = c AND y_pred = c), 0) AS DOUBLE) AS tp,
    CAST(coalesce(sum(n) FILTER (y_true = c), 0) AS DOUBLE) AS sup, CAST(coalesce(sum(n) FILTER (y_pred = c), 0) AS DOUBLE) AS pre,
    CAST(sum(n) AS DOUBLE) AS tot FROM conf, (SELECT unnest(range(4)) AS c) GROUP BY model, c)"""
BINARY = """bin AS (SELECT 'a' AS model, CAST(l_linestatus = 'O' AS INTEGER) AS y_true, CAST(l_quantity > 20 AS INTEGER) AS y_pred, l_quantity AS score
  FROM lineitem UNION ALL SELECT 'b', CAST(l_linestatus = 'O' AS INTEGER), CAST(l_discount > 0.05 AS INTEGER), l_extendedprice FROM lineitem)"""


def predictions(spark, folder):
    li = table(spark, folder, "lineitem")
    truth = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("y_true")
    q, d = F.col("l_quantity"), F.col("l_discount")
    a = F.when(q < 17, 0).when(q < 34, 1).otherwise(2)
    b = F.when(d < 0.03, 0).when(d < 0.09, 1).otherwise(3)
    rules = F.array(F.struct(F.lit("a").alias("model"), a.alias("y_pred")), F.struct(F.lit("b").alias("model"), b.alias("y_pred")))
    return li.select(truth, F.explode(rules).alias("r")).select("y_true", "r.model", "r.y_pred")


def binary(spark, folder):
    li = table(spark, folder, "lineitem")
    rules = F.array(
        F.struct(F.lit("a").alias("model"), (F.col("l_quantity") > 20).cast("int").alias("y_pred"), F.col("l_quantity").alias("score")),
        F.struct(F.lit("b").alias("model"), (F.col("l_discount") > 0.05).cast("int").alias("y_pred"), F.col("l_extendedprice").alias("score")),
    )
    return li.select((F.col("l_linestatus") == "O").cast("int").alias("y_true"), F.explode(rules).alias("r")).select("y_true", "r.*")


@query(with_(T, PRED, CONF, select="SELECT * FROM conf"))
def confusion(spark, folder):
    return scoring.confusion(predictions(spark, folder), KEYS)


WEIGHTED = {
    "f1_weighted": ("f1", "sum(sup / tot * CASE WHEN sup + pre > 0 THEN 2 * tp / (sup + pre) ELSE 0 END)"),
    "precision": ("precision", "sum(sup / tot * CASE WHEN pre > 0 THEN tp / pre ELSE 0 END)"),
    "recall": ("recall", "sum(sup / tot * CASE WHEN sup > 0 THEN tp / sup ELSE 0 END)"),
    "f2": ("f2", "sum(sup / tot * CASE WHEN 4 * sup + pre > 0 THEN 5 * tp / (4 * sup + pre) ELSE 0 END)"),
    "specificity": ("specificity", "sum(sup / tot * (tot - sup - pre + tp) / (tot - sup))"),
    "balanced_accuracy": ("bac", "avg(tp / sup) FILTER (sup > 0)"),
    "accuracy": ("accuracy", "sum(tp) / max(tot)"),
    "mcc": ("mcc", "(sum(tp) * max(tot) - sum(sup * pre)) / sqrt((max(tot) ** 2 - sum(sup * sup)) * (max(tot) ** 2 - sum(pre * pre)))"),
}


def _weighted(name: str, column: str, expr: str) -> None:
    sql = with_(T, PRED, CONF, CLASSES, select=f"SELECT model, round({expr}, 6) AS {column} FROM cls GROUP BY model")

    @query(sql, name=name)
    def run(spark, folder):
        wide = scoring.score_table_wide(scoring.confusion(predictions(spark, folder), KEYS), KEYS)
        return wide.select("model", F.round(column, 6).alias(column))


for _name, (_column, _expr) in WEIGHTED.items():
    _weighted(_name, _column, _expr)


@query(with_(T, PRED, CONF, """known AS (SELECT DISTINCT model, y_true AS c FROM conf)""", select="""SELECT model, round(avg(r), 6) AS bac_closed FROM
  (SELECT conf.model, y_true, coalesce(sum(n) FILTER (y_true = y_pred), 0) / sum(n) FILTER ((conf.model, y_pred) IN (SELECT (model, c) FROM known)) AS r
   FROM conf GROUP BY conf.model, y_true) GROUP BY model"""))
def balanced_accuracy_closed(spark, folder):
    found = scoring.balanced_accuracy_closed(scoring.confusion(predictions(spark, folder), KEYS), KEYS)
    return found.withColumn("bac_closed", F.round("bac_closed", 6))


RATES = """rates AS (SELECT model, count(*) FILTER (y_true = 1 AND y_pred = 1) / count(*) FILTER (y_true = 1) AS tpr,
  count(*) FILTER (y_true = 0 AND y_pred = 1) / count(*) FILTER (y_true = 0) AS fpr, avg(y_true) AS prevalence FROM bin GROUP BY model)"""


@query(with_(BINARY, RATES, select="SELECT model, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM rates"))
def tpr_fpr(spark, folder):
    found = scoring.tpr_fpr(scoring.confusion(binary(spark, folder), KEYS), KEYS)
    return found.select("model", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query(with_(BINARY, RATES, select="""SELECT model, round(prevalence * tpr / (prevalence * tpr + (1 - prevalence) * fpr), 6) AS ptf FROM rates"""))
def ptf(spark, folder):
    found = scoring.tpr_fpr(scoring.confusion(binary(spark, folder), KEYS), KEYS)
    return found.select("model", F.round("ptf", 6).alias("ptf"))


@query(with_(BINARY, """pts AS (SELECT model, score, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM bin GROUP BY model, score)""",
  """run AS (SELECT *, sum(neg) OVER (PARTITION BY model ORDER BY score) - neg AS below FROM pts)""",
  select="SELECT model, round(sum(pos * (below + neg / 2)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 6) AS roc_auc FROM run GROUP BY model"))
def roc_auc(spark, folder):
    return scoring.roc_auc(binary(spark, folder), KEYS).withColumn("roc_auc", F.round("roc_auc", 6))


@query(with_(BINARY, """pts AS (SELECT model, score, sum(y_true) AS pos, count(*) AS n FROM bin GROUP BY model, score)""",
  """run AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM pts WINDOW w AS (PARTITION BY model ORDER BY score DESC))""",
  select="SELECT model, round(sum(pos * tp / seen) / sum(pos), 6) AS average_precision FROM run GROUP BY model"))
def average_precision(spark, folder):
    return scoring.average_precision(binary(spark, folder), KEYS).withColumn("average_precision", F.round("average_precision", 6))


@query("""SELECT l_returnflag AS model, round(1 - var_pop(l_extendedprice - 1500 * l_quantity) / var_pop(l_extendedprice), 6)
  AS explained_variance FROM lineitem GROUP BY l_returnflag""")
def explained_variance(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("model"), F.col("l_extendedprice").alias("y"), (1500 * F.col("l_quantity")).alias("y_hat")
    )
    return scoring.explained_variance(rows, KEYS).withColumn("explained_variance", F.round("explained_variance", 6))


LEVELS = """lv AS (SELECT l_returnflag AS model, CAST(l_quantity AS INTEGER) AS level, avg(l_quantity) AS x, avg(l_extendedprice) AS y
  FROM lineitem GROUP BY ALL)"""


def _levels(spark, folder):
    return table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_quantity").cast("int").alias("level")).agg(
        F.avg("l_quantity").alias("x"), F.avg("l_extendedprice").alias("y")
    )


@query(with_(LEVELS, select="""SELECT model, round(sum((x - px) * (y + py)) / 2, 4) AS area FROM (SELECT *, lag(x) OVER w AS px,
  lag(y) OVER w AS py FROM lv WINDOW w AS (PARTITION BY model ORDER BY level)) GROUP BY model"""))
def trapezoid_auc(spark, folder):
    return scoring.trapezoid_auc(_levels(spark, folder), KEYS, "level", "x", "y").withColumn("area", F.round("area", 4))


@query(with_(LEVELS, select="""SELECT model, round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 4) AS intercept FROM lv GROUP BY model"""))
def slope(spark, folder):
    return scoring.slope(_levels(spark, folder), KEYS, "x", "y").select("model", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))
