"""Input frames of the registered queries and the SQL that builds the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.functions.arrays import pack
from trustframe.operators.storage import spread
from trustframe.operators.transforming import label_codes

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SEED = 1410


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def line_key():
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return F.md5(F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", cents.cast("string")))


def lines(spark: SparkSession, folder: str, label: str = "l_returnflag") -> DataFrame:
    """(row_id, four features, label)."""
    return table(spark, folder, "lineitem").select(line_key().alias("row_id"), *FEATURES, F.col(label).alias("label"))


KEY_SQL = (
    "md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, "
    "CAST(round(l_extendedprice * 100) AS BIGINT)))"
)
LINES = f"lines AS (SELECT {KEY_SQL} AS row_id, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag AS label FROM lineitem)"


def messy(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with NULL, NaN, inf and missing labels put in, few distinct values."""
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    n = F.col("l_linenumber")
    return table(spark, folder, "lineitem").select(
        line_key().alias("row_id"),
        F.when(n != 7, F.col("l_quantity")).alias("l_quantity"),
        F.when((n == 6) & (F.col("l_quantity") > 40), inf)
        .when((n == 6) & (F.col("l_quantity") < 3), -inf)
        .otherwise(F.col("l_discount")).alias("l_discount"),
        F.when((n == 5) & (F.col("l_quantity") > 45), nan).otherwise(F.col("l_tax")).alias("l_tax"),
        F.when(~((n == 4) & (F.col("l_quantity") < 2)), F.col("l_returnflag")).alias("label"),
    )


MESSY_FEATURES = ["l_quantity", "l_discount", "l_tax"]
MESSY_COLUMNS = [*MESSY_FEATURES, "label"]
MESSY = f"""messy AS (
  SELECT {KEY_SQL} AS row_id,
    CASE WHEN l_linenumber <> 7 THEN l_quantity END AS l_quantity,
    CASE WHEN l_linenumber = 6 AND l_quantity > 40 THEN 'infinity'::DOUBLE
         WHEN l_linenumber = 6 AND l_quantity < 3 THEN '-infinity'::DOUBLE ELSE l_discount END AS l_discount,
    CASE WHEN l_linenumber = 5 AND l_quantity > 45 THEN NULL ELSE l_tax END AS l_tax,
    CASE WHEN NOT (l_linenumber = 4 AND l_quantity < 2) THEN l_returnflag END AS label
  FROM lineitem)"""
UNIQUE = """deduped AS (
  SELECT min(row_id) AS row_id, l_quantity, l_discount, l_tax, label FROM messy GROUP BY ALL),
  normal AS (
  SELECT row_id, l_quantity, CASE WHEN isfinite(l_discount) THEN l_discount END AS l_discount, l_tax, label
  FROM deduped)"""
COMPLETE = """complete AS (
  SELECT * FROM normal WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL
    AND label IS NOT NULL)"""


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id, x of four features, y) of the lines, y = code of the return flag."""
    rows = lines(spark, folder)
    return spread(rows).join(label_codes(rows), "label").select("row_id", pack(FEATURES).alias("x"), "y")  # the codes need no spread rows


def status_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Two-class form: y = 1 for line status O."""
    df = spread(lines(spark, folder, "l_linestatus"))
    return df.select("row_id", pack(FEATURES).alias("x"), (F.col("label") == "O").cast("int").alias("y"))


def imbalanced(spark: SparkSession, folder: str) -> DataFrame:
    """Two imbalanced classes: y = 1 for lines of quantity above 40 with return flag R."""
    y = ((F.col("l_quantity") > 40) & (F.col("label") == "R")).cast("int")
    return spread(lines(spark, folder)).select("row_id", pack(FEATURES).alias("x"), y.alias("y"))


def points(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id, x of 64 values, y) of the embeddings."""
    rows = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").alias("y")
    )
    return spread(rows)


X_SQL = "[l_quantity, l_extendedprice, l_discount, l_tax]"
VECTORS = f"""vectors AS (
  SELECT {KEY_SQL} AS row_id, {X_SQL} AS x, CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS y
  FROM lineitem)"""
STATUS = f"""vectors AS (
  SELECT {KEY_SQL} AS row_id, {X_SQL} AS x, CAST(l_linestatus = 'O' AS INTEGER) AS y FROM lineitem)"""
IMBALANCED = f"""vectors AS (
  SELECT {KEY_SQL} AS row_id, {X_SQL} AS x, CAST(l_quantity > 40 AND l_returnflag = 'R' AS INTEGER) AS y FROM lineitem)"""
POINTS = "vectors AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS x, label AS y FROM embeddings)"


def hash_sql(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15) AS BIGINT)"


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
