"""Where results go: JSON reports, evidence tables, the prediction store."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from trustframe.functions.hashing import key_md5


def report_json(report: DataFrame) -> DataFrame:
    return report.select(F.to_json(F.struct(*report.columns)).alias("report"))


def write_report(report: DataFrame, path: str) -> None:
    """One JSON document per report row."""
    report.write.mode("errorifexists").json(path)


def save_evidence(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Every table below ``folder`` as parquet."""
    for name, table in tables.items():
        table.write.mode("errorifexists").parquet(f"{folder}/{name}")


def load_evidence(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def data_fingerprint(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, data_md5): independent of row order: md5 over count and sums of row hashes."""
    def lane(at: int):
        return F.conv(F.substring("h", at, 8), 16, 10).cast("bigint")

    hashed = rows.withColumn("h", F.md5(F.concat_ws("|", "row_id", F.col("x").cast("string"), F.col("y").cast("string"))))
    sums = hashed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(lane(1 + 8 * i).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)],
    )
    return sums.select(*keys, key_md5(*[F.col(c) for c in ("n", "s0", "s1", "s2", "s3")]).alias("data_md5"))


def planned_work(
    fingerprints: DataFrame, models: Mapping[str, str], folds: int, repeats: int, seed: int | None
) -> DataFrame:
    """(dataset, fold, model, fingerprint): what an evaluation will compute.

    ``models`` maps a model name to its parameters as text. Without a seed nothing can be
    reused, and the fingerprint is NULL.
    """
    pool = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(p).alias("params")) for m, p in models.items()])
    plan = fingerprints.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds * repeats - 1))))
    plan = plan.withColumn("m", F.explode(pool)).select("dataset", "data_md5", "fold", "m.model", "m.params")
    mark = (
        F.lit(None).cast("string")
        if seed is None
        else key_md5(F.col("data_md5"), F.col("fold"), repeats, folds, seed, F.col("model"), F.col("params"))
    )
    return plan.select("dataset", "fold", "model", mark.alias("fingerprint"))


def pending_work(planned: DataFrame, done: DataFrame | None) -> DataFrame:
    """Planned work whose fingerprint is not in the store."""
    if done is None:
        return planned
    return planned.join(done.select("fingerprint").distinct(), "fingerprint", "left_anti")


def store_predictions(predictions: DataFrame, path: str) -> None:
    """Appends predictions (with ``fingerprint``), one partition folder per fingerprint."""
    predictions.write.mode("append").partitionBy("fingerprint").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None
