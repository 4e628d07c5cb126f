"""Cutting lineage through a shared folder.

``settle`` writes a DataFrame below ``spark.checkpoint.dir`` and reads it back. The
result survives the loss of executors, is computed once, and has an exact size in
its statistics. Joins against it therefore need no hint: Spark broadcasts it while
it is below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles both sides beyond.

``settle_small`` does the same for tables that are expected to hold a few rows per
class or replicate: up to ``limit`` rows they stay in the plan as a local relation,
beyond that they are settled.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a local one only for local masters."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    set_dir = sc.getCheckpointDir()
    if set_dir:
        return set_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if sc.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="trustframe-")
    return _LOCAL_DIRS[sc.applicationId]


def with_row(df: DataFrame, single: DataFrame) -> DataFrame:
    """Adds the columns of a one-row table to every row (scalar subqueries, no join)."""
    if len(single.columns) == 1:
        return df.withColumn(single.columns[0], single.scalar())
    return df.withColumns({c: single.select(c).scalar() for c in single.columns})


def spread(df: DataFrame, key: str = "row_id") -> DataFrame:
    """A frame read from fewer files than the session has cores, split over all cores.

    For tables of few files only; tables of many files are already split by the scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df


def settle(df: DataFrame, label: str = "part") -> DataFrame:
    """Writes ``df`` to the shared folder and returns the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SMALL_ROWS = 20_000


def settle_small(df: DataFrame, label: str = "part", limit: int = SMALL_ROWS) -> DataFrame:
    """``df`` as a local relation if it has at most ``limit`` rows, settled otherwise."""
    rows = df.limit(limit + 1).toArrow()
    if rows.num_rows > limit:
        return settle(df, label)
    return df.sparkSession.createDataFrame(rows, df.schema)
