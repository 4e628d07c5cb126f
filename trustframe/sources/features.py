"""Reading labelled feature tables and collections of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trustframe.functions.arrays import pack
from trustframe.functions.hashing import hash_unit
from trustframe.operators.cleaning import nan_to_null
from trustframe.operators.storage import settle, settle_small

FILE_NAME = r"([a-zA-Z0-9\-_]+)\.csv(?:/[^/]*)?$"  # accepted file names (fixed pattern); the same for a folder of parts


def load_features(
    spark: SparkSession, source: DataFrame | str, label: str, delimiter: str = ",",
    schema: StructType | None = None, row_id: str | None = None,
) -> DataFrame:
    """(row_id, features as double, label) from a DataFrame or a headed CSV.

    Without ``row_id`` rows are numbered and the table is settled, so that the numbers
    stay the same when a task runs again.
    """
    if isinstance(source, DataFrame):
        df = source
    else:
        reader = spark.read.option("sep", delimiter).option("header", True)
        df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(source)
    features = [c for c in df.columns if c not in (label, row_id)]
    if row_id is None:
        df = settle(df.withColumn("row_id", F.monotonically_increasing_id()), "features")
    else:
        df = df.withColumnRenamed(row_id, "row_id")
    df = nan_to_null(df.withColumnRenamed(label, "label"), features)
    return df.select("row_id", *features, "label")


def load_collection(spark: SparkSession, folder: str, delimiter: str = ",") -> DataFrame:
    """(dataset, row_id, x, y) from a folder of headerless numeric CSVs, label last.

    A dataset is a file ``name.csv`` or a folder ``name.csv`` of parts, and has its own number of
    columns; rows of unequal length inside one raise ValueError. Blank lines are left out, a field that is no number is NULL.
    """
    lines = spark.read.option("pathGlobFilter", "*.csv").text(f"{folder.rstrip('/')}/*.csv")
    named = lines.withColumn("dataset", F.regexp_extract(F.input_file_name(), FILE_NAME, 1)).where("dataset <> '' AND trim(value) <> ''")
    parts = F.split(F.trim("value"), "\\Q" + delimiter + "\\E")
    values = named.select("dataset", F.transform(parts, lambda v: F.trim(v).try_cast("double")).alias("v"))
    rows = settle(
        values.select(
            "dataset",
            F.monotonically_increasing_id().alias("row_id"),
            F.slice("v", F.lit(1), F.size("v") - 1).alias("x"),
            F.element_at("v", -1).cast("int").alias("y"),
        ),
        "collection",
    )
    widths = rows.groupBy("dataset").agg(F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high"))
    uneven = widths.where("low < high").orderBy("dataset").first()
    if uneven is not None:
        raise ValueError(f"{uneven['dataset']} has rows of {uneven['low'] + 1} to {uneven['high'] + 1} columns")
    return rows


def dataset_catalogue(collection: DataFrame) -> DataFrame:
    """Rows, features and classes per dataset."""
    return collection.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(F.size("x")).alias("features"),
        F.count_distinct("y").alias("classes"),
    )


def dataset_tags(collection: DataFrame) -> DataFrame:
    """(dataset, tags): binary / multi-class, multi-feature from 8 features on, and
    imbalanced when a class is more than 3 times (rounded) the smallest one."""
    sizes = collection.groupBy("dataset", "y").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d"))
    per_dataset = Window.partitionBy("dataset")
    rated = sizes.withColumn("ratio", F.bround(F.col("n") / F.min("n").over(per_dataset), 0))
    summary = rated.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("classes"), F.max("d").alias("d"), F.max("ratio").alias("ratio")
    )
    tags = F.array_compact(
        F.array(
            F.when(F.col("classes") == 2, F.lit("binary")).otherwise(F.lit("multi-class")),
            F.when(F.col("d") >= 8, F.lit("multi-feature")),
            F.when(F.col("ratio") > 3, F.lit("imbalanced")).otherwise(F.lit("balanced")),
        )
    )
    return settle_small(summary.select("dataset", tags.alias("tags")), "tags")


def select_datasets(
    collection: DataFrame, selection: Sequence[str] | tuple[str, Sequence[str]]
) -> DataFrame:
    """By name (a list) or by tags (``("all", tags)`` or ``("any", tags)``)."""
    if isinstance(selection, tuple):
        mode, wanted = selection
        want = F.array(*[F.lit(t) for t in wanted])
        if mode == "all":
            good = F.size(F.array_except(want, F.col("tags"))) == 0
        elif mode == "any":
            good = F.arrays_overlap(want, F.col("tags"))
        else:
            raise ValueError("selection mode is 'all' or 'any'")
        return collection.join(dataset_tags(collection).where(good).select("dataset"), "dataset", "left_semi")
    return collection.where(F.col("dataset").isin(list(selection)))


def noise_dims(rows: DataFrame, dim: int, multiply: int = 2, seed: int = 1410) -> DataFrame:
    """Variants name_1 .. name_{multiply+1}: variant i has i-1 noisy copies of x appended.

    The noise is standard normal, by Box-Muller from hashes of (row, variant, feature),
    so re-running a task gives the same values.
    """
    def noisy(v, j, i):
        u = 1.0 - hash_unit(seed, "u", F.col("row_id"), F.lit(j), i)
        a = hash_unit(seed, "a", F.col("row_id"), F.lit(j), i)
        return v + F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * F.pi() * a)

    copies = [F.col("x")]
    variants = [F.struct(F.lit("_1").alias("suffix"), F.col("x").alias("x"))]
    def variant(j):
        return F.transform("x", lambda v, i: noisy(v, j, i))

    for j in range(1, multiply + 1):
        copies.append(variant(j))
        variants.append(F.struct(F.lit(f"_{j + 1}").alias("suffix"), F.concat(*copies).alias("x")))
    others = [c for c in rows.columns if c not in ("dataset", "x")]
    return rows.withColumn("v", F.explode(F.array(*variants))).select(
        F.concat("dataset", "v.suffix").alias("dataset"), *others, F.col("v.x").alias("x")
    )
