"""The dataset report: profile, clean, sample, metrics, one row of results."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe.config import ReportConfig
from trustframe.functions.arrays import pack
from trustframe.learners import REGISTRY
from trustframe.operators.cleaning import any_missing, copies, drop_missing, nan_to_null, normalize_missing
from trustframe.operators.sampling import capped_sample, rare_class_filter
from trustframe.operators.storage import settle, settle_small
from trustframe.operators.transforming import label_encode, minmax_scale
from trustframe.plans.association import association
from trustframe.plans.redundancy import redundancy
from trustframe.plans.similarity import similarity_ae, similarity_pca

Metric = Callable[[DataFrame, Sequence[str], ReportConfig], DataFrame]
"""(cleaned sample with row_id, features, label; features; config) -> one-row DataFrame."""


def _learners(multiclass: bool) -> dict:
    pool = {"DT": REGISTRY["DT"](), "RF": REGISTRY["RF"](balanced=multiclass), "XGB": REGISTRY["XGB"]()}
    return pool


def _vectors(sample: DataFrame, features: Sequence[str], scale: bool) -> tuple[DataFrame, int]:
    coded = label_encode(minmax_scale(sample, features) if scale else sample)
    rows = settle(coded.select("row_id", pack(features).alias("x"), "y"), "vectors")
    return rows, rows.agg(F.max("y")).first()[0] + 1


def _labelled(sample: DataFrame, features: Sequence[str]) -> DataFrame:
    return sample.select("row_id", F.col("label").cast("string").alias("label"), pack(features).alias("x"))


def redundancy_metric(sample: DataFrame, features: Sequence[str], config: ReportConfig) -> DataFrame:
    rows, classes = _vectors(sample, features, scale=False)
    results, _ = redundancy(rows, _learners(classes > 2), len(features), classes, seed=config.seed)
    return results.agg(F.max("redundancy").alias("redundancy"), F.max("redundancy_passed").alias("redundancy_passed"))


def association_metric(sample: DataFrame, features: Sequence[str], config: ReportConfig) -> DataFrame:
    rows, classes = _vectors(sample, features, scale=True)
    return association(rows, _learners(classes > 2), len(features), classes, seed=config.seed)["result"]


def similarity_metric(sample: DataFrame, features: Sequence[str], config: ReportConfig) -> DataFrame:
    """Reconstruction by the trained network, whatever the number of features; below 4 it has no latent layer and raises."""
    return similarity_ae(_labelled(sample, features), len(features), seed=config.seed)[1]


def similarity_pca_metric(sample: DataFrame, features: Sequence[str], config: ReportConfig) -> DataFrame:
    """Reconstruction by principal axes."""
    return similarity_pca(_labelled(sample, features), len(features))[1]


METRICS: dict[str, Metric] = {
    "redundancy": redundancy_metric,
    "association": association_metric,
    "similarity": similarity_metric,
    "similarity_pca": similarity_pca_metric,
}


def register_metric(name: str, metric: Metric) -> None:
    """Makes a metric available under ``name`` in ``ReportConfig.metrics``."""
    METRICS[name] = metric


def distinct_rows(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per distinct (features, label) with its first row id and number of copies.

    Class sizes, duplicates and the deduplicated table all come from this one shuffle.
    """
    raw = nan_to_null(df, features).select("row_id", *features, "label")
    return settle(copies(raw, [*features, "label"]), "distinct")


def clean(
    df: DataFrame, features: Sequence[str], config: ReportConfig, distinct: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(table after duplicates, inf as NULL; cleaned sample). ``df`` has row_id, features, label."""
    if config.delete_duplicated:
        rows = (distinct_rows(df, features) if distinct is None else distinct).drop("copies")
    else:
        rows = nan_to_null(df, features).select("row_id", *features, "label")
    rows = normalize_missing(rows, features)
    complete = drop_missing(rows, [*features, "label"]) if config.delete_nan else rows
    sample = rare_class_filter(
        capped_sample(complete, limit=config.sampling_limit, seed=config.seed), min_rows=config.min_sample_limit
    )
    return rows, sample


def _size_map(counts: DataFrame, n: str = "n") -> DataFrame:
    entries = F.collect_list(F.struct(F.col("label").cast("string"), F.col(n)))
    return counts.agg(F.map_from_entries(F.array_sort(entries)).alias("m"))


def profile_row(distinct: DataFrame, rows: DataFrame, features: Sequence[str], config: ReportConfig) -> DataFrame:
    """One row with every count of the report, from the distinct rows and the table after
    duplicates."""
    columns = [*features, "label"]
    by_class = settle_small(distinct.groupBy("label").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") - 1).alias("dup")), "classes")
    labelled = by_class.where(F.col("label").isNotNull())
    has_gap = any_missing(columns)
    kept = F.count_if(~has_gap) if config.delete_nan else F.count(F.lit(1))
    after = settle_small(
        rows.groupBy("label").agg(F.count_if(has_gap).alias("missing"), kept.alias("complete")), "after"
    )
    capped = after.where(F.col("label").isNotNull() & (F.col("complete") > 0)).select(
        "label", F.least("complete", F.lit(config.sampling_limit)).alias("n")
    )
    rare = capped.agg(F.count_if(F.col("n") <= config.min_sample_limit).alias("r"))
    totals = labelled.agg(F.count(F.lit(1)).alias("classes"))
    return totals.select(
        "classes",
        F.when(F.col("classes") > 2, F.lit(True)).alias("multiclass"),
        F.lit(len(features)).alias("features"),
        F.array(*[F.lit(c) for c in columns]).alias("feature_list"),
        _size_map(labelled).scalar().alias("original_samples"),
        by_class.agg(F.coalesce(F.sum("dup"), F.lit(0))).scalar().alias("duplicated"),
        after.agg(F.coalesce(F.sum("missing"), F.lit(0))).scalar().alias("missing"),
        F.lit(config.sampling_limit).alias("sampling_limit"),
        _size_map(capped).scalar().alias("analyzed_samples"),
        rare.scalar().alias("filtered_classes"),
        F.date_format(F.current_date(), "MM/dd/yy").alias("date"),
    )


def dataset_report(
    df: DataFrame,
    features: Sequence[str],
    config: ReportConfig = ReportConfig(),
    metrics: Mapping[str, Metric] | None = None,
) -> DataFrame:
    """One row: the profile and one struct per configured metric.

    ``df`` holds ``row_id``, the feature columns and ``label``.
    """
    pool = dict(METRICS if metrics is None else metrics)
    distinct = distinct_rows(df, features)
    rows, sample = clean(df, features, config, distinct)
    row = profile_row(distinct, rows, features, config)
    wanted = [m for m in config.metrics if m in pool]
    if wanted:
        sample = settle(sample, "sample")
    for name in wanted:
        found = settle(pool[name](sample, features, config), name)
        row = row.withColumn(name, found.select(F.struct(*found.columns)).scalar())
    return row


def catalogue_report(report: DataFrame) -> DataFrame:
    """The report in the catalogue's sections; a metric that was not run gives NULL."""
    def value(path: str) -> Column:
        head, _, tail = path.partition(".")
        if head not in report.columns:
            return F.lit(None).cast("string")
        fields = report.schema[head].dataType
        if tail and tail not in fields.fieldNames():
            return F.lit(None).cast("string")
        return F.col(path).cast("string")

    insights = F.format_string(
        "The dataset has %d small classes, %d duplicated samples, %d missing values",
        "filtered_classes", "duplicated", "missing",
    )
    return report.select(
        F.struct(F.lit("").alias("data_collection_tool"), F.lit("").alias("feature_extraction_tool")).alias("collection_workflow"),
        F.struct(
            F.col("classes").cast("string").alias("classes"),
            F.col("features").cast("string").alias("features"),
            value("association.max_clf_score").alias("f1-score"),
            insights.alias("key_observations"),
            F.to_json("original_samples").alias("per_class_data"),
            F.to_json("feature_list").alias("per_feature_data"),
        ).alias("generic_info"),
        F.lit("").alias("dataset_drift_analysis"),
        F.struct(
            value("association.association").alias("permutation_slope"),
            value("association.status").alias("p_value_status"),
            value("redundancy.redundancy").alias("redundancy"),
            value("similarity.similarity").alias("similarity"),
        ).alias("advanced_metrics"),
        F.struct(F.lit("").alias("use_case"), F.lit("").alias("similar_dataset")).alias("dataset_comparison"),
    )
