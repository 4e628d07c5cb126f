"""Members that live on clusters of the rows."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustframe.learners.base import Learner
from trustframe.operators.storage import settle, settle_small


def cluster_rows(rows: DataFrame, clusters: int = 3, seed: int = 1410) -> DataFrame:
    """One k-means per class, each assigning all rows: adds (clustering, cluster)."""
    vectors = rows.withColumn("v", array_to_vector("x"))
    classes = [r["y"] for r in rows.select("y").distinct().orderBy("y").collect()]  # class codes
    out = None
    for c in classes:
        model = KMeans(k=clusters, seed=seed, featuresCol="v", predictionCol="cluster").fit(vectors.where(F.col("y") == c))
        part = model.transform(vectors).withColumn("clustering", F.lit(c)).drop("v")
        out = part if out is None else out.unionByName(part)
    return out


def cluster_members(
    rows: DataFrame, learner: Learner, dim: int, clusters: int = 3, seed: int = 1410
) -> tuple[DataFrame, DataFrame]:
    """(member sizes, model): one model per cluster that holds exactly two classes."""
    assigned = settle(cluster_rows(rows, clusters, seed), "clusters")
    keys = ["clustering", "cluster"]
    sizes = assigned.groupBy(*keys, "y").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("classes"), F.sum("n").alias("rows")
    )
    kept = settle_small(sizes.where(F.col("classes") == 2), "kept")
    n_classes = assigned.agg(F.max("y")).first()[0] + 1
    model = learner.fit(assigned.join(kept.select(*keys), keys, "left_semi"), keys, dim, n_classes)
    return kept, model
