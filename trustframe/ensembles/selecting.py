"""Dynamic selection of members by their success on neighbouring validation rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustframe.ensembles.members import Ensemble, argmax, weighted_bincount
from trustframe.operators.neighbors import nearest
from trustframe.operators.storage import settle


def _neighbour_hits(queries: DataFrame, validation: DataFrame, ensemble: Ensemble, k: int, p: float) -> DataFrame:
    """(query_id, rank, ok): per neighbour the members' correctness as array<int>."""
    right = ensemble.votes(validation).select(
        "row_id", F.transform("votes", lambda v: (v == F.col("y")).cast("int")).alias("ok")
    )
    near = nearest(queries.withColumnRenamed("row_id", "query_id"), validation.select("row_id", "x"), k, p)
    return near.join(right, "row_id").select("query_id", "rank", "ok")


def _vote(queries: DataFrame, ensemble: Ensemble, weights: DataFrame) -> DataFrame:
    joined = ensemble.votes(queries).join(weights.withColumnRenamed("query_id", "row_id"), "row_id")
    decided = argmax(weighted_bincount(F.col("votes"), F.col("competence"), ensemble.n_classes))
    return joined.withColumn("y_pred", decided).drop("votes", "competence")


def dynamic_union(queries: DataFrame, validation: DataFrame, ensemble: Ensemble, k: int = 7) -> DataFrame:
    """A member's weight is its number of right answers on the k nearest validation rows.

    With fewer than k validation rows all members weigh the same.
    """
    validation = settle(validation, "validation")
    if validation.limit(k).count() < k:
        ones = F.transform("votes", lambda _: F.lit(1.0))
        return ensemble.votes(queries).withColumn(
            "y_pred", argmax(weighted_bincount(F.col("votes"), ones, ensemble.n_classes))
        ).drop("votes")
    hits = _neighbour_hits(queries, validation, ensemble, k, 2.0)
    # at most k neighbours per query
    summed = hits.groupBy("query_id").agg(F.collect_list("ok").alias("oks")).select(
        "query_id",
        F.aggregate(
            "oks", F.transform(F.get("oks", F.lit(0)), lambda _: F.lit(0)),
            lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b),
        ).alias("competence"),
    )
    return _vote(queries, ensemble, summed)


def dynamic_eliminate(
    queries: DataFrame, validation: DataFrame, ensemble: Ensemble, k: int = 70, p: float = 2.0
) -> DataFrame:
    """Members right on the longest run of nearest neighbours vote; k shrinks per row.

    If no member is right on the nearest neighbour, all members vote.
    """
    hits = _neighbour_hits(queries, settle(validation, "validation"), ensemble, k, p)
    runs = hits.select("query_id", "rank", F.posexplode("ok").alias("member", "hit")).groupBy("query_id", "member").agg(
        F.coalesce(F.min(F.when(F.col("hit") == 0, F.col("rank"))) - 1, F.max("rank")).alias("run")
    )
    lists = runs.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("member", "run"))).alias("r"))
    best = F.array_max(F.transform("r", lambda e: e["run"]))
    weights = lists.select("query_id", F.transform("r", lambda e: (e["run"] == best).cast("int")).alias("competence"))
    return _vote(queries, ensemble, weights)
