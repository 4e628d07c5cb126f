"""Ensembles as one array of member models.

All members are trained in one job (key ``member``) and packed into a single array,
whose size depends on the number of members, not on the rows. Every row is then
scored by all members where it is: voting needs neither a join nor a shuffle.
Learners with ``arrays`` score whole batches of rows; rows with missing values, and other learners, take the expression.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe.functions.arrays import let, take
from trustframe.learners.base import Learner, best_class
from trustframe.operators.storage import settle, settle_small, with_row


class Ensemble:
    """Members of one learner, each with optional feature subset and weight."""

    def __init__(self, learner: Learner, packed: DataFrame, dim: int, n_classes: int, subspaced: bool):
        self.learner, self.packed, self.dim, self.n_classes, self.subspaced = learner, packed, dim, n_classes, subspaced

    @classmethod
    def fit(
        cls,
        learner: Learner,
        train: DataFrame,
        dim: int,
        n_classes: int,
        subspaces: DataFrame | None = None,
    ) -> Ensemble:
        """``train`` has (member, x, y[, w]); with ``subspaces`` (member, features) it has
        (x, y[, w]) and every member sees all rows through its features; members of equally many
        features are trained together."""
        if subspaces is None:
            model = learner.fit(train, ["member"], dim, n_classes)
        else:
            subs = settle_small(subspaces.select("member", "features", F.size("features").alias("d")), "subspaces")
            parts = []
            for size in sorted(r["d"] for r in subs.select("d").distinct().collect()):
                some = subs.where(F.col("d") == size).drop("d")
                parts.append(learner.fit(project(train, some), ["member"], size, n_classes).join(some, "member"))
            model = reduce(DataFrame.unionByName, parts)
        fields = [c for c in model.columns if c != "member"]
        listed = F.collect_list(F.struct("member", *fields))
        packed = model.agg(F.array_sort(listed, lambda a, b: a["member"] - b["member"]).alias("members"))
        return cls(learner, settle(packed, "ensemble"), dim, n_classes, subspaces is not None)

    def supports(self, rows: DataFrame, out: str = "esm") -> DataFrame:
        """Adds array<array<double>>: member by class."""
        def one(m: Column) -> Column:
            x = take(F.col("x"), m["features"]) if self.subspaced else F.col("x")
            return dense(self.learner.score_classes(x, lambda name: m[name]), self.n_classes)

        return self._scored(rows, out, one, votes=False)

    def votes(self, rows: DataFrame, out: str = "votes") -> DataFrame:
        """Adds array<int>: the class each member predicts."""
        def one(m: Column) -> Column:
            x = take(F.col("x"), m["features"]) if self.subspaced else F.col("x")
            return best_class(self.learner.score_classes(x, lambda name: m[name]))

        return self._scored(rows, out, one, votes=True)

    def _scored(self, rows: DataFrame, out: str, one: Callable[[Column], Column], votes: bool) -> DataFrame:
        each = F.transform("members", one)
        if type(self.learner).arrays is Learner.arrays:
            return with_row(rows, self.packed).withColumn(out, each).drop("members")
        learner, dim, n_classes = self.learner, self.dim, self.n_classes
        members = self.packed.first()["members"]
        held = [(list(m["features"]) if self.subspaced else None, *learner.arrays(m)) for m in members]

        def scored(x: pa.Array) -> pa.Array:
            """Null for a row that is not given."""
            found = np.full((len(x), len(held), 1 if votes else n_classes), 0.0)
            some = np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False))
            values = x.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
            for k, (features, codes, held_by) in enumerate(held if len(some) else []):
                given = learner.supports_of(values if features is None else values[:, features], held_by)
                if votes:
                    found[some, k, 0] = codes[given.argmax(axis=1)]
                else:
                    found[some[:, None], k, codes] = given
            inner = pa.array(found.ravel())
            if votes:
                inner = inner.cast(pa.int32())
            else:
                inner = pa.ListArray.from_arrays(pa.array(np.arange(len(x) * len(held) + 1, dtype=np.int32) * n_classes), inner)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(held)), inner, mask=x.is_null())

        batch = F.arrow_udf(scored, "array<int>" if votes else "array<array<double>>")
        whole = (F.size("x") == dim) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v))
        given = F.when(F.coalesce(whole, F.lit(False)), F.col("x"))
        fast = with_row(rows.withColumn("_fast", batch(given)), self.packed)  # the members are not sent with the rows
        return fast.withColumn(out, F.coalesce("_fast", each)).drop("members", "_fast")


def project(train: DataFrame, subspaces: DataFrame) -> DataFrame:
    """One copy of each row per member, reduced to the member's features."""
    members = subspaces.agg(F.collect_list(F.struct("member", "features"))).scalar()
    return (
        train.withColumn("s", F.explode(members))
        .withColumn("member", F.col("s.member"))
        .withColumn("x", take(F.col("x"), F.col("s.features")))
        .drop("s")
    )


def dense(supports: Column, n_classes: int) -> Column:
    """array<struct<c, support>> to one double per class code."""
    def of(bound: Column, c: Column) -> Column:
        return F.aggregate(
            F.filter(bound, lambda s: s["c"] == c), F.lit(0.0), lambda acc, s: acc + s["support"]
        )

    def all_classes(bound: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda c: of(bound, c))

    return let(supports, all_classes)


def argmax(values: Column) -> Column:
    """0-based position of the largest value, the first on ties."""
    return let(values, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def sum_over_members(esm: Column, n_classes: int) -> Column:
    zero = F.array(*[F.lit(0.0)] * n_classes)
    return F.aggregate(esm, zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))


def soft_vote(rows: DataFrame, ensemble: Ensemble) -> DataFrame:
    """Class of the largest mean support."""
    summed = sum_over_members(F.col("esm"), ensemble.n_classes)
    mean = F.transform(summed, lambda v: v / F.size("esm"))
    return ensemble.supports(rows).withColumn("support", mean).withColumn("y_pred", argmax(F.col("support"))).drop("esm")


def weighted_bincount(votes: Column, weights: Column, n_classes: int) -> Column:
    """Weight per class over the members' votes."""
    def per_class(pairs: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(n_classes - 1)),
            lambda c: F.aggregate(
                F.filter(pairs, lambda e: e["v"] == c), F.lit(0.0), lambda acc, e: acc + e["w"].cast("double")
            ),
        )

    return let(F.zip_with(votes, weights, lambda v, w: F.struct(v.alias("v"), w.alias("w"))), per_class)


def hard_vote(rows: DataFrame, ensemble: Ensemble) -> DataFrame:
    """Most frequent member prediction, smallest class on ties."""
    ones = F.transform("votes", lambda _: F.lit(1.0))
    return (
        ensemble.votes(rows)
        .withColumn("y_pred", argmax(weighted_bincount(F.col("votes"), ones, ensemble.n_classes)))
        .drop("votes")
    )


def member_predictions(rows: DataFrame, ensemble: Ensemble) -> DataFrame:
    """(row_id, model, y_true, y_pred): long form for diversity and scores."""
    return (
        ensemble.votes(rows)
        .select("row_id", F.col("y").alias("y_true"), F.posexplode("votes").alias("model", "y_pred"))
    )


def resampled_fit(learner: Learner, resampled: DataFrame, dim: int, n_classes: int) -> DataFrame:
    """Model trained on a resampled table (rows with optional ``w``), key ``member`` = 0."""
    return learner.fit(resampled.withColumn("member", F.lit(0)), ["member"], dim, n_classes)


__all__: Sequence[str] = [
    "Ensemble", "soft_vote", "hard_vote", "member_predictions", "resampled_fit", "argmax", "dense",
    "weighted_bincount", "sum_over_members", "project",
]
