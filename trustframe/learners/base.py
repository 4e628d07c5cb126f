"""What the learners share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from trustframe.functions.arrays import let

Fields = Callable[[str], Column]


class Learner:
    """``fit`` and ``score_classes`` are given by each learner."""

    needs_bins = False

    def fit(self, train: DataFrame, keys: Sequence[str], dim: int, n_classes: int) -> DataFrame:
        raise NotImplementedError

    def summary_fields(self, train: DataFrame, x: Column, dim: int) -> dict[str, Column] | None:
        """The aggregates of ``summaries``, by name, if one pass over the rows gives them; ``x`` stands for the features."""
        return None

    def summaries(self, train: DataFrame, keys: Sequence[str], dim: int) -> DataFrame | None:
        """(keys, y, sums) that can be added up over a key and from which ``fit_summaries`` makes the models.

        None if the learner needs the rows themselves.
        """
        fields = self.summary_fields(train, F.col("x"), dim)
        return None if fields is None else train.groupBy(*keys, "y").agg(*[c.alias(n) for n, c in fields.items()])

    def fit_summaries(self, parts: DataFrame, keys: Sequence[str], dim: int) -> DataFrame:
        """The models that ``fit`` gives on the rows behind all summaries of each key."""
        raise NotImplementedError

    def arrays(self, model: Row) -> tuple[np.ndarray, tuple]:
        """The class codes, ascending, and what ``scores_of`` needs of one model; for learners with ``summaries``."""
        raise NotImplementedError

    def scores_of(self, x: np.ndarray, held: tuple) -> np.ndarray:
        """Rows by classes: as ``predict`` compares them."""
        raise NotImplementedError

    def supports_of(self, x: np.ndarray, held: tuple) -> np.ndarray:
        """Rows by classes: the supports that ``score_classes`` gives."""
        return self.scores_of(x, held)

    def score_classes(self, x: Column, model: Fields = F.col) -> Column:
        """array<struct<c int, support double>> from ``x`` and the model's fields.

        ``model`` gives a field by name: a column of a joined model table, or a field of
        one member in an array of models.
        """
        raise NotImplementedError

    def supports(self, test: DataFrame, model: DataFrame, keys: Sequence[str]) -> DataFrame:
        """``test`` with ``supports``, for rows whose key has a model."""
        scored = test.join(model, list(keys)).withColumn("supports", self.score_classes(F.col("x")))
        return scored.drop(*[c for c in model.columns if c not in keys])

    def predict(self, test: DataFrame, model: DataFrame, keys: Sequence[str]) -> DataFrame:
        return self.supports(test, model, keys).withColumn("y_pred", best_class(F.col("supports"))).drop("supports")


class Projected(Learner):
    """A learner that sees only the given 0-based features."""

    def __init__(self, learner: Learner, features: Sequence[int]):
        self.learner, self.features = learner, list(features)

    def _seen(self, x: Column) -> Column:
        return F.array(*[F.get(x, F.lit(i)) for i in self.features])

    def fit(self, train: DataFrame, keys: Sequence[str], dim: int, n_classes: int) -> DataFrame:
        seen = train.withColumn("x", self._seen(F.col("x"))).drop("b")  # bins belong to the unprojected features
        return self.learner.fit(seen, keys, len(self.features), n_classes)

    def summary_fields(self, train: DataFrame, x: Column, dim: int) -> dict[str, Column] | None:
        return self.learner.summary_fields(train, self._seen(x), len(self.features))

    def summaries(self, train: DataFrame, keys: Sequence[str], dim: int) -> DataFrame | None:
        return self.learner.summaries(train.withColumn("x", self._seen(F.col("x"))), keys, len(self.features))

    def fit_summaries(self, parts: DataFrame, keys: Sequence[str], dim: int) -> DataFrame:
        return self.learner.fit_summaries(parts, keys, len(self.features))

    def score_classes(self, x: Column, model: Fields = F.col) -> Column:
        return self.learner.score_classes(self._seen(x), model)

    def supports(self, test: DataFrame, model: DataFrame, keys: Sequence[str]) -> DataFrame:
        seen = test.withColumns({"_whole": F.col("x"), "x": self._seen(F.col("x"))})
        return self.learner.supports(seen, model, keys).withColumn("x", F.col("_whole")).drop("_whole")


def best_class(supports: Column) -> Column:
    """Class of largest support, lowest code on ties."""
    ranked = F.transform(supports, lambda s: F.struct(s["support"].alias("v"), (-s["c"]).alias("k")))
    return (-F.array_max(ranked)["k"]).cast("int")


def weight(train: DataFrame) -> Column:
    return F.col("w") if "w" in train.columns else F.lit(1.0)


def softmax(scores: Column) -> Column:
    """array<struct<c, s>> of log scores to array<struct<c, support>>."""
    def shifted(s: Column) -> Column:
        return let(
            F.array_max(F.transform(s, lambda m: m["s"])),
            lambda top: F.transform(s, lambda m: F.struct(m["c"].alias("c"), F.exp(m["s"] - top).alias("e"))),
        )

    def normalised(raw: Column) -> Column:
        return let(
            F.aggregate(raw, F.lit(0.0), lambda a, m: a + m["e"]),
            lambda norm: F.transform(
                raw, lambda m: F.struct(m["c"].alias("c"), (m["e"] / norm).alias("support"))
            ),
        )

    return let(let(scores, shifted), normalised)
