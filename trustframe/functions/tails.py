"""Tail probabilities of test statistics.

Student's t with whole degrees of freedom has a finite series, so it stays an
expression. The normal tail needs ``erfc``, which Spark SQL does not have; it is
applied to already aggregated statistics (one row per pair of models).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > |t|) for ``df`` >= 1 whole degrees of freedom (finite cosine series)."""
    n = df.cast("int")
    theta = F.atan(F.abs(t) / F.sqrt(n.cast("double")))
    cos2 = F.pow(F.cos(theta), 2)
    odd = n % 2 == 1
    terms = F.when(odd, F.expr("0") + (n - 1) / 2).otherwise(n / 2).cast("int")
    first = F.when(odd, F.cos(theta)).otherwise(F.lit(1.0))
    start = F.struct(F.lit(0.0).alias("s"), first.alias("term"))

    def step(acc: Column, j: Column) -> Column:
        ratio = F.when(odd, 2.0 * j / (2.0 * j + 1.0)).otherwise((2.0 * j - 1.0) / (2.0 * j))
        return F.struct(
            (acc["s"] + acc["term"]).alias("s"),
            (acc["term"] * cos2 * ratio).alias("term"),
        )

    series = F.when(terms < 1, F.lit(0.0)).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.greatest(terms, F.lit(1))), start, step, lambda a: a["s"])
    )
    inside = F.when(odd, 2.0 / math.pi * (theta + F.sin(theta) * series)).otherwise(
        F.sin(theta) * series
    )
    return F.greatest(F.lit(0.0), 1.0 - inside)


def normal_critical(alpha: float) -> float:
    """|z| beyond which a two-sided normal test has p < alpha."""
    return NormalDist().inv_cdf(1.0 - alpha / 2.0)


def with_normal_p(df: DataFrame, z: str, out: str = "p_value") -> DataFrame:
    """Adds the two-sided normal tail probability of column ``z``."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def tail(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[out] = [
                None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2.0)) for v in batch[z]
            ]
            yield batch

    return df.mapInPandas(tail, schema)
