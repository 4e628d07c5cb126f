"""Missing values and duplicates.

Order of the cleaning steps: NaN -> NULL at ingest, duplicates removed, +-inf -> NULL,
rows with NULL removed. An inf row and a NaN row are therefore not duplicates.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan_to_null(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns(
        {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features}
    )


def normalize_missing(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """NaN and +-inf become NULL."""
    def clean(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)

    return df.withColumns({c: clean(c) for c in features})


def any_missing(columns: Sequence[str]) -> Column:
    return reduce(or_, [F.col(c).isNull() for c in columns])


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop("any", subset=list(columns))


def missing_listing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(any_missing(columns))


def missing_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(F.count_if(any_missing(columns)).alias("missing_rows"))


def copies(df: DataFrame, columns: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """One row per distinct ``columns``: smallest row id and number of copies.

    A plain aggregate, so map-side combining absorbs a value that fills a third of
    the table; ``row_number`` per value would sort all its copies in one task.
    """
    return df.groupBy(*columns).agg(F.min(row_id).alias(row_id), F.count(F.lit(1)).alias("copies"))


def dedupe(df: DataFrame, columns: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """Keeps the first (smallest row id) of each group of equal rows."""
    return copies(df, columns, row_id).select(row_id, *columns)


def duplicate_count(df: DataFrame, columns: Sequence[str], out: str = "duplicates") -> DataFrame:
    """Surplus copies over all groups of equal rows."""
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    return groups.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias(out))


def duplicate_listing(df: DataFrame, columns: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """All rows that ``dedupe`` removes: each group of equal rows but one of its smallest row id.

    A row id may stand on several rows, of one group or of several: rows are counted by all their columns, and one of the first is taken off.
    """
    others = [c for c in df.columns if c != row_id and c not in columns]
    place = F.struct(F.col(row_id).isNull().alias("missing"), F.col(row_id).alias("id"), *others)
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_times"))
    firsts = counted.groupBy(*columns).agg(F.min(place).alias("_first")).select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(columns)], "_first"
    )
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(columns)]
    first = reduce(and_, same, place.eqNullSafe(F.col("_first")))
    left = counted.join(firsts, first, "left").withColumn("_times", F.col("_times") - F.col("_first").isNotNull().cast("int"))
    again = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times"))).alias("_turn")
    return left.where("_times > 0").select(*df.columns, again).drop("_turn")
