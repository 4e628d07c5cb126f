"""Samples, splits and folds. All of them are exact, seeded and order-independent.

Quota-type operators (cap, split, folds, under-sampling) only look up a cutoff key
per class (see ``ordering``) and decide row by row, without shuffling the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustframe.functions.arrays import half_even
from trustframe.functions.hashing import hash_below, key_md5
from trustframe.operators.ordering import even_blocks, first_rows, hash_rank
from trustframe.operators.storage import settle, settle_small
from trustframe.operators.transforming import class_sizes


def keyed(df: DataFrame, *parts: Column | str | int, row_id: str = "row_id") -> DataFrame:
    """Adds ``order_key``: md5 of the parts and the row id."""
    return df.withColumn("order_key", key_md5(*parts, F.col(row_id)))


def capped_sample(df: DataFrame, label: str = "label", limit: int = 10_000, seed: int = 1410) -> DataFrame:
    """At most ``limit`` rows per class, a uniform draw without replacement above it."""
    rows = keyed(df.where(F.col(label).isNotNull()), seed)

    def quota(totals: DataFrame) -> DataFrame:
        return totals.withColumn("target", F.least(F.col("n"), F.lit(limit)))

    return first_rows(rows, [label], quota).drop("order_key")


def analyzed_samples(df: DataFrame, label: str = "label", limit: int = 10_000) -> DataFrame:
    """Class sizes after the cap, from the counts alone."""
    return (
        df.where(F.col(label).isNotNull())
        .groupBy(label)
        .agg(F.least(F.count(F.lit(1)), F.lit(limit)).alias("n"))
    )


def rare_class_filter(df: DataFrame, label: str = "label", min_rows: int = 10) -> DataFrame:
    """Keeps classes with strictly more than ``min_rows`` rows."""
    kept = class_sizes(df.where(F.col(label).isNotNull()), [label]).where(F.col("n_class") > min_rows)
    return df.join(kept.select(label), label, "left_semi")


def rare_class_count(df: DataFrame, label: str = "label", min_rows: int = 10) -> DataFrame:
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count_if(F.col("n") <= min_rows).alias("filtered_classes"))


def replicate(df: DataFrame, reps: Sequence[int], out: str = "rep") -> DataFrame:
    """One copy of each row per replicate number."""
    return df.withColumn(out, F.explode(F.array(*[F.lit(r) for r in reps])))


def stratified_split(
    rows: DataFrame,
    fraction: Column | float,
    keys: Sequence[str] = ("rep",),
    y: str = "y",
    seed: int = 1410,
) -> DataFrame:
    """Adds ``is_train``: per (keys, class) half-even(fraction * n) rows, at least one.

    ``fraction`` may depend on the key columns, so several train fractions can be
    evaluated as replicates of one job.
    """
    fraction = fraction if isinstance(fraction, Column) else F.lit(float(fraction))
    keyed_rows = keyed(rows, seed, *[F.col(k) for k in keys])

    def quota(totals: DataFrame) -> DataFrame:
        return totals.withColumn("target", F.greatest(F.lit(1), half_even(fraction * F.col("n"))))

    return first_rows(keyed_rows, [*keys, y], quota, flag="is_train").drop("order_key")


def stratified_kfold(
    rows: DataFrame, k: int, y: str = "y", keys: Sequence[str] = (), seed: int = 1410
) -> DataFrame:
    """Adds ``fold``: contiguous blocks of the seeded order inside each class."""
    return even_blocks(keyed(rows, seed, *[F.col(c) for c in keys]), [*keys, y], k).drop("order_key")


def kfold(rows: DataFrame, k: int, seed: int = 1410) -> DataFrame:
    """Adds ``fold``: plain shuffled folds whose sizes differ by at most one."""
    whole = keyed(rows, seed).withColumn("_all", F.lit(0))
    return even_blocks(whole, ["_all"], k).drop("order_key", "_all")


def repeated_kfold(rows: DataFrame, k: int, repeats: int, y: str = "y", seed: int = 1410) -> DataFrame:
    """Stratified folds under a fresh order for every repeat."""
    return stratified_kfold(replicate(rows, range(repeats)), k, y, ["rep"], seed)


def _draws(ranked: DataFrame, groups: Sequence[str], per_row: Column, draw: Column) -> DataFrame:
    """Weights of a draw with replacement: how often each (groups, rank) was hit.

    Few slots hit the same row, so they are dealt by (groups, rank) before they are counted, which is also how the rows meet them.
    """
    return (
        ranked.select(*groups, F.explode(per_row).alias("member"), "rank", "n_class")
        .withColumn("rank", draw).drop("n_class")
        .repartition(*groups, "rank")
        .groupBy("member", *groups, "rank")
        .agg(F.count(F.lit(1)).cast("double").alias("w"))
    )


def bootstrap(
    rows: DataFrame, members: int, groups: Sequence[str] = (), seed: int = 1410
) -> DataFrame:
    """Draws n of n rows with replacement per member (per group, if given).

    Returns (member, row columns, w) with w = number of times drawn; rows never drawn
    are absent. The slot of (member, rank) picks a uniform rank; rows and slots meet
    in an equi-join on the rank, which is unique, so no key is hot.
    """
    groups = list(groups) or ["_all"]
    base = rows.withColumn("_all", F.lit(0)) if groups == ["_all"] else rows
    ranked = hash_rank(keyed(base, seed), groups).drop("order_key")
    ranked = settle(ranked.join(class_sizes(base, groups), groups), "ranked")
    draw = (
        hash_below(F.col("n_class"), seed, "slot", F.col("member"), *[F.col(g) for g in groups], F.col("rank")) + 1
    ).cast("bigint")
    hits = _draws(ranked, groups, F.sequence(F.lit(0), F.lit(members - 1)), draw)
    return ranked.join(hits, [*groups, "rank"]).drop("rank", "n_class", "_all")


def stratified_bootstrap(rows: DataFrame, members: int, y: str = "y", seed: int = 1410) -> DataFrame:
    """Bootstrap inside every class, so class sizes are kept exactly."""
    return bootstrap(rows, members, [y], seed)


def undersample(rows: DataFrame, y: str = "y", seed: int = 1410) -> DataFrame:
    """Every class cut to the size of the smallest."""
    def quota(totals: DataFrame) -> DataFrame:
        return totals.withColumn("target", F.min("n").over(Window.partitionBy(F.lit(1))))

    return first_rows(keyed(rows, seed, "under"), [y], quota).drop("order_key")


def oversample(rows: DataFrame, y: str = "y", seed: int = 1410) -> DataFrame:
    """Every class raised to the size of the largest: all rows plus draws with replacement.

    Returns the rows with ``w`` = number of copies. The deficit of a class is drawn by
    its own ranked rows (row r draws its share of the deficit), so no list of slots
    is built on one task.
    """
    every = Window.partitionBy(F.lit(1))
    sizes = settle_small(
        class_sizes(rows, [y]).withColumn("deficit", F.max("n_class").over(every) - F.col("n_class")), "deficit"
    )
    ranked = settle(
        hash_rank(keyed(rows, seed, "over"), [y]).drop("order_key").join(sizes, y), "ranked"
    )
    share = F.floor(F.col("deficit") / F.col("n_class")) + F.when(
        F.col("rank") <= F.col("deficit") % F.col("n_class"), 1
    ).otherwise(0)
    slots = ranked.where(share > 0).select(
        y, "rank", "n_class", F.explode(F.sequence(F.lit(1).cast("bigint"), share)).alias("turn")
    )
    draw = (hash_below(F.col("n_class"), seed, "slot", F.col(y), F.col("rank"), F.col("turn")) + 1).cast("bigint")
    hits = slots.select(y, draw.alias("rank")).groupBy(y, "rank").agg(F.count(F.lit(1)).alias("hits"))
    return (
        ranked.join(hits, [y, "rank"], "left")
        .withColumn("w", (F.lit(1) + F.coalesce("hits", F.lit(0))).cast("double"))
        .drop("rank", "n_class", "deficit", "hits")
    )


def undersampled_folds(rows: DataFrame, y: str = "y", seed: int = 1410) -> DataFrame:
    """Two-class data as k balanced parts: all minority rows with one k-th of the majority.

    k = max(2, half-even(majority / minority)). Adds ``member``.
    """
    majority, minority, k = majority_split(rows, y)
    blocks = even_blocks(keyed(rows.where(F.col(y) == majority), seed, "split"), [y], k, out="member")
    rest = rows.where(F.col(y) == minority).withColumn(
        "member", F.explode(F.array(*[F.lit(i) for i in range(k)]))
    )
    return blocks.drop("order_key").unionByName(rest)


def majority_split(rows: DataFrame, y: str = "y") -> tuple[object, object, int]:
    """(majority, minority, k) of a two-class table; ties make the larger code the majority."""
    sizes = rows.groupBy(y).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc(y)).limit(3).collect()
    if len(sizes) != 2:
        raise ValueError("undersampled folds need exactly two classes")
    return sizes[0][y], sizes[1][y], max(2, round(sizes[0]["n"] / sizes[1]["n"]))
