"""Mixing sources to target weights, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustframe.operators.storage import settle

#: Weights of the sources in code-point order, repeating, and the two limits.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, LIMIT = 1.5, 2.0


def word_count(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in the text; null has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(source, source_size) to (source, source_size, target, rate); one row per source in and out.

    The targets share ``share`` times all sizes by weight; none exceeds ``limit`` times its source's size. What is
    cut off goes to the others by weight, which is the level L with sum(min(limit * size, L * weight)) equal to the
    whole: sources in ascending order of limit * size / weight are capped as long as the level of the rest is no lower.
    A source without words has target and rate 0; null is a source of its own, after the others.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights)))
    picked = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    rows = sizes.withColumn("weight", picked).withColumn("most", F.col("source_size") * F.lit(float(limit)))
    upward = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = upward.rowsBetween(Window.unboundedPreceding, -1)
    later = upward.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("most").over(earlier), F.lit(0.0))) / F.sum("weight").over(later)
    rows = rows.withColumn("level", level)
    # the level rises while sources are capped and falls after the first that is not, so that one has the largest
    rows = rows.withColumn("final", F.max(F.when(F.col("level") * F.col("weight") < F.col("most"), F.col("level"))).over(every))
    target = F.least(F.col("most"), F.coalesce(F.col("final") * F.col("weight"), F.col("most")))
    rows = rows.withColumn("target", target.cast("double"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return rows.select("source", "source_size", "target", rate.alias("rate"))


def mix_counts(docs: DataFrame, seed: str = "mix", weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """Adds size, source_size, target and copies to (doc_id, text, source).

    ``copies`` is floor(rate) plus one with probability equal to the fraction, drawn from md5(seed | doc_id), so
    reruns and repeated tasks agree; rows of one doc_id share their draw. Null doc_id draws as "null".
    An empty table gives an empty result. Sizes are added up map-side, one row per source and task is
    shuffled; the written table of sources is joined back by source, so Spark knows its size and broadcasts it while small.
    """
    sized = docs.withColumn("size", word_count(F.col("text")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = settle(source_targets(sizes, weights, share, limit).withColumnRenamed("source", "_source"), "targets")
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    drawn = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    unit = F.conv(F.substring(drawn, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    whole = F.floor("rate")
    copies = whole + F.when(unit < F.col("rate") - whole, 1).otherwise(0)
    return joined.withColumn("copies", copies.cast("int")).drop("rate")


def mix_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mixed corpus: each document as often as ``mix_counts`` says, with its own columns."""
    own = [F.col(f"_row.{c}").alias(c) for c in docs.columns]
    counted = mix_counts(docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_row")), seed)
    return counted.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("_copy")).select(*own)
