"""Exact k nearest neighbours by pivot cells (after Lu et al., VLDB 2012).

Equal vectors are one point: a base point holds its k smallest row ids, and equal queries are answered once. Base
points belong to the cell of their nearest pivot. The pivot distances bound how far
the k-th neighbour of a query can be; by the triangle inequality only cells whose
nearest possible point lies within that bound are visited. Cells hold about ``block`` points (more, if that took over ``MAX_PIVOTS``
pivots); cells and the queries of a cell are cut into shards of bounded size, so every
task compares two bounded blocks and returns at most k rows per query, however dense
a cell is. Results are exact for every Minkowski exponent; below 1 the sum of powers
takes the place of the distance, which keeps the inequality.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustframe.functions.hashing import hash_int
from trustframe.operators.storage import settle

MAX_PIVOTS = 4096
#: Points and numbers that one side of a comparison holds at most, and points below which more tasks do not pay; what is compared at a time.
SIDE_ROWS, SIDE_VALUES, FEW_ROWS = 16_384, 1 << 20, 2048
TILE_ROWS, TILE_COLUMNS = 64, 1024


def _sums(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    """Pairwise sums of powers of the differences."""
    total = np.zeros((len(a), len(b)), a.dtype)
    part = np.empty_like(total)
    for x, y in zip(a.T, b.T):
        np.subtract.outer(x, y, out=part)
        if p == 2:
            part *= part
        else:
            np.abs(part, out=part)
            if p == 0.5:
                np.sqrt(part, out=part)
            elif p != 1:
                np.power(part, p, out=part)
        total += part
    return total


def _metric(sums: np.ndarray, p: float) -> np.ndarray:
    """Minkowski for p >= 1, sum of powers below."""
    return sums if p <= 1 else (np.sqrt(sums) if p == 2 else sums ** (1.0 / p))


def _tiles(n: int, step: int) -> Iterator[slice]:
    return (slice(i, i + step) for i in range(0, n, step))


def _rough(a: np.ndarray, b: np.ndarray, p: float) -> tuple[np.ndarray, float, float]:
    """Sums of powers for p = 2 or p <= 1, and by how much they may be off: in all, and as a share of themselves.

    A matrix product for p = 2, single precision else (the p-th powers of u and v differ by at most that of u - v).
    """
    middle, dim = b.mean(axis=0), a.shape[1]
    a, b = a - middle, b - middle
    if p == 2:
        own, other = (a * a).sum(axis=1), (b * b).sum(axis=1)
        eps = np.finfo(np.float64).eps
        return own[:, None] + other[None, :] - 2.0 * (a @ b.T), 8 * (dim + 8) * eps * (own.max() + other.max()), 0.0
    eps = np.finfo(np.float32).eps
    widest = max(np.abs(a).max(), np.abs(b).max())
    return _sums(a.astype(np.float32), b.astype(np.float32), p), dim * (4 * eps * widest) ** p, 4 * (dim + 8) * eps


def closest(xs: np.ndarray, ys: np.ndarray, k: int, p: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number in xs, number in ys, distance) of the k nearest ys of every x, nearest first; ties go to the first of ys."""
    k, filtered = min(k, len(ys)), (p == 2 or p <= 1) and xs.shape[1] > 8
    found = []
    for s in _tiles(len(xs), TILE_ROWS):
        a = xs[s]
        q, r, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        limit = np.full(len(a), np.inf)  # sum of powers of the k-th so far
        for t in _tiles(len(ys), TILE_COLUMNS):
            b = ys[t]
            sums, off, share = _rough(a, b, p) if filtered else (_sums(a, b, p), 0.0, 0.0)
            if not t.start and len(b) > k:
                limit = np.partition(sums, k - 1, axis=1)[:, k - 1].astype(float) * (1 + share) + off
            i, j = np.nonzero(sums <= ((limit + off) * (1 + share + 1e-13))[:, None])
            if not len(i):
                continue
            if filtered:
                exact = np.concatenate([(np.abs(a[i[c]] - b[j[c]]) ** p).sum(axis=1) for c in _tiles(len(i), TILE_COLUMNS * 16)])
            else:
                exact = sums[i, j]
            q, r, d = np.concatenate([q, i]), np.concatenate([r, j + t.start]), np.concatenate([d, _metric(exact, p)])
            order = np.lexsort((r, d, q))
            q, r, d = q[order], r[order], d[order]
            first = np.searchsorted(q, np.arange(len(a)))
            kept = np.arange(len(q)) - first[q] < k
            q, r, d = q[kept], r[kept], d[kept]
            last = np.searchsorted(q, np.arange(len(a)), "right") - 1
            full = np.bincount(q, minlength=len(a)) == k
            limit = np.where(full, d[last] ** max(p, 1.0), np.inf)
        found.append((q + s.start, r, d))
    return tuple(np.concatenate(part) for part in zip(*found))


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


def nearest(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    p: float = 2.0,
    block: int | None = None,
    query_id: str = "query_id",
    row_id: str = "row_id",
) -> DataFrame:
    """(query_id, rank 1..k, row_id, distance); ties in distance go to the smaller row id.

    ``block`` is the wanted number of points in a cell; as many as one side of a comparison holds by default.
    """
    spark = base.sparkSession
    id_type, q_type = base.schema[row_id].dataType, queries.schema[query_id].dataType
    x_type = T.ArrayType(T.DoubleType())
    copies = Window.partitionBy("x").orderBy(row_id)
    points = settle(
        base.select(row_id, F.col("x").cast(x_type).alias("x")).withColumn("rn", F.row_number().over(copies)).where(F.col("rn") <= k)
        .groupBy("x").agg(F.sort_array(F.collect_list(row_id)).alias("ids")), "points",
    )
    asked_x = queries.select(query_id, F.col("x").cast(x_type).alias("x"))
    asks = settle(asked_x.groupBy("x").agg(F.min(query_id).alias("ask")), "asks")
    n, n_asks = points.count(), asks.count()
    if not n or not n_asks:
        return asks.limit(0).select(
            F.col("ask").alias(query_id), F.lit(0).alias("rank"), F.lit(None).cast(id_type).alias(row_id), F.lit(0.0).alias("distance")
        )
    dim = len(points.first()["x"])
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    even = math.isqrt(n * n_asks // (4 * tasks))  # four comparisons a task if no cell can be passed over
    side = max(1, min(max(even, FEW_ROWS), SIDE_ROWS, SIDE_VALUES // max(1, dim)))
    pivot_count = min(MAX_PIVOTS, max(1, math.ceil(n / (block or side))))
    chosen = points.select("x", F.get("ids", F.lit(0)).alias("i")).orderBy(hash_int("pivot", F.col("i")), "i").limit(pivot_count)
    pivots = np.array([r["x"] for r in chosen.collect()], dtype=float)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            xs = np.array(batch["x"].tolist(), dtype=float).reshape(len(batch), -1)
            cell, radius = np.empty(len(batch), dtype=np.int32), np.empty(len(batch))
            for s in _tiles(len(batch), TILE_ROWS):
                d = _metric(_sums(xs[s], pivots, p), p)
                cell[s] = d.argmin(axis=1)
                radius[s] = d.min(axis=1)
            yield batch.assign(cell=cell, radius=radius)

    member_schema = T.StructType(
        [*points.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("radius", T.DoubleType())]
    )
    members = settle(points.mapInPandas(assign, member_schema), "cells")
    near = (
        members.select("cell", "radius")
        .withColumn("rn", F.row_number().over(Window.partitionBy("cell").orderBy("radius")))
        .where(F.col("rn") <= k)
        .groupBy("cell")
        .agg(F.sort_array(F.collect_list("radius")).alias("small"))
    )
    sizes = members.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("radius").alias("far"))
    cells = sizes.join(near, "cell").orderBy("cell").collect()  # at most MAX_PIVOTS rows
    ids = np.array([c["cell"] for c in cells])
    far = np.array([c["far"] for c in cells])
    small = np.full((len(cells), k), np.inf)
    for i, c in enumerate(cells):
        small[i, :len(c["small"])] = c["small"]
    around = min(len(cells), max(8, k))  # a cell holds at least one point, so these hold k

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            xs = np.array(batch["x"].tolist(), dtype=float).reshape(len(batch), -1)
            for s in _tiles(len(batch), TILE_ROWS):
                d = _metric(_sums(xs[s], pivots[ids], p), p)
                close = np.argpartition(d, around - 1, axis=1)[:, :around]
                reach = (np.take_along_axis(d, close, axis=1)[:, :, None] + small[close]).reshape(len(d), -1)
                bound = np.partition(reach, k - 1, axis=1)[:, k - 1]
                keep = d - far[None, :] <= bound[:, None] * (1 + 1e-9) + 1e-12
                q, c = np.nonzero(keep)
                part = batch.iloc[s]
                yield pd.DataFrame({"ask": part["ask"].to_numpy()[q], "x": part["x"].to_numpy()[q], "cell": ids[c]})

    visit_schema = T.StructType(
        [T.StructField("ask", q_type), T.StructField("x", x_type), T.StructField("cell", T.IntegerType())]
    )
    visits = settle(asks.select("ask", "x").mapInPandas(visit, visit_schema), "visits")
    held = {c["cell"]: c["rows"] for c in cells}
    load = [(r["cell"], max(1, math.ceil(r["count"] / side)), max(1, math.ceil(held[r["cell"]] / side))) for r in visits.groupBy("cell").count().collect()]
    cuts = spark.createDataFrame(load, "cell int, parts int, shards int")  # at most MAX_PIVOTS rows
    stored = (
        members.join(cuts, "cell")
        .withColumn("shard", F.pmod(hash_int("shard", F.get("ids", F.lit(0))), F.col("shards")).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("cell", "shard", "part", "x", "ids")
    )
    asked = (
        visits.join(cuts, "cell")
        .withColumn("part", F.pmod(hash_int("part", F.col("ask")), F.col("parts")).cast("int"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        .select("cell", "shard", "part", "x", "ask")
    )
    pair_schema = T.StructType(
        [T.StructField("ask", q_type), T.StructField(row_id, id_type), T.StructField("distance", T.DoubleType())]
    )

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"ask": left["ask"].slice(0, 0), row_id: pc.list_flatten(right["ids"]).slice(0, 0), "distance": pa.array([], pa.float64())})
        right = right.append_column("i", pc.list_element(right["ids"], 0)).sort_by("i")  # ties go to the smaller id
        q, r, d = closest(_vectors(left["x"]), _vectors(right["x"]), k, p)
        lists = right["ids"].combine_chunks()
        flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        place = np.empty(len(flat), np.int64)
        place[pc.sort_indices(flat).to_numpy()] = np.arange(len(flat))
        times = sizes[r]
        inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        at = np.repeat((np.cumsum(sizes) - sizes)[r], times) + inside
        q, d = np.repeat(q, times), np.repeat(d, times)
        order = np.lexsort((place[at], d, q))
        q, d, at = q[order], d[order], at[order]
        kept = np.arange(len(q)) - np.searchsorted(q, q) < k
        return pa.table({
            "ask": left["ask"].combine_chunks().take(pa.array(q[kept])), row_id: flat.take(pa.array(at[kept])), "distance": pa.array(d[kept]),
        })

    key = ["cell", "shard", "part"]
    # the number of tasks is given: few bytes may hold much work
    found = asked.repartition(tasks, *key).groupBy(*key).cogroup(stored.repartition(tasks, *key).groupBy(*key)).applyInArrow(compare, pair_schema)
    order = Window.partitionBy("ask").orderBy("distance", row_id)
    distance = F.pow("distance", 1.0 / p) if p < 1 else F.col("distance")
    hit = F.struct("rank", row_id, distance.alias("distance"))
    answers = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).groupBy("ask").agg(F.collect_list(hit).alias("hits"))
    answered = settle(asks.join(answers, "ask").select("x", "hits"), "answers")
    return asked_x.join(answered, "x").select(query_id, F.inline("hits"))


def knn_classify(
    queries: DataFrame, base: DataFrame, k: int = 5, p: float = 2.0, query_id: str = "query_id"
) -> DataFrame:
    """Majority class of the k nearest base rows (row_id, x, y); ties go to the lowest class."""
    hits = nearest(queries, base, k, p, query_id=query_id).join(base.select("row_id", "y"), "row_id")
    votes = hits.groupBy(query_id, "y").agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy(query_id).agg(
        F.max_by("y", F.struct("votes", -F.col("y"))).alias("y_pred"),
        (F.max("votes") / float(k)).alias("support"),
    )
