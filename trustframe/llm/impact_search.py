"""Exact top-k inner products by an impact-ordered index, score at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of an index shard and queries of a block: what one task holds.
SHARD, QUERIES = 16384, 1024
#: Falling shares of the query's largest impact; between two of them segments are processed before the proof is tried.
STEPS = (0.35, 0.15, 0.06, 0.02, 0.0)


def quantised(vector: Column) -> Column:
    """floor(256 * x) of each component; null if the vector is null or empty or a component is null or not finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    fine = F.size(vector) > 0
    fine &= F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(wide, lambda x: F.floor(x * 256)))


class ImpactIndex:
    """Per dimension, the rows in ascending order of their value: a posting segment is a run of one value.

    A segment's impact for a query is weight * value, so its segments of falling impact are read from the upper end for
    a positive weight and from the lower end for a negative one.
    """

    def __init__(self, values: np.ndarray, names: np.ndarray):
        self.values, self.names = values.astype(np.float64), names  # sums of integers, exact in double
        self.rows = np.ascontiguousarray(np.argsort(values, axis=0, kind="stable").T)
        self.sorted = np.ascontiguousarray(np.take_along_axis(self.values, self.rows.T, 0).T)

    def search(self, query: np.ndarray, k: int, own: int | None = None) -> tuple[list[tuple[int, int]], int]:
        """The k best (name, score), ties to the smaller name, and the postings processed.

        The accumulator of a row holds the positive impacts processed so far. What is unprocessed adds at most the sum over
        dimensions of the next impact there. Rows whose bound stays below the k-th best exact score seen are out: once few are left, or
        no positive impact is, all rows that are not out are rescored exactly.
        """
        n, q = len(self.names), query.astype(np.float64)
        skip = self.names == own
        allowed = n - int(skip.sum())
        k = min(k, allowed)
        if not k:
            return [], 0
        dims = np.flatnonzero(q)
        top = np.where(q > 0, self.sorted[:, -1], self.sorted[:, 0]) * q
        bound, most = np.maximum(top, 0), max(top.max(), 0)
        total = np.zeros(n)
        total[skip] = -np.inf
        at = np.where(q > 0, n, 0)  # positive weights: postings from at on are done; negative: those before at
        done, floor = 0, -np.inf
        for step in STEPS:
            cut = most * step
            rows, gains = [], []
            for d in dims:
                if bound[d] <= cut:
                    continue
                v, w = self.sorted[d], q[d]
                if w > 0:
                    to = int(np.searchsorted(v, cut / w, "right"))
                    part = slice(to, at[d])
                    bound[d] = max(v[to - 1] * w, 0) if to else 0
                else:
                    to = int(np.searchsorted(v, cut / w, "left"))
                    part = slice(at[d], to)
                    bound[d] = max(v[to] * w, 0) if to < n else 0
                at[d] = to
                rows.append(self.rows[d, part])
                gains.append(v[part] * w)
            if rows:
                picked = np.concatenate(rows)
                done += len(picked)
                total += np.bincount(picked, weights=np.concatenate(gains), minlength=n)
            # exact scores of the leading rows give the floor of the proof
            lead = np.argpartition(-total, min(4 * k, n - 1))[:4 * k]
            lead = lead[~skip[lead]]
            exact = self.values[lead] @ q
            if len(exact) >= k:
                floor = max(floor, np.partition(exact, len(exact) - k)[len(exact) - k])
            open_rows = np.flatnonzero(total + bound.sum() >= floor)
            if len(open_rows) <= 8 * k or step == 0:
                break
        open_rows = open_rows[~skip[open_rows]]
        scores = self.values[open_rows] @ q
        best = np.lexsort((self.names[open_rows], -scores))[:k]
        return [(int(self.names[open_rows[i]]), int(scores[i])) for i in best], done


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query with all other rows.

    Both inputs are (vec_id, vector of integers, with null for rows that take no part). Only vectors of one length meet. A
    query's own row is the one of its vec_id; of repeated vec_ids each row counts. Ties go to the smaller vec_id. Vectors are dealt into
    shards and queries into blocks by hash; each pair of shard and block is one bounded piece of work. Sums must stay below 2**53.
    """
    rows = vectors.where("vec_id IS NOT NULL AND vector IS NOT NULL").select("vec_id", "vector", F.size("vector").alias("dim"))
    asked = queries.where("vec_id IS NOT NULL AND vector IS NOT NULL").select("vec_id", "vector", F.size("vector").alias("dim"))
    shards, blocks = -(-rows.count() // shard) or 1, -(-asked.count() // block) or 1
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("shard", part(shards)).withColumn("block", every(blocks))
    right = asked.withColumn("block", part(blocks)).withColumn("shard", every(shards))

    def search(base: pa.Table, wanted: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if base.num_rows and wanted.num_rows:
            matrix = lambda t: np.asarray(t.column("vector").combine_chunks().flatten().to_numpy(), np.int64).reshape(t.num_rows, -1)
            index = ImpactIndex(matrix(base), base.column("vec_id").to_numpy())
            for own, q in zip(wanted.column("vec_id").to_pylist(), matrix(wanted)):
                found += [(own, name, score) for name, score in index.search(q, k, own)[0]]
        columns = list(zip(*found)) or [[], [], []]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("query_id", "vec_id", "score"), columns)})

    keys = ["dim", "shard", "block"]
    local = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
