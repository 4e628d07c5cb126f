"""Trees, forests and boosting for all replicates at once.

Trees and forests grow to pure leaves (``growth``). Boosting grows histogram trees, all rounds in one task where the rows
of a key fit it (``boosted``). Else a level of them is one job: rows find their node, explode their binned features, and are
combined map-side into (key, node, feature, bin) sums. What is shuffled is the
histogram, whose size does not depend on the number of rows. The chosen splits are a
small table, fixed after every level.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustframe.functions.arrays import let
from trustframe.functions.hashing import key_md5
from trustframe.learners.base import Fields, Learner, softmax, weight
from trustframe.learners.growth import NAMES, SMALL_FOREST, TASK_CELLS, forest_shares, grow_trees, leaf_counts, ordered, piece_shares
from trustframe.operators.storage import settle, settle_small, with_row

Score = Callable[[list[Column]], Column]


def _least_digits(share: float) -> str:
    """The smallest 15 hex digits that are at least ``share`` as a double in [0, 1)."""
    low, high = 0, 1 << 60
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if float(middle) / float(1 << 60) >= share else (middle + 1, high)
    return f"{low:015x}"


#: Cumulative Poisson(1) probabilities (fixed values), as ``hash_unit`` compares them: digits of one length have the order of their numbers.
POISSON_DIGITS = [_least_digits(s) for s in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)]


def bin_edges(rows: DataFrame, dim: int, bins: int, groups: Sequence[str] = ()) -> DataFrame:
    """One row per group: ascending distinct approximate quantiles of every feature.

    Groups whose ``x`` holds other features or another dataset need edges of their own.
    """
    cuts = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    return settle_small(
        rows.groupBy(*groups).agg(
            F.array(
                *[F.array_distinct(F.percentile_approx(F.get("x", F.lit(i)), cuts, 2000)) for i in range(dim)]
            ).alias("edges")
        ),
        "edges",
    )


def add_bins(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds ``b``: per feature the number of edges below the value."""
    binned = F.zip_with("x", "edges", lambda v, e: F.size(F.filter(e, lambda t: t < v)))
    groups = _edge_groups(edges)
    carried = rows.join(edges, groups) if groups else with_row(rows, edges)
    return carried.withColumn("b", binned).drop("edges")


def _edge_groups(edges: DataFrame) -> list[str]:
    return [c for c in edges.columns if c != "edges"]


def prepared(rows: DataFrame, learners: Iterable[Learner], dim: int, groups: Sequence[str] = ()) -> DataFrame:
    """Bins the rows once, before they are copied per replicate, if a learner needs bins.

    ``groups`` tell rows apart whose features differ; each group has its own edges.

    The binned rows are settled: a computed ``b`` would be computed again at every step
    down a tree.
    """
    trees = [m for m in learners if m.needs_bins]
    if not trees or "b" in rows.columns:
        return rows
    edges = bin_edges(rows, dim, max(m.bins for m in trees), groups)
    for m in trees:
        m.edges = edges
    return settle(add_bins(rows, edges), "binned")


def _descend(splits: Column, depth: int, beyond: Callable[[Column], Column]) -> Column:
    """Heap number of the node a row ends in."""
    def step(node: Column, _: Column) -> Column:
        def child(split: Column) -> Column:
            lower = 2 * node + F.when(beyond(split), 1).otherwise(0)
            return F.when(split.isNull(), node).otherwise(lower).cast("int")

        return let(F.try_element_at(splits, node), child)

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), step)


def grow(
    rows: DataFrame,
    groups: Sequence[str],
    stats: Sequence[str],
    score: Score,
    depth: int,
) -> DataFrame:
    """Splits of one tree per group: (groups, node, f, t, left, right, total).

    ``rows`` has the groups, ``b`` and the statistics columns; a split sends
    ``b[f] > t`` right and maximises score(left) + score(right) over score(total).
    """
    groups = list(groups)
    nodes: DataFrame | None = None
    for level in range(depth):
        if nodes is None:
            placed = rows.withColumn("node", F.lit(1))
        else:
            maps = _split_maps(nodes, groups)
            at = _descend(F.col("splits"), level, lambda s: F.get("b", s["f"]) > s["t"])
            placed = rows.join(maps, groups).withColumn("node", at).where(F.col("node") >= 2**level)
        cells = (
            placed.select(*groups, "node", *stats, F.posexplode("b").alias("f", "bin"))
            .groupBy(*groups, "node", "f", "bin")
            .agg(*[F.sum(s).alias(s) for s in stats])
        )
        upto = Window.partitionBy(*groups, "node", "f").orderBy("bin")
        whole = Window.partitionBy(*groups, "node", "f")
        sums = cells.select(
            *groups, "node", "f", "bin",
            *[F.sum(s).over(upto).alias(f"l_{s}") for s in stats],
            *[F.sum(s).over(whole).alias(f"t_{s}") for s in stats],
        )
        left = [F.col(f"l_{s}") for s in stats]
        every = [F.col(f"t_{s}") for s in stats]
        right = [t - a for t, a in zip(every, left)]
        gain = score(left) + score(right) - score(every)
        best = (
            sums.withColumn("gain", gain)
            .where(F.col("gain") > 1e-9)
            .groupBy(*groups, "node")
            .agg(
                F.max_by(
                    F.struct("f", F.col("bin").alias("t"), F.array(*left).alias("left"),
                             F.array(*right).alias("right"), F.array(*every).alias("total")),
                    F.struct("gain", -F.col("f"), -F.col("bin")),
                ).alias("s")
            )
            .select(*groups, "node", "s.*")
        )
        found = settle_small(best, "splits")
        if found.isEmpty():
            break
        nodes = found if nodes is None else nodes.unionByName(found)
    return nodes if nodes is not None else found


def _split_maps(nodes: DataFrame, groups: Sequence[str]) -> DataFrame:
    return nodes.groupBy(*groups).agg(
        F.map_from_entries(F.collect_list(F.struct("node", F.struct("f", "t")))).alias("splits")
    )


def tree_models(nodes: DataFrame, edges: DataFrame, groups: Sequence[str], leaf: Callable[[Column], Column]) -> DataFrame:
    """(groups, splits: node -> (f, threshold), values: node -> leaf value)."""
    apart = _edge_groups(edges)
    if apart:
        nodes = nodes.join(edges, apart)
    threshold = F.get(F.get(F.col("edges") if apart else edges.scalar(), F.col("f")), F.col("t"))
    values = F.array(
        F.struct((2 * F.col("node")).alias("k"), leaf(F.col("left")).alias("v")),
        F.struct((2 * F.col("node") + 1).alias("k"), leaf(F.col("right")).alias("v")),
    )
    root = F.array(F.struct(F.lit(1).alias("k"), leaf(F.col("total")).alias("v")))
    return (
        nodes.withColumn("split", F.struct("node", F.struct("f", threshold.alias("thr"))))
        .withColumn("vals", F.when(F.col("node") == 1, F.concat(root, values)).otherwise(values))
        .groupBy(*groups)
        .agg(
            F.map_from_entries(F.collect_list("split")).alias("splits"),
            F.map_from_entries(F.flatten(F.collect_list("vals"))).alias("leaves"),
        )
    )


def leaf_value(tree: Column, x: Column, depth: int) -> Column:
    node = _descend(tree["splits"], depth, lambda s: F.get(x, s["f"]) > s["thr"])
    return F.try_element_at(tree["leaves"], node)


def _share(counts: Column) -> Column:
    def shares(values: Column) -> Column:
        return let(
            F.aggregate(values, F.lit(0.0), lambda a, v: a + v),
            lambda total: F.transform(values, lambda v: F.coalesce(F.try_divide(v, total), F.lit(0.0))),
        )

    return let(counts, shares)


class DecisionTree(Learner):
    """Gini tree to pure leaves (``growth``); with ``trees`` > 1 a forest of Poisson-weighted trees.

    ``depth`` and ``min_rows`` stop it earlier. Missing values go left at every split, NaN goes right.
    """

    trees = 1

    def __init__(self, depth: int | None = None, min_rows: int = 2, task_cells: int = TASK_CELLS, seed: int = 1410):
        self.depth, self.min_rows, self.task_cells, self.seed = depth, min_rows, task_cells, seed

    def _weights(self, train: DataFrame, keys: Sequence[str]) -> list[Column]:
        """A row's weight in every tree."""
        return [weight(train)]

    def _tries(self, dim: int) -> int:
        return dim

    def fit(self, train: DataFrame, keys: Sequence[str], dim: int, n_classes: int) -> DataFrame:
        keys = list(keys)
        train = train.where("y IS NOT NULL")
        seen = F.array(*[ordered(F.get("x", F.lit(i))) for i in range(dim)]).alias("x")
        rows = train.select(*keys, seen, "y", F.array(*[w.cast("double") for w in self._weights(train, keys)]).alias("ws"))
        if self.min_rows <= 2:  # rows count by their weight alone: equal ones are one, in all trees
            rows = rows.groupBy(*keys, "x", "y").agg(F.array(*[F.sum(F.get("ws", F.lit(i))) for i in range(self.trees)]).alias("ws"))
        rows = settle(rows, "points").select(*keys, "x", "y", F.posexplode("ws").alias("tree", "w")).where(F.col("w") > 0)
        trees = grow_trees(
            rows.select(*keys, "tree", "x", "y", "w"), [*keys, "tree"], n_classes, dim, self.depth, self._tries(dim),
            self.min_rows, task_cells=self.task_cells, seed=self.seed, ready=True,
        )
        prior = train.groupBy(*keys).agg(
            F.array(*[F.sum(F.when(F.col("y") == c, weight(train)).otherwise(0.0)) for c in range(n_classes)]).alias("prior")
        )
        prior = settle_small(prior, "prior")
        packed = trees.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("tree", *NAMES))).alias("forest"))
        model = prior.join(packed, keys, "left")
        # a large forest is never one row where ``supports`` finds these
        model.grown = trees.grown
        model.by_tree = trees.join(prior, keys).unionByName(prior.join(trees.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)
        return model

    def score_classes(self, x: Column, model: Fields = F.col) -> Column:
        forest, prior = model("forest"), model("prior")
        votes = let(F.transform(x, ordered), lambda v: F.transform(forest, lambda t: _share(leaf_counts(t, v))))
        start = F.transform(prior, lambda _: F.lit(0.0))
        summed = F.aggregate(votes, start, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
        scores = F.when(forest.isNull(), prior).otherwise(summed)
        return F.transform(_share(scores), lambda v, i: F.struct(i.alias("c"), v.alias("support")))

    def supports(self, test: DataFrame, model: DataFrame, keys: Sequence[str]) -> DataFrame:
        grown, trees = getattr(model, "grown", None), getattr(model, "by_tree", None)
        if trees is None:
            trees = model.select(*keys, "prior", F.explode_outer("forest").alias("_t")).select(*keys, "prior", "_t.*")
        if grown is not None and grown.large(keys):
            shares = piece_shares(test, grown, model.select(*keys, "prior"), keys, "_shares")
        else:
            shares = forest_shares(test, trees, keys, "_shares")
        each = F.transform("_shares", lambda v, i: F.struct(i.alias("c"), v.alias("support")))
        return shares.withColumn("supports", each).drop("_shares")


class RandomForest(DecisionTree):
    """Trees on Poisson(1) row weights with sqrt(d) features tried per node."""

    def __init__(
        self, trees: int = 20, depth: int | None = None, min_rows: int = 2, task_cells: int = TASK_CELLS, seed: int = 1410, balanced: bool = False
    ):
        super().__init__(depth, min_rows, task_cells, seed)
        self.trees, self.balanced = trees, balanced

    def _weights(self, train: DataFrame, keys: Sequence[str]) -> list[Column]:
        def poisson(tree: int) -> Column:
            digits = F.substring(key_md5(self.seed, tree, *[F.col(k) for k in keys], F.col("row_id")), 1, 15)
            return let(digits, lambda v: reduce(add, [(v >= s).cast("double") for s in POISSON_DIGITS]))

        return [poisson(i) * weight(train) for i in range(self.trees)]

    def _tries(self, dim: int) -> int:
        return math.ceil(math.sqrt(dim))

    def fit(self, train: DataFrame, keys: Sequence[str], dim: int, n_classes: int) -> DataFrame:
        if self.balanced:
            sizes = settle_small(train.groupBy(*keys, "y").agg(F.count(F.lit(1)).alias("_n")), "sizes")
            per_key = Window.partitionBy(*keys)
            balance = settle_small(
                sizes.select(
                    *keys, "y",
                    (F.sum("_n").over(per_key) / (F.count(F.lit(1)).over(per_key) * F.col("_n"))).alias("_bw"),
                ),
                "balance",
            )
            w = weight(train)
            train = train.join(balance, [*keys, "y"]).withColumn("w", w * F.col("_bw")).drop("_bw")
        return super().fit(train, keys, dim, n_classes)


class Boosting(Learner):
    """Softmax boosting on gradient histograms: one regression tree per class and round."""

    needs_bins = True
    edges: DataFrame | None = None

    def __init__(self, rounds: int = 10, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, bins: int = 32):
        self.rounds, self.depth, self.rate, self.ridge, self.bins = rounds, depth, rate, ridge, bins

    def _leaf(self, stats: Column) -> Column:
        return -self.rate * F.get(stats, F.lit(0)) / (F.get(stats, F.lit(1)) + self.ridge)

    def _score(self, stats: list[Column]) -> Column:
        return stats[0] * stats[0] / (stats[1] + self.ridge)

    def fit(self, train: DataFrame, keys: Sequence[str], dim: int, n_classes: int) -> DataFrame:
        keys = list(keys)
        train = prepared(train, [self], dim, keys)
        rows = train.withColumn("_w", weight(train)).select(*keys, "x", "b", "y", "_w")
        longest = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if longest * dim <= TASK_CELLS:
            nodes = settle(self._grown_whole(rows, keys, dim, n_classes), "splits")
            models = tree_models(nodes, self.edges, [*keys, "turn", "cls"], self._leaf)
            listed = F.array_sort(F.collect_list(F.struct("turn", "cls", "splits", "leaves")), lambda a, b: n_classes * (a["turn"] - b["turn"]) + a["cls"] - b["cls"])
            packed = models.groupBy(*keys).agg(F.transform(listed, lambda t: F.struct(t["cls"].alias("cls"), t["splits"].alias("splits"), t["leaves"].alias("leaves"))).alias("trees"))
        else:
            packed = self._grown_by_levels(rows, keys, n_classes)
        base = train.select(*keys).distinct()
        zero = F.array(*[F.lit(0.0)] * n_classes)
        return settle(base.join(packed, keys, "left").withColumn("zero", zero), "boost")

    def _grown_whole(self, rows: DataFrame, keys: list[str], dim: int, n_classes: int) -> DataFrame:
        """(keys, turn, cls, node, f, t, left, right, total): every split of all rounds, the rows of a key in one task."""
        pair = T.ArrayType(T.DoubleType())
        whole = [T.StructField(n, T.IntegerType()) for n in ("turn", "cls", "node", "f", "t")]
        schema = T.StructType([*[rows.schema[k] for k in keys], *whole, *[T.StructField(n, pair) for n in ("left", "right", "total")]])
        rounds, depth, rate, ridge, bins = self.rounds, self.depth, self.rate, self.ridge, self.bins

        def grow(key: tuple, table: pa.Table) -> pa.Table:
            table = table.filter(pc.is_valid(table["b"])).sort_by([("y", "ascending"), ("_w", "ascending")])
            b = table["b"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
            y = pc.fill_null(table["y"], -1).to_numpy()
            w = pc.fill_null(table["_w"].cast(pa.float64()), 0.0).to_numpy()
            found = boosted(b, y, w, n_classes, rounds, depth, rate, ridge, bins)
            named = {k: pa.array([v.as_py()] * len(found), table.schema.field(k).type) for k, v in zip(keys, key)}
            columns = list(zip(*found)) or [()] * 8
            numbers = {n: pa.array(c, pa.int32()) for n, c in zip(("turn", "cls", "node", "f", "t"), columns)}
            return pa.table(named | numbers | {n: pa.array(c, pa.list_(pa.float64())) for n, c in zip(("left", "right", "total"), columns[5:])})

        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))  # given: few bytes hold much work
        return rows.select(*keys, "b", "y", "_w").repartition(tasks, *keys).groupBy(*keys).applyInArrow(grow, schema)

    def _grown_by_levels(self, rows: DataFrame, keys: list[str], n_classes: int) -> DataFrame:
        """(keys, trees): a job per level of all trees of a round."""
        rows = settle(rows.withColumn("margin", F.array(*[F.lit(0.0)] * n_classes)), "margins")
        groups = [*keys, "cls"]
        parts: list[DataFrame] = []
        for turn in range(self.rounds):
            scores = F.transform("margin", lambda v, i: F.struct(i.alias("c"), v.alias("s")))
            graded = rows.select(*keys, "b", "y", "_w", F.explode(softmax(scores)).alias("p")).select(
                *keys,
                "b",
                F.col("p.c").alias("cls"),
                (F.col("_w") * (F.col("p.support") - (F.col("y") == F.col("p.c")).cast("double"))).alias("g"),
                (F.col("_w") * F.col("p.support") * (1 - F.col("p.support"))).alias("h"),
            )
            nodes = grow(graded, groups, ["g", "h"], self._score, self.depth)
            grown = (
                tree_models(nodes, self.edges, groups, self._leaf)
                .groupBy(*keys)
                .agg(F.collect_list(F.struct("cls", "splits", "leaves")).alias("trees"))
            )
            if nodes.isEmpty():
                break
            trees = settle(grown, "trees")
            parts.append(trees.withColumn("turn", F.lit(turn)))
            if turn + 1 < self.rounds:
                stepped = rows.join(trees, keys, "left").withColumn(
                    "margin", self._moved(F.col("margin"), F.col("trees"), F.col("x"))
                )
                rows = settle(stepped.drop("trees"), "margins")
        if not parts:  # no feature splits any class
            return grown
        every = reduce(DataFrame.unionByName, parts)
        return every.groupBy(*keys).agg(F.flatten(F.collect_list("trees")).alias("trees"))

    def _moved(self, margin: Column, trees: Column, x: Column) -> Column:
        def step(acc: Column, t: Column) -> Column:
            gain = F.coalesce(leaf_value(t, x, self.depth), F.lit(0.0))
            return F.transform(acc, lambda v, i: v + F.when(i == t["cls"], gain).otherwise(0.0))

        return F.when(trees.isNull(), margin).otherwise(F.aggregate(trees, margin, step))

    def score_classes(self, x: Column, model: Fields = F.col) -> Column:
        margin = self._moved(model("zero"), model("trees"), x)
        return softmax(F.transform(margin, lambda v, i: F.struct(i.alias("c"), v.alias("s"))))


def boosted(
    b: np.ndarray, y: np.ndarray, w: np.ndarray, n_classes: int, rounds: int, depth: int, rate: float, ridge: float, bins: int
) -> list[tuple]:
    """Splits (turn, class, node, feature, bin, left, right, total) of all trees; ``b`` has the bin of every row and feature.

    What ``grow`` finds level by level: sums are (gradient, curvature), a row without a class has no gradient.
    """
    n, dim = b.shape
    if not n:
        return []
    width = int(b.max()) + 1
    cells = np.arange(dim) * width + b
    margin, found = np.zeros((n_classes, n)), []
    for turn in range(rounds):
        raw = np.exp(margin - margin.max(axis=0))
        share = raw / sum(raw)
        before = len(found)
        for c in range(n_classes):
            grad = np.where(y < 0, 0.0, w * (share[c] - (y == c)))
            curve = w * share[c] * (1 - share[c])
            at = np.ones(n, np.int64)
            value = np.zeros(n)
            for level in range(depth):
                some = np.flatnonzero(at >= 1 << level)
                if not len(some):
                    break
                nodes, place = np.unique(at[some], return_inverse=True)
                flat = (place[:, None] * (dim * width) + cells[some]).ravel()
                shape = (len(nodes), dim, width)
                sums = [np.bincount(flat, np.repeat(v[some], dim), np.prod(shape)).reshape(shape) for v in (grad, curve)]
                held = np.bincount(flat, minlength=np.prod(shape)).reshape(shape) > 0
                g, h = (np.cumsum(v, axis=2) for v in sums)
                g_all, h_all = g[:, :, -1:], h[:, :, -1:]
                gain = g * g / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all * g_all / (h_all + ridge)
                gain = np.where(held, gain, -np.inf).reshape(len(nodes), -1)
                cut = gain.argmax(axis=1)
                splits = gain[np.arange(len(nodes)), cut] > 1e-9
                f, t = np.divmod(cut, width)
                place_of = np.arange(len(nodes))
                left = np.stack([g[place_of, f, t], h[place_of, f, t]], axis=1)
                total = np.stack([g_all[place_of, f, 0], h_all[place_of, f, 0]], axis=1)
                for i in np.flatnonzero(splits):
                    found.append((turn, c, int(nodes[i]), int(f[i]), int(t[i]), left[i].tolist(), (total[i] - left[i]).tolist(), total[i].tolist()))
                moved = np.flatnonzero(splits[place])
                rows, own = some[moved], place[moved]
                right = b[rows, f[own]] > t[own]
                at[rows] = 2 * at[rows] + right
                sides = np.where(right[:, None], total[own] - left[own], left[own])
                value[rows] = -rate * sides[:, 0] / (sides[:, 1] + ridge)
            margin[c] += value
        if len(found) == before:
            break
    return found
