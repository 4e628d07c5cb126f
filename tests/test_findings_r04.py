"""Findings of the fourth review."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustframe.functions.hashing import hash_unit, key_md5
from trustframe.learners import DecisionTree, RandomForest, growth, trees

TREES = "row_id int, x array<double>, y int, k int"


def noise(spark, n, keys=1, dim=3, classes=3):
    rng = np.random.default_rng(n)
    rows = [(i, [float(v) for v in rng.normal(size=dim).round(2)], int(rng.integers(0, classes)), i % keys) for i in range(n)]
    return spark.createDataFrame(rows, TREES)


@pytest.mark.parametrize("learner", [RandomForest(trees=3, balanced=True), RandomForest(trees=3, task_cells=240), DecisionTree(task_cells=240)])
def test_large_forests_are_scored_piece_by_piece(spark, monkeypatch, learner):
    """no tree is sent to every slice of the rows; supports are those of the joined model, also with several slices."""
    monkeypatch.setattr(growth, "SMALL_FOREST", 0)
    data = noise(spark, 300, keys=2)
    odd = [(900, [None, 1.0, float("nan")], 0, 0), (901, [0.5], 1, 1), (902, None, 2, 0), (903, [1.0, 1.0, 1.0], 0, 9)]
    test = data.unionByName(spark.createDataFrame(odd, TREES))
    model = learner.fit(data, ["k"], 3, 3)
    monkeypatch.setattr(trees, "forest_shares", None)  # not to be used
    real = growth.piece_shares
    monkeypatch.setattr(trees, "piece_shares", lambda *a: real(*a, most_rows=40))
    apart = {r["row_id"]: [s["support"] for s in r["supports"]] for r in learner.supports(test, model, ["k"]).collect()}
    monkeypatch.undo()
    packed = {r["row_id"]: [s["support"] for s in r["supports"]] for r in learner.supports(test, model.select("*"), ["k"]).collect()}
    assert apart == packed and len(apart) == 303


def test_bounds_hold_for_every_cut_inside_a_bin():
    """bins that are not looked into hold no better cut."""
    rng = np.random.default_rng(3)
    for classes in (2, 3, 10):
        w = rng.integers(1, 4, 400).astype(float)
        one = np.zeros((400, classes))
        one[np.arange(400), np.where(rng.random(400) < 0.5, 0, rng.integers(0, classes, 400))] = w
        upto = np.cumsum(one, axis=0)
        quality = growth._quality(upto, upto[-1])
        ends = np.array([0, 7, 30, 90, 91, 250, 399])
        bounds = growth._bounds(upto[ends[:-1]], upto[ends[1:]], upto[-1])
        for a, b, bound in zip(ends[:-1], ends[1:], bounds):
            assert quality[a : min(b, 398) + 1].max() <= bound + 1e-9


def test_poisson_weights_are_those_of_the_hash_as_a_number(spark):
    """comparing digits is comparing numbers."""
    shares = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)
    rows = spark.range(5000).withColumn("d", F.substring(key_md5(7, F.col("id")), 1, 15)).withColumn("u", hash_unit(7, F.col("id")))
    wrong = [((F.col("d") >= digits) != (F.col("u") >= s)) for digits, s in zip(trees.POISSON_DIGITS, shares)]
    assert rows.where(F.greatest(*[c.cast("int") for c in wrong]) > 0).count() == 0
    for digits, s in zip(trees.POISSON_DIGITS, shares):
        at = int(digits, 16)
        assert float(at) / float(1 << 60) >= s > float(at - 1) / float(1 << 60)


@pytest.mark.parametrize("weighted", [False, True])
def test_boosting_in_one_task_is_boosting_by_levels(spark, monkeypatch, weighted):
    """the rounds of a key need no jobs of their own; the same splits, also with missing features and labels."""
    from trustframe.learners import Boosting

    data = noise(spark, 150, keys=2).unionByName(spark.createDataFrame([(901, [None, 1.0, float("nan")], 1, 0), (902, [0.5, 0.1, 0.2], None, 1)], TREES))
    if weighted:
        data = data.withColumn("w", 1.0 + F.col("row_id") % 3)
    models, jobs = [], []
    real = trees.grow
    monkeypatch.setattr(trees, "grow", lambda *a: jobs.append(1) or real(*a))
    for cells in (trees.TASK_CELLS, 0):
        monkeypatch.setattr(trees, "TASK_CELLS", cells)
        learner = Boosting(rounds=3, depth=2)
        model = learner.fit(data, ["k"], 3, 3)
        found = {r["row_id"]: [s["support"] for s in r["supports"]] for r in learner.supports(data, model, ["k"]).collect()}
        models.append(found)
        assert bool(jobs) == (cells == 0)
    assert models[0].keys() == models[1].keys() and len(models[0]) == 152
    assert all(models[0][i] == pytest.approx(models[1][i], rel=1e-9) for i in models[0])


def test_association_runs_at_the_defaults(spark, monkeypatch):
    """all permutations, the whole forest, all rounds."""
    from trustframe import checks
    from trustframe.learners import Boosting
    from trustframe.plans import association

    checks.load_all()
    seen = {}

    def whole(rows, learners, dim, n_classes, **given):
        seen.update(given, **{n: vars(m) for n, m in learners.items()})
        return {"result": rows}

    monkeypatch.setattr(association, "association", whole)
    checks.QUERIES["association"](spark, "/root/testdata/sf0.001")
    default = {"DT": DecisionTree(), "RF": RandomForest(balanced=True), "XGB": Boosting()}
    assert seen == {n: vars(m) for n, m in default.items()} and seen["RF"]["trees"] == 20


def likelihood(pairs, place, width):
    """Class bigram likelihood by brute force, from the counts of all pairs."""
    one = np.zeros((len(pairs), width))
    one[np.arange(len(pairs)), place] = 1
    table = one.T @ pairs @ one

    def f(v):
        return (v * np.log(np.maximum(v, 1))).sum()

    return f(table) - f(table.sum(0)) - f(table.sum(1))


def test_every_word_is_exchanged_to_the_best_cluster():
    """one word at a time, the step finds what brute force finds, for words with and without a cluster and beside themselves."""
    from trustframe.llm import class_lm

    rng = np.random.default_rng(5)
    clusters, n = 3, 9
    width = clusters + class_lm.SHAPES + 1
    for turn in range(6):
        pairs = rng.integers(0, 30, (n + 1, n + 1)).astype(float)  # the last code is the end
        place = np.append(rng.integers(0, clusters + 2, n), width - 1)
        one = np.zeros((n + 1, width))
        one[np.arange(n + 1), place] = 1
        word = turn
        after, before = pairs @ one, pairs.T @ one
        got = class_lm.exchange_step(after[:n], before[:n], np.diag(pairs)[:n], place[:n], clusters, block=n)
        tried = [likelihood(pairs, np.where(np.arange(n + 1) == word, k, place), width) for k in range(clusters)]
        assert got[word] == int(np.argmax(tried))
        assert (got < clusters).all()


def test_all_words_of_the_table_are_clustered_by_both_sides(spark, monkeypatch):
    """words beyond the head, too, are told apart by what follows them, over all texts, and move again when others have moved."""
    from trustframe.llm import class_lm

    rng = np.random.default_rng(1)
    heads = [f"h{i}" for i in range(4)]
    texts = []
    for i in range(400):
        kind, rare = i % 2, int(rng.integers(0, 6))
        texts.append((f"{heads[0]} {'xy'[kind]}{rare} {heads[1 + kind]} {heads[0]} {heads[1 + kind]} {heads[0]} {heads[3]} {heads[0]}",))
    docs = spark.createDataFrame(texts, "text string").repartition(3)
    words = class_lm.frequent(class_lm.word_counts(docs))
    place = np.concatenate([np.zeros(4, int), np.full(len(words.names) - 4, 2 + 7)])
    after, before, own = class_lm.neighbours(docs, words, place, 2)
    split = [["END", *t.split(), "END"] for (t,) in texts]
    pairs = [(a, b) for t in split for a, b in zip(t, t[1:])]
    for w, name in enumerate(n.decode() for n in words.names):
        assert after[w].sum() == before[w].sum() == words.counts[w]
        assert after[w][-1] == sum(p == (name, "END") for p in pairs) and own[w] == sum(p == (name, name) for p in pairs)
    seen = []
    real = class_lm.neighbours
    monkeypatch.setattr(class_lm, "neighbours", lambda *a: seen.append(a[2]) or real(*a))
    label = class_lm.cluster_words(docs, words, clusters=4, head=4, passes=2)
    assert len(label) == len(words.names) == 16 and words.counts.min() > 1 and label.max() < 4
    assert [np.count_nonzero(p < 4) for p in seen] == [4, 16]  # the words that joined are exchanged again
    counts = np.array([[sum(p == (a, b) for p in pairs) for b in (*(n.decode() for n in words.names), "END")] for a in (*(n.decode() for n in words.names), "END")])
    assert likelihood(counts, np.append(label, 4), 5) > likelihood(counts, np.append(np.arange(16) % 4, 4), 5)


def test_exchange_never_loses_likelihood():
    """each move of the exchange is the best one by brute force, so no pass loses."""
    from trustframe.llm import class_lm

    rng = np.random.default_rng(8)
    pairs = rng.integers(0, 40, (11, 11)).astype(float)
    scores = []
    for passes in range(5):
        label = class_lm.exchange(pairs, 3, passes=passes, rest=1)
        scores.append(likelihood(pairs, np.append(label, 3), 4))
    assert all(b >= a - 1e-9 for a, b in zip(scores, scores[1:])) and scores[-1] > scores[0]
    best = max(likelihood(pairs, np.append(np.where(np.arange(10) == w, k, label), 3), 4) for w in range(10) for k in range(3))
    assert best <= scores[-1] + 1e-9 or scores[-1] > scores[-2]
