"""Jaccard join of documents on word n-grams, with Bayesian pruning of the candidates."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustframe.llm.common import LOWER, WORD_BYTES, component_labels, distinct_words, runs, slices, split_words, text_bytes
from trustframe.operators.storage import settle

#: Words of a shingle and least similarity of a link.
WORDS, LEAST = 5, 0.8
#: MinHash values per band and bands: a pair at the threshold shares a band with probability 0.9996.
ROWS, BANDS = 5, 20
#: A pair is dropped once the posterior probability of reaching the threshold is below this; compared so many values at a time.
TOLERANCE, STEP = 1e-4, 10
#: Members of a block: a larger group is cut into blocks, and pairs of blocks are separate work.
BLOCK = 512
_RNG = np.random.default_rng(805)
_A = (_RNG.integers(1, 1 << 31, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint64).astype(np.uint32)
_P = _RNG.integers(1, 1 << 63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M
    x = (x ^ (x >> np.uint64(29))) * _P[0]
    return x ^ (x >> np.uint64(32))


def shingle_sets(text: pa.Array) -> list[np.ndarray]:
    """The distinct 64-bit hashes of each text's shingles, sorted.

    Words are runs of letters, digits and underscores (any non-ASCII character counts as a letter), in lower case. A text of fewer than five
    words is one shingle; a text without words has none.
    """
    data, offsets = text_bytes(pc.utf8_lower(pc.fill_null(text, "")))
    words, ends, rows = split_words(LOWER[data], offsets, WORD_BYTES)
    which, names = distinct_words(words, ends)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))[which] if len(names) else np.zeros(0, np.uint64)
    first = np.searchsorted(rows, np.arange(len(text) + 1))
    padded = np.concatenate([hashes, np.zeros(WORDS, np.uint64)])
    total = np.zeros(len(hashes), np.uint64)
    for j in range(WORDS):
        total += padded[j:j + len(hashes)] * _P[j]
    total = _mixed(total)
    out = []
    for a, b in zip(first, first[1:]):
        if b - a >= WORDS:
            out.append(np.unique(total[a:b - WORDS + 1]))
        elif b > a:
            short = (hashes[a:b] * _P[:b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)
            out.append(_mixed(short * _P[WORDS]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minhash(shingles: np.ndarray) -> np.ndarray:
    """One 32-bit minimum for each of ROWS x BANDS hash functions."""
    low = shingles.astype(np.uint32)
    least = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):
        np.minimum(least, (low[at:at + 4096, None] * _A + _B).min(0), out=least)
    return least


def band_keys(values: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row of minima."""
    v = values.astype(np.uint64).reshape(len(values), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), v.shape[:2]).copy()
    for j in range(ROWS):
        key = _mixed(key * _P[j] + v[:, :, j])
    return key.view(np.int64)


def needed_matches(least: float = LEAST, tolerance: float = TOLERANCE, step: int = STEP, total: int = ROWS * BANDS) -> list[tuple[int, int]]:
    """(values compared, fewest matches that keep a pair) for each step.

    With a uniform prior the similarity after m matches in n values is Beta(m + 1, n - m + 1); the probability that it
    reaches t is that of at most m successes in n + 1 draws of chance t.
    """
    found = []
    for n in range(step, total + 1, step):
        chance, m = 0.0, -1
        while chance < tolerance:
            m += 1
            chance += comb(n + 1, m) * least**m * (1 - least) ** (n + 1 - m)
        found.append((n, m))
    return found


def prune(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The pairs (a[i], b[i]) that no step drops, as positions in a."""
    alive, seen = np.arange(len(a)), np.zeros(len(a), np.int64)
    at = 0
    for n, fewest in needed_matches():
        seen = seen + (values[a[alive], at:n] == values[b[alive], at:n]).sum(1)
        keep = seen >= fewest
        alive, seen, at = alive[keep], seen[keep], n
    return alive


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least row that each of n rows is linked to by the pairs."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def pairs_of(sizes: np.ndarray, limit: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs a < b inside consecutive groups of these sizes, some at a time."""
    ends = np.cumsum(sizes)
    partners = np.repeat(ends, sizes) - np.arange(int(sizes.sum())) - 1
    part = np.cumsum(partners) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(partners)]
    for i, j in zip(cuts, cuts[1:]):
        rows = np.arange(i, j)
        yield np.repeat(rows, partners[i:j]), runs(rows + 1, partners[i:j])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 4096) -> Iterator[pa.Table]:
    """Tables of whole groups, of about ``rows`` rows, from rows sorted by the keys; groups are bounded by the caller."""
    held: list[pa.RecordBatch] = []

    def group_starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for k in keys:
            v = table.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            table = pa.Table.from_batches(held)
            last = int(group_starts(table)[-1])
            if last:
                yield table.slice(0, last)
            held = table.slice(last).combine_chunks().to_batches()
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held)


def _group_sizes(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.diff(np.append(np.flatnonzero(new), table.num_rows))


def _blocks(members: DataFrame, key: str, size: str = "n", block: int = BLOCK) -> DataFrame:
    """Rows of (key, i, j): each member in all pairs of blocks that its own block is part of; ``mine`` is its block."""
    count = F.ceil(F.col(size) / F.lit(block)).cast("int")
    return (
        members.withColumn("mine", F.pmod(F.xxhash64("id"), count).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
        .withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).drop("other", size)
        .repartition(F.col(key), F.col("i"), F.col("j")).sortWithinPartitions(key, "i", "j", "mine", "id")
    )


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, print, values, bands) of each row with words: print names the shingle set, values are 16 bits of each minimum."""
    def sign(batches):
        for b in slices(batches):
            sets = shingle_sets(b.column("text"))
            rows = np.flatnonzero([len(s) > 0 for s in sets])
            if not len(rows):
                continue
            minima = np.stack([minhash(sets[r]) for r in rows])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").take(pa.array(rows)), pa.array([xxhash.xxh3_128_hexdigest(sets[r].tobytes()) for r in rows]),
                    pa.array([v.tobytes() for v in minima.astype(np.uint16)], pa.binary()), pa.array([k.tobytes() for k in band_keys(minima)], pa.binary()),
                    pa.array(list(band_keys(minima)), pa.list_(pa.int64())),
                ],
                ["doc_id", "print", "values", "keys", "bands"],
            )

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(sign, "doc_id bigint, print string, values binary, keys binary, bands array<bigint>")


def candidate_edges(reps: DataFrame) -> DataFrame:
    """(a, b): a forest over the pairs of (id, values, keys, bands) that share a band and outlast the pruning."""
    banded = reps.select("id", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = _blocks(banded.join(shared, "key").join(reps.select("id", "values", "keys"), "id"), "key")

    def compare(batches):
        for t in whole_groups(batches, ["key", "i", "j"]):
            n = t.num_rows
            ids, band, mine = (t.column(c).to_numpy() for c in ("id", "band", "mine"))
            apart = t.column("i").to_numpy() != t.column("j").to_numpy()
            values = np.frombuffer(b"".join(t.column("values").to_pylist()), np.uint16).reshape(n, -1)
            keys = np.frombuffer(b"".join(t.column("keys").to_pylist()), np.int64).reshape(n, -1)
            left, right = [], []
            for a, b in pairs_of(_group_sizes(t, ["key", "i", "j"])):
                keep = ~apart[a] | (mine[a] != mine[b])  # pairs inside a block have their own work
                keep &= ids[a] != ids[b]
                a, b = a[keep], b[keep]
                first = (keys[a] == keys[b]).argmax(1) == band[a]  # else an earlier band has them
                a, b = a[first], b[first]
                stay = prune(a, b, values)
                left.append(a[stay])
                right.append(b[stay])
            label = forest(np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)]), n)
            moved = np.flatnonzero(label != np.arange(n))
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], ["a", "b"])

    return members.mapInArrow(compare, "a bigint, b bigint")


def _exact_links(sets: list[np.ndarray], weight: np.ndarray, block: np.ndarray, apart: bool, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(linked weight of each row, pairs a, b) by exact comparison, for rows of one pair of blocks."""
    n, sizes = len(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    mark = np.zeros(len(names), bool)
    links, left, right = np.zeros(n, np.int64), [], []
    for a in range(n - 1):
        rows = np.arange(a + 1, n)
        keep = np.minimum(sizes[rows], sizes[a]) >= least * np.maximum(sizes[rows], sizes[a]) - 1e-9
        if apart:
            keep &= block[rows] != block[a]
        rows = rows[keep]
        if not len(rows):
            continue
        own = flat[ends[a] - sizes[a]:ends[a]]
        mark[own] = True
        hits = mark[flat[runs(ends[rows] - sizes[rows], sizes[rows])]]
        common = np.add.reduceat(hits, np.cumsum(sizes[rows]) - sizes[rows], dtype=np.int64)
        mark[own] = False
        rows = rows[common >= least * (sizes[rows] + sizes[a] - common) - 1e-9]
        links[a] += weight[rows].sum()
        links[rows] += weight[a]
        left.append(np.full(len(rows), a))
        right.append(rows)
    none = np.zeros(0, np.int64)
    return links, np.concatenate([none, *left]), np.concatenate([none, *right])


def verified(docs: DataFrame, reps: DataFrame, clusters: DataFrame, least: float = LEAST) -> DataFrame:
    """(id, links, root): exactly linked rows of each document, and a forest over the links, for each pair of blocks.

    ``clusters`` (id, label) are the components of the candidate edges; all pairs inside one are compared.
    """
    sizes = clusters.groupBy("label").agg(F.count("*").alias("n"))
    rows = clusters.join(sizes, "label").join(reps.select("id", "copies"), "id")
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), "text")
    members = _blocks(rows.join(texts, "id"), "label")

    def compare(batches):
        for t in whole_groups(batches, ["label", "i", "j"], rows=256):
            at = 0
            for n in _group_sizes(t, ["label", "i", "j"]):
                g = t.slice(at, n).combine_chunks()
                at += n
                ids, copies, mine = (g.column(c).to_numpy() for c in ("id", "copies", "mine"))
                sets = shingle_sets(g.column("text").chunk(0))
                links, a, b = _exact_links(sets, copies, mine, g.column("i")[0].as_py() != g.column("j")[0].as_py(), least)
                root = forest(a, b, n)
                some = np.flatnonzero(links > 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[root[some]])], ["id", "links", "root"])

    return members.mapInArrow(compare, "id bigint, links bigint, root bigint")


def near_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies), one row per row of (doc_id, text).

    Two documents are linked if the Jaccard similarity of their five-word shingles is 0.8 or more. class_id is the
    least doc_id over all chains of links, n_links the number of other rows linked, n_copies the rows with the very same
    shingles (itself included). A text without words (null, empty) has no shingles: it is its own class without
    links. Rows with null doc_id take no part and have a null class. A doc_id names one document.

    Equal shingle sets become one representative first, counted map-side, so copies are never paired. Bands give candidates;
    pairs in a band are compared value by value and pruned, in blocks, and leave a forest, not pairs. What hangs
    together is then verified exactly, again in blocks that leave counts and a forest.
    """
    signed = settle(signatures(docs), "signatures")
    classes = settle(signed.groupBy("print").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")), "prints")
    one = signed.withColumnRenamed("doc_id", "id").join(classes, ["print", "id"]).dropDuplicates(["id"])
    reps = settle(one.select("id", "copies", "values", "keys", "bands"), "reps")
    clusters = settle(component_labels(candidate_edges(reps)), "clusters")
    links = settle(verified(docs, reps, clusters), "links")
    labels = component_labels(links.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("id").agg(F.sum("links").alias("links"))
    known = classes.join(counted, "id", "left").join(labels.distinct(), "id", "left").select(
        "print", F.coalesce("label", "id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"),
    )
    printed = signed.select("doc_id", "print").join(known, "print").drop("print").dropDuplicates(["doc_id"])
    alone = F.when(F.col("doc_id").isNotNull(), 1).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(printed, "doc_id", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce(F.col("n_copies"), alone).alias("n_copies"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each class stays, the one whose doc_id is the class; rows without doc_id all stay. Same columns."""
    classes = near_classes(docs.select("doc_id", "text"))
    first = classes.where("doc_id = class_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns]).dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id IS NULL"))
