"""SimHash near duplicates: pairs of fingerprints are discarded by tables of their distances to pivots, survivors verified."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustframe.llm.common import LOWER, component_labels, runs, slices, split_words, text_bytes
from trustframe.llm.near_join import forest, whole_groups
from trustframe.operators.storage import settle

#: Words of a shingle, differing bits of a link, seed of the shingle hash.
WORDS, NEAR, SEED = 4, 4, 42
#: Reference fingerprints of the distance table, and how many of its columns are compared at a time.
PIVOTS, COLUMNS = 32, 8
#: Members of a block, and fingerprints of a cell that are aimed at.
BLOCK, CELL = 512, 256
_PIVOTS = np.random.default_rng(1302).integers(0, 1 << 64, PIVOTS, dtype=np.uint64)


def fingerprints(text: pa.Array) -> np.ndarray:
    """The 64-bit fingerprint of each text: a bit is set if more than half of the shingles' hashes have it."""
    data, offsets = text_bytes(text)
    words, ends, rows = split_words(LOWER[data], offsets)
    n = len(rows)
    spaced = np.full(len(words) + n, 32, np.uint8)  # each word and a space
    spaced[np.arange(len(words)) + np.repeat(np.arange(n), np.diff(ends))] = words
    begins = ends[:-1] + np.arange(n)
    finish = ends[1:] + np.arange(n)
    per_row = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.cumsum(per_row) - per_row
    shingles = np.where(per_row >= WORDS, per_row - WORDS + 1, (per_row > 0).astype(np.int64))
    start = runs(first, shingles)
    last = start + np.repeat(np.minimum(per_row, WORDS), shingles) - 1
    blob, owner = spaced.tobytes(), np.repeat(np.arange(len(per_row)), shingles)
    ones = np.zeros((len(per_row), 64), np.int64)
    for at in range(0, len(start), 1 << 15):
        s, e, who = begins[start[at:at + (1 << 15)]], finish[last[at:at + (1 << 15)]], owner[at:at + (1 << 15)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(blob[a:b], SEED) for a, b in zip(s.tolist(), e.tolist())), np.uint64, len(s))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cuts = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        ones[who[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little").view("<u8").ravel()


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row; fp is the fingerprint as a signed number."""
    def sign(batches):
        for b in slices(batches):
            fp = fingerprints(b.column("text")).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id bigint, fp bigint")


def cell_masks(n: int) -> list[int]:
    """Masks of bits that two linked fingerprints have in common under at least one mask.

    The 64 bits are cut into b blocks; four differing bits leave b - 4 of them equal, so any choice of b - 4 blocks is a
    mask. b grows with the number of fingerprints so that a cell of unrelated ones holds about ``CELL``; every choice is exact.
    """
    for b in (5, 6, 7, 8):
        if n <= CELL << (64 * (b - NEAR) // b) or b == 8:
            edges = [64 * i // b for i in range(b + 1)]
            block = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
            return [sum(some) for some in combinations(block, b - NEAR)]
    raise AssertionError


def _pairs(group: np.ndarray, table: np.ndarray, limit: int = 200_000):
    """Pairs a < b of rows of one group whose distances to the first pivot differ by at most NEAR, some at a time.

    Rows are sorted by (group, first distance), so the partners of a row follow it.
    """
    key = group.astype(np.int64) * 128 + table[:, 0]
    partners = np.searchsorted(key, key + NEAR, "right") - np.arange(len(key)) - 1
    part = np.cumsum(partners) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(partners)]
    for i, j in zip(cuts, cuts[1:]):
        rows = np.arange(i, j)
        yield np.repeat(rows, partners[i:j]), runs(rows + 1, partners[i:j])


def survivors(a: np.ndarray, b: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Positions of pairs that no pivot tells apart: by the triangle inequality no coordinate of a link differs by more than NEAR."""
    alive = np.arange(len(a))
    for at in range(0, table.shape[1], COLUMNS):
        apart = np.abs(table[a[alive], at:at + COLUMNS] - table[b[alive], at:at + COLUMNS]).max(1, initial=0)
        alive = alive[apart <= NEAR]
    return alive


def linked(fp: np.ndarray, group: np.ndarray, apart: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest (a, b) over the linked rows inside each group; where ``apart``, only pairs of different blocks count."""
    table = np.bitwise_count(fp[:, None] ^ _PIVOTS).astype(np.int16)
    order = np.lexsort((table[:, 0], group))
    fp, group, apart, mine, table = fp[order], group[order], apart[order], mine[order], table[order]
    none = np.zeros(0, np.int64)
    left, right = [none], [none]
    for a, b in _pairs(group, table):
        keep = ~apart[a] | (mine[a] != mine[b])
        a, b = a[keep], b[keep]
        some = survivors(a, b, table)
        a, b = a[some], b[some]
        true = np.bitwise_count(fp[a] ^ fp[b]) <= NEAR
        left.append(a[true])
        right.append(b[true])
    label = forest(np.concatenate(left), np.concatenate(right), len(fp))
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return order[moved], order[label[moved]]


def links(prints: DataFrame) -> DataFrame:
    """(a, b): a forest over all pairs of distinct fingerprints (fp) with at most four differing bits.

    Cells partition the work: linked fingerprints share a cell by the pigeonhole principle. A cell of any size is cut into blocks,
    and each pair of blocks is a piece of work of its own. Inside, the pivot table decides.
    """
    masks = cell_masks(prints.count())
    cells = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks])).alias("mask", "part"))
    sizes = settle(cells.groupBy("mask", "part").agg(F.count("*").alias("n")).where("n > 1"), "cells")
    count = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    members = (
        cells.join(sizes, ["mask", "part"])
        .withColumn("mine", F.pmod(F.xxhash64("fp"), count).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
        .select("fp", "mask", "part", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
        .repartition("mask", "part", "i", "j").sortWithinPartitions("mask", "part", "i", "j")
    )
    keys = ["mask", "part", "i", "j"]

    def compare(batches):
        for t in whole_groups(batches, keys):
            fp, mine = t.column("fp").to_numpy(), t.column("mine").to_numpy()
            columns = [t.column(k).to_numpy() for k in keys]
            new = np.zeros(len(fp), bool)
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            a, b = linked(fp.view(np.uint64), np.cumsum(new), columns[2] != columns[3], mine)
            yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])

    return members.mapInArrow(compare, "a bigint, b bigint").distinct()


def near_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of (doc_id, text).

    Words are runs of anything but white space, A-Z in lower case; shingles of four words count as often as they occur. A text of one to
    three words is one shingle; a text without words (null, empty) has fingerprint zero and links like any other. Documents
    link at four or fewer differing bits; component_id is the least doc_id over all chains of links. Equal fingerprints are
    merged first, so copies are never paired. A null doc_id takes part and has a row, but names no component (null where no
    other document is linked). Repeated rows are kept; an empty table gives an empty result; other columns are ignored.
    """
    rows = settle(signed(docs), "simhash")
    prints = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    labels = component_labels(links(prints.select("fp"))).withColumnsRenamed({"id": "fp", "label": "root"})
    placed = settle(prints.join(labels, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "placed")
    least = settle(placed.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    known = settle(placed.join(least, "root").select("fp", "component_id"), "components")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(known, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")
