"""Order MinHash: fingerprints whose likeness follows the edit distance."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustframe.llm.common import parts_for, text_volume
from trustframe.operators.storage import settle

K, TUPLE, SKETCHES = 8, 2, 32
#: Places of a text that the packed sort key holds; longer texts are numbered by a stable sort.
PACKED = 1 << 22
_MIX, _A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
_TURNS = np.arange(SKETCHES, dtype=np.uint64) * np.uint64((1 << 64) // SKETCHES)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x ^= x >> np.uint64(29)
    x *= _A
    x ^= x >> np.uint64(32)
    return x


def sketch(text: str) -> np.ndarray:
    """The signature: per permutation, a 32-bit hash of the tuple of its minimal numbered k-mers in text order.

    A k-mer is K = 8 code points (a shorter text is one k-mer); its number counts the equal k-mers before it.
    Permutation s orders the numbered k-mers by (hash - s * 2**64 / SKETCHES) mod 2**64, so one sort serves all of
    them; each takes its TUPLE least k-mers (all, if fewer) and keeps them as they follow in the text.
    """
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    code += np.uint64(1)
    if len(code) < K:
        code = np.concatenate([code, np.zeros(K - len(code), np.uint64)])
    grams = code[:-1] * _A + code[1:]
    grams = grams[:-2] * _B + grams[2:]
    grams = _mixed(grams[:-4] * _C + grams[4:])
    n = len(grams)
    low = np.uint64(PACKED - 1)
    if n <= PACKED:  # equal k-mers side by side and in text order, by one sort of plain numbers
        grams &= ~low
        grams |= np.arange(n, dtype=np.uint64)
        grams.sort()
        place, high = grams & low, grams & ~low
    else:
        grams &= ~low
        place = np.argsort(grams, kind="stable").astype(np.uint64)
        high = grams[place]
    same = np.flatnonzero(high[1:] == high[:-1]) + 1
    if len(same):
        new = np.arange(n)
        new[same] = 0
        high = high + (np.arange(n) - np.maximum.accumulate(new)).astype(np.uint64) * _C
    keys = _mixed(high)
    order = np.argsort(keys)
    size = min(TUPLE, n)
    first = np.searchsorted(keys, _TURNS, sorter=order)
    picked = order[(first[:, None] + np.arange(size)) % n]
    picked = np.take_along_axis(picked, np.argsort(place[picked], axis=1), 1)
    value = np.full(SKETCHES, size, np.uint64)
    for j in range(size):
        value = (value ^ keys[picked[:, j]]) * _MIX
        value ^= value >> np.uint64(32)
    return value >> np.uint64(32)


def as_text(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the permutations whose tuples agree."""
    return float(np.mean(a == b))


def edited(text: str, after: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as many of ``after``."""
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc_id, text: str, own: np.ndarray, after: str, following: np.ndarray) -> tuple:
    changed = edited(text, after)
    other = sketch(changed)
    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), sha, as_text(own), as_text(other), likeness(own, other), likeness(own, following)


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts, of their edited texts, and their likeness to these and to the next document's.

    (doc_id, text) in, one row per row out. Documents follow by doc_id (null first, equal ones by hash of the text), the last is
    followed by the first; a single document follows itself. Null is an empty text. An empty table gives an empty result.

    One shuffle, by ranges of doc_id: a task knows what follows each of its documents but the last. It hands on its
    first and last document, two rows for each partition, which a second small step pairs up.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = parts_for(text_volume(rows), rows)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("head", pa.string()), ("tail", pa.string()),
    ])

    def within(batches):
        from pyspark import TaskContext

        part, last, out = TaskContext.get().partitionId(), None, []
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                text = text.as_py()
                own = sketch(text)
                if last is None:
                    out.append((doc_id, *[None] * 6, part, text, None))
                else:
                    out.append((*_row(*last, text, own), None, None, None))
                last = (doc_id, text, own)
                if len(out) >= 1000:
                    yield _record(out, schema)
                    out = []
        if last is not None:
            out.append((last[0], *[None] * 6, part, None, last[1]))
        if out:
            yield _record(out, schema)

    done = settle(dealt.mapInArrow(within, f"{OUT}, part int, head string, tail string"), "fingerprints")
    ends = done.where("part IS NOT NULL").groupBy("part").agg(
        F.max("head").alias("head"), F.max("tail").alias("tail"), F.max(F.when(F.col("tail").isNotNull(), F.col("doc_id"))).alias("doc_id"),
    )
    follow = Window.orderBy("part")  # one row for each partition
    whole = follow.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    paired = ends.withColumn("after", F.coalesce(F.lead("head").over(follow), F.first("head").over(whole))).select("doc_id", "tail", "after")

    def across(batches):
        for b in batches:
            found = [_row(r["doc_id"], r["tail"], sketch(r["tail"]), r["after"], sketch(r["after"])) for r in b.to_pylist()]
            if found:
                yield _record(found, pa.schema(list(schema)[:7]))

    names = [f.split()[0] for f in OUT.split(", ")]
    spread = paired.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return done.where("part IS NULL").select(*names).unionByName(spread.mapInArrow(across, OUT))
