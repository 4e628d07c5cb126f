"""Sequences of related documents: BM25 neighbours among documents of like content fill a seed document's window."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustframe.llm.common import binary_array, binary_parts, encoder, parts_for, runs, slices, text_bytes
from trustframe.operators.storage import settle

WINDOW = 2048
#: Ids of a shard, terms of the key by which documents are dealt, and neighbours looked at before all are ranked.
SHARD_IDS, KEYS, FIRST = 1 << 20, 6, 64
#: Sequence numbers from here on are full windows of single documents.
FULL = 1 << 62
K1, B = 1.2, 0.75


def term_counts(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, times) of all terms of documents whose ids follow one another, by document, then term."""
    owner = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    keys, tf = np.unique((owner << 32) | ids, return_counts=True)
    return keys >> 32, keys & 0xFFFFFFFF, tf


@dataclass
class Statistics:
    """What BM25 needs to know of all documents: bounded by the tokenizer's vocabulary."""

    df: np.ndarray
    docs: int
    mean: float

    @cached_property
    def draws(self) -> np.ndarray:
        """KEYS exponential draws of each term."""
        return np.stack([np.random.default_rng(k).exponential(size=len(self.df)) for k in range(KEYS)])

    def weights(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, counts: np.ndarray) -> np.ndarray:
        idf = np.log1p((self.docs - self.df + 0.5) / (self.df + 0.5))
        length = K1 * (1 - B + B * counts / max(self.mean, 1))
        return idf[term] * tf * (K1 + 1) / (tf + length[doc])

    def keys(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """KEYS weighted MinHash values of each document's terms that other documents have too: terms, as bytes.

        Two documents share a value about as likely as their weights of terms overlap; related ones share the first few.
        """
        shared = self.df[term] > 1
        weight = self.weights(doc, term, tf, counts)[shared]
        doc, term = doc[shared], term[shared]
        owners, first = np.unique(doc, return_index=True)
        out = np.zeros((len(counts), KEYS), ">u4")
        for k in range(KEYS if len(owners) else 0):
            draw = self.draws[k][term] / np.maximum(weight, 1e-12)
            least = np.minimum.reduceat(draw, first)
            hits = np.flatnonzero(draw == np.repeat(least, np.diff(np.append(first, len(doc)))))
            out[owners, k] = term[hits[np.searchsorted(doc[hits], owners)]] + 1
        return [row.tobytes() for row in out]


class Index:
    """Inverted BM25 index of one shard: postings by term, each with its weight; terms of a tenth of the documents as rows of a matrix."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, counts: np.ndarray, known: Statistics):
        n = len(counts)
        weight = known.weights(doc, term, tf, counts)
        _, term_no, df = np.unique(term, return_inverse=True, return_counts=True)
        first = np.searchsorted(doc, np.arange(n + 1))
        self.query = [term_no[first[d]:first[d + 1]] for d in range(n)]
        common = np.flatnonzero(df * 10 >= n)
        self.row = np.full(len(df), -1)
        self.row[common] = np.arange(len(common))
        rare = self.row[term_no] < 0
        self.matrix = np.zeros((len(common), n))
        self.matrix[self.row[term_no[~rare]], doc[~rare]] = weight[~rare]
        self.df = np.where(self.row < 0, df, 0)
        by_term = np.flatnonzero(rare)[np.argsort(term_no[rare], kind="stable")]
        self.doc, self.weight = doc[by_term], weight[by_term]
        self.starts = np.append(0, np.cumsum(self.df))
        self.n = n

    def scores(self, seed: int) -> np.ndarray:
        """Of each document, the sum of its weights of all terms of the seed."""
        terms = self.query[seed]
        asked = np.zeros(len(self.matrix))
        asked[self.row[terms[self.row[terms] >= 0]]] = 1
        terms = terms[self.row[terms] < 0]
        at = runs(self.starts[terms], self.df[terms])
        return asked @ self.matrix + np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)


def ranked(scores: np.ndarray, left: np.ndarray):
    """Unused documents by falling score, ties to the earlier: the first few at once, then all the rest."""
    if len(left) > 2 * FIRST:
        part = np.argpartition(-scores[left], FIRST)[:FIRST]
        floor = scores[left[part]].min()
        top = left[scores[left] > floor]
        top = top[np.argsort(-scores[top], kind="stable")]
        yield from top
        left = left[scores[left] <= floor]
    yield from left[np.argsort(-scores[left], kind="stable")]


def pack_shard(index: Index, rest: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of all pieces of a shard; no document has more than a window.

    The longest document is the next seed; its best unused neighbours that fit follow whole, and the next one is cut to fill the rest. So all
    windows are full but the last, which is cut into sequences whose lengths are powers of two.
    """
    n, out, sequence = len(rest), [], 0
    start, rest = np.zeros(n, np.int64), rest.copy()
    unused = rest > 0
    seeds = np.lexsort((np.arange(n), -rest))
    last: list[tuple[int, int, int]] = []
    for seed in seeds:
        if not unused[seed]:
            continue
        pieces, room = [(seed, start[seed], rest[seed])], window - rest[seed]
        unused[seed] = False
        left = np.flatnonzero(unused)
        cut, fits, tried = -1, True, 0
        if room and len(left):
            for d in ranked(index.scores(seed), left):
                tried += 1
                if rest[d] <= room:
                    pieces.append((d, start[d], rest[d]))
                    unused[d] = False
                    room -= rest[d]
                elif cut < 0:
                    cut = d
                if not room or (cut >= 0 and tried >= FIRST):
                    break
        if room and cut >= 0:
            pieces.append((cut, start[cut], room))
            start[cut] += room
            rest[cut] -= room
            room = 0
        if room:
            last = pieces  # nothing is left to fill it
            break
        offset = 0
        for d, at, length in pieces:
            out.append((d, at, length, sequence, offset))
            offset += length
        sequence += 1
    total = int(sum(p[2] for p in last))
    sizes = [1 << k for k in range(total.bit_length()) if total >> k & 1][::-1]
    room = sizes.pop(0) if sizes else 0
    offset = 0
    for d, at, length in last:
        while length:
            take = min(length, room - offset)
            out.append((d, at, take, sequence, offset))
            at, length, offset = at + take, length - take, offset + take
            if offset == room:
                sequence, offset, room = sequence + 1, 0, sizes.pop(0) if sizes else 0
    return out


OUT = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def encoded(rows: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, mark, ids, terms) of all rows of (doc_id, text, mark): the ids and ``end_id`` in two bytes each, or four if the vocabulary asks for it.

    terms are pairs (id, times) in four bytes each.
    """
    width = id_type(tokenizer)

    def encode(batches):
        encode_rows = encoder(tokenizer)
        for b in slices(batches):
            got, sizes = encode_rows(*text_bytes(b.column("text")), end_id)
            ends = np.append(0, np.cumsum(sizes)) * width.itemsize
            ids = binary_array(np.frombuffer(got.astype(width).tobytes(), np.uint8), ends)
            doc, term, tf = term_counts(got.astype(np.int64), sizes)
            pairs = np.column_stack([term, tf]).astype("<u4")
            terms = binary_array(np.frombuffer(pairs.tobytes(), np.uint8), np.searchsorted(doc, np.arange(len(sizes) + 1)) * 8)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("mark"), ids.cast(pa.binary()), terms.cast(pa.binary())], ["doc_id", "mark", "ids", "terms"])

    return rows.mapInArrow(encode, CODED)


CODED = "doc_id bigint, mark bigint, ids binary, terms binary"


def id_type(tokenizer: str) -> np.dtype:
    from tokenizers import Tokenizer

    return np.dtype("<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4")


def read_ids(column: pa.Array, width: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, one after another, and the number of ids of each row."""
    data, offsets = binary_parts(column.cast(pa.large_binary()))
    return data.view(width).astype(np.int64), np.diff(offsets) // width.itemsize


def read_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, times), and the number of ids of each document."""
    data, offsets = binary_parts(column.cast(pa.large_binary()))
    pairs = data.view("<u4").reshape(-1, 2).astype(np.int64)
    doc = np.repeat(np.arange(len(column), dtype=np.int64), np.diff(offsets) // 8)
    return doc, pairs[:, 0], pairs[:, 1], np.bincount(doc, weights=pairs[:, 1], minlength=len(column)).astype(np.int64)


def statistics(coded: DataFrame) -> Statistics:
    """Counts over all documents; term -1 has the documents, -2 the ids."""
    def count(batches):
        total, docs, size = np.zeros(0, np.int64), 0, 0
        for b in slices(batches, "terms"):
            _, term, _, counts = read_terms(b.column("terms"))
            some = np.bincount(term, minlength=len(total))
            some[:len(total)] += total
            total, docs, size = some, docs + len(counts), size + int(counts.sum())
        terms = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(terms, [-1, -2])), pa.array(np.append(total[terms], [docs, size]))], ["term", "n"])

    table = coded.select("terms").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    term, n = table["term"].to_numpy(np.int64), table["n"].to_numpy(np.int64)
    df = np.zeros(max(term.max(initial=-1) + 1, 1), np.int64)
    df[term[term >= 0]] = n[term >= 0]
    docs, size = int(n[term == -1].sum()), int(n[term == -2].sum())
    return Statistics(df, docs, size / max(docs, 1))


def full_windows(coded: DataFrame, width: np.dtype) -> DataFrame:
    """The leading pieces of WINDOW ids of all documents that have so many: sequences of their own."""
    def cut(batches):
        from pyspark import TaskContext

        sequence = FULL + (TaskContext.get().partitionId() << 40)
        for b in slices(batches, "ids"):
            got, sizes = read_ids(b.column("ids"), width)
            windows = sizes // WINDOW
            doc = np.repeat(np.arange(len(sizes)), windows)
            start = runs(np.zeros(len(sizes), np.int64), windows) * WINDOW
            flat, begin = got.astype("<u4"), np.cumsum(sizes) - sizes
            crc = np.fromiter((zlib.crc32(flat[a:a + WINDOW]) for a in (begin[doc] + start).tolist()), np.int64, len(doc))
            same = np.full(len(doc), WINDOW)
            columns = (start, same, crc, sizes[doc], sequence + np.arange(len(doc)), np.zeros(len(doc), np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc)), *map(pa.array, columns)], [f.split()[0] for f in OUT.split(", ")])
            sequence += len(doc)

    return coded.select("doc_id", "ids").where(F.octet_length("ids") >= WINDOW * width.itemsize).mapInArrow(cut, OUT)


def tails(coded: DataFrame, width: np.dtype) -> DataFrame:
    """Of each document the ids after its full windows, if any: at most WINDOW - 1; from: how many come before."""
    size, window = F.octet_length("ids"), WINDOW * width.itemsize
    whole = size - size % window
    return coded.where(size % window > 0).select(
        "doc_id", "mark", F.expr(f"substring(ids, octet_length(ids) - octet_length(ids) % {window} + 1)").alias("ids"), "terms",
        (whole / width.itemsize).cast("long").alias("from"),
    )


def keyed(rows: DataFrame, known: Statistics) -> DataFrame:
    """Adds to each document the terms by which it is dealt."""
    def add(batches):
        for b in slices(batches, "terms"):
            keys = known.keys(*read_terms(b.column("terms")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary())], [*b.schema.names, "key"])

    return rows.mapInArrow(add, f"{CODED}, from bigint, key binary")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Packs (doc_id, text) into sequences of at most 2048 ids; returns the pieces.

    A document is its ids and ``end_id``; null is an empty text. As long as a document has 2048 ids, they are a sequence; what is left is packed
    with its neighbours. Terms are ids; a document's are those of its whole text, and their document frequencies and the mean length
    are counted over all documents. Rows are ordered by weighted MinHash values of their terms and dealt by
    ranges of that order, so related documents and copies stand together whatever their doc_id, and a frequent value is cut at the
    next, at last by hash of (doc_id, text). A task takes rows up to ``shard_ids`` ids as one shard, however
    many rows it has. Repeated rows are packed each. sequence_id is unique over all tasks. An empty table gives an
    empty result.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    width = id_type(tokenizer)
    coded = settle(encoded(rows.withColumn("mark", F.xxhash64("doc_id", "text")), tokenizer, end_id), "ids")
    known = statistics(coded)
    order = ["key", "mark", "doc_id"]
    rest = tails(coded, width)
    volume = rest.agg(F.coalesce(F.sum(F.octet_length("ids") + F.octet_length("terms")), F.lit(0)).alias("n")).first()["n"]
    dealt = keyed(rest, known).repartitionByRange(parts_for(volume, rows, 32 << 20), *order).sortWithinPartitions(*order)

    def pack(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        held, names, befores, ids, counts, terms = 0, [], [], [], [], []

        def shard():
            nonlocal first, held, names, befores, ids, counts, terms
            flat, sizes, before = np.concatenate(ids).astype("<u4"), np.concatenate(counts), np.concatenate(befores)
            begin = np.cumsum(sizes) - sizes
            doc, term, tf, total = read_terms(pa.chunked_array(terms).combine_chunks())
            pieces = pack_shard(Index(doc, term, tf, total, known), sizes)
            doc, start, length, sequence, offset = (np.asarray(c, np.int64) for c in zip(*pieces))
            crc = [zlib.crc32(flat[a:a + n]) for a, n in zip(begin[doc] + start, length)]
            owners = pa.array(names, pa.int64()).take(pa.array(doc))
            out = [owners, *map(pa.array, (before[doc] + start, length, np.asarray(crc, np.int64), total[doc], sequence + first, offset))]
            first += int(sequence.max()) + 1
            held, names, befores, ids, counts, terms = 0, [], [], [], [], []
            return pa.RecordBatch.from_arrays(out, [f.split()[0] for f in OUT.split(", ")])

        for b in slices(batches, "terms"):
            got, sizes = read_ids(b.column("ids"), width)
            ids.append(got)
            counts.append(sizes)
            befores.append(b.column("from").to_numpy())
            terms.append(b.column("terms").cast(pa.large_binary()))
            names += b.column("doc_id").to_pylist()
            held += len(got)
            if held >= shard_ids:
                yield shard()
        if names:
            yield shard()

    return full_windows(coded, width).unionByName(dealt.mapInArrow(pack, OUT))
