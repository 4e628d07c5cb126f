"""Token ids in files of shuffled planes: fixed-size blocks transposed to bit or byte planes, each compressed by itself."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustframe.llm.common import encoder, parts_for, slices, text_bytes, text_volume
from trustframe.operators.storage import settle

MAGIC = b"PLN1"
#: magic, bits of a plane (1 or 8), ids of a block, ids, documents, blocks, bytes of the document table.
HEAD = struct.Struct("<4sBIQQII")


def to_planes(block: np.ndarray, bits: int) -> list[bytes]:
    """The planes of a block from the lowest up to the highest that is not all zero."""
    raw = np.ascontiguousarray(block, "<u4").view(np.uint8).reshape(-1, 4)
    used = int(block.max()).bit_length() if len(block) else 0
    if bits == 8:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(-(-used // 8))]
    lanes = np.unpackbits(raw, axis=1, bitorder="little")[:, :used]
    return [p.tobytes() for p in np.packbits(np.ascontiguousarray(lanes.T), axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    if bits == 8:
        raw = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            raw[:, k] = np.frombuffer(p, np.uint8)
    else:
        lanes = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(planes):
            lanes[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n]
        raw = np.packbits(lanes, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


def pack_file(ids: np.ndarray, doc_ids: list, counts: np.ndarray, bits: int = 8, block: int = 1 << 16, level: int = 1) -> bytes:
    """One file: head, index of the blocks (ids, planes, bytes of each plane), document table, planes."""
    squeeze = zstandard.ZstdCompressor(level=level).compress
    index, body = [], []
    for at in range(0, len(ids), block):
        part = ids[at:at + block]
        planes = [squeeze(p) for p in to_planes(part, bits)]
        index.append(struct.pack(f"<IB{len(planes)}I", len(part), len(planes), *map(len, planes)))
        body += planes
    known = np.fromiter((d is not None for d in doc_ids), bool, len(doc_ids))
    names = np.fromiter((d or 0 for d in doc_ids), "<i8", len(doc_ids))
    table = squeeze(known.tobytes() + names.tobytes() + np.asarray(counts, "<i8").tobytes())
    return b"".join([HEAD.pack(MAGIC, bits, block, len(ids), len(doc_ids), len(index), len(table)), *index, table, *body])


def unpack_file(data: bytes) -> tuple[np.ndarray, list, np.ndarray]:
    """(ids, doc_ids, number of ids of each document)."""
    magic, bits, _, n_ids, n_docs, n_blocks, table_bytes = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a file of planes")
    widen = zstandard.ZstdDecompressor().decompress
    at, index = HEAD.size, []
    for _ in range(n_blocks):
        n, planes = struct.unpack_from("<IB", data, at)
        index.append((n, struct.unpack_from(f"<{planes}I", data, at + 5)))
        at += 5 + 4 * planes
    table = widen(data[at:at + table_bytes])
    at += table_bytes
    known = np.frombuffer(table, bool, n_docs)
    names = np.frombuffer(table, "<i8", n_docs, n_docs)
    counts = np.frombuffer(table, "<i8", n_docs, 9 * n_docs)
    parts = []
    for n, sizes in index:
        planes = []
        for size in sizes:
            planes.append(widen(data[at:at + size]))
            at += size
        parts.append(from_planes(planes, n, bits))
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    if len(ids) != n_ids:
        raise ValueError("a block is missing")
    return ids, [int(d) if k else None for d, k in zip(names, known)], counts


def write_planes(docs: DataFrame, tokenizer: str, end_id: int = 0, bits: int = 8, file_ids: int = 1 << 20) -> DataFrame:
    """Encodes (doc_id, text) and writes the files; returns their table (part, seq, n_ids, data).

    Files follow by part and seq in ascending doc_id (null first, equal ones by hash of the text); a file takes whole
    documents up to about ``file_ids`` ids, a longer document has its own. Null is an empty text. The files are rows
    of a table in the shared folder, so that any store that Spark writes to holds them and a lost task leaves none
    behind; each row's data is a file that ``unpack_file`` reads alone.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(parts_for(text_volume(rows), rows), *order).sortWithinPartitions(*order)

    def encode(batches):
        from pyspark import TaskContext

        part, seq, names, ids, counts, held = TaskContext.get().partitionId(), 0, [], [], [], 0
        encode_rows = encoder(tokenizer)

        def file():
            flat, sizes = np.concatenate(ids), np.concatenate(counts)
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "n_ids": [len(flat)], "data": [pack_file(flat, names, sizes, bits)]}, pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("data", pa.binary())]))

        for b in slices(batches):
            got, sizes = encode_rows(*text_bytes(b.column("text")), end_id)
            ids.append(got)
            counts.append(sizes)
            names += b.column("doc_id").to_pylist()
            held += len(got)
            if held >= file_ids:
                yield file()
                seq, names, ids, counts, held = seq + 1, [], [], [], 0
        if names:
            yield file()

    return settle(dealt.mapInArrow(encode, "part int, seq int, n_ids bigint, data binary"), "planes")


def read_planes(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the files.

    start is the number of ids of all earlier documents: sums run over parts (one row each), over files inside a
    part, and over documents inside a file, so nothing that grows with the documents meets in one task.
    """
    def decode(batches):
        for b in batches:
            for row in b.to_pylist():
                ids, names, counts = unpack_file(row["data"])
                ends = np.cumsum(counts)
                crc = [zlib.crc32(ids[e - n:e].tobytes()) for e, n in zip(ends, counts)]
                n = len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(names, pa.int64()), pa.array(ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())],
                    ["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    rows = files.select("part", "seq", "data").mapInArrow(decode, "part int, seq int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint")
    sizes = files.select("part", "seq", "n_ids")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier(Window.orderBy("part"))), F.lit(0)).alias("before"))
    inside = sizes.select("part", "seq", F.coalesce(F.sum("n_ids").over(earlier(Window.partitionBy("part").orderBy("seq"))), F.lit(0)).alias("ahead"))
    placed = inside.join(parts, "part").select("part", "seq", (F.col("before") + F.col("ahead")).alias("base"))
    return rows.join(placed, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
