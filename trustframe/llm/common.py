"""Texts as UTF-8 arrays inside tasks, exact cached tokenization, and component labels."""

from __future__ import annotations

import gc
import math
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustframe.operators.storage import settle

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that a letter, a digit, an underscore or part of a non-ASCII character may have.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that a task turns into arrays at a time; a longer text is taken whole.
SLICE_BYTES = 2 << 20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offsets of its rows; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array of the adjoining pieces of ``data``."""
    data, offsets = np.ascontiguousarray(data), np.ascontiguousarray(offsets, np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def binary_parts(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large binary array."""
    offsets = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset:pieces.offset + len(pieces) + 1] if len(pieces) else np.zeros(1, np.int64)
    data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def split_words(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray = ~SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and offsets of the words (longest runs of bytes in ``keep``), and the row of each word."""
    inside = keep[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][np.diff(offsets) > 0]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    kept = np.cumsum(inside)
    ends = np.append(kept[starts] - 1, kept[-1] if len(kept) else 0)
    return data[inside], ends, np.searchsorted(offsets, starts, "right") - 1


def distinct_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of each word among the distinct words, and these."""
    coded = binary_array(data, offsets).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions start, start + 1, ... of the runs, one run after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


#: 1: ASCII letters, 2: other visible ASCII characters but digits and the apostrophe, which may begin a contraction.
_SIDE = np.zeros(256, np.uint8)
_SIDE[33:127] = 2
_SIDE[[39, *range(48, 58)]] = 0
_SIDE[[*range(65, 91), *range(97, 123)]] = 1


_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """``a`` with at least n rows; new ones are zero."""
    return a if len(a) >= n else np.concatenate([a, np.zeros((max(n, 2 * len(a)) - len(a), *a.shape[1:]), a.dtype)])


class KnownPieces:
    """Exact numbers of pieces of up to 24 bytes, in open addressing: the keys are the pieces themselves, padded with zeros."""

    WIDTH = 8 * len(_SPREAD)

    def __init__(self, limit: int):
        self.bits = max(4, (2 * limit - 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.zeros((1024, len(_SPREAD)), np.uint64)

    def keys_of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that can be known (short, without a zero byte), and their keys."""
        sizes = np.diff(offsets)
        zeros = np.append(0, np.cumsum(data == 0))
        rows = np.flatnonzero((sizes <= self.WIDTH) & (zeros[offsets[1:]] == zeros[offsets[:-1]]))
        out = np.zeros((len(rows), self.WIDTH), np.uint8)
        inside = np.arange(self.WIDTH) < sizes[rows, None]
        out[inside] = data[runs(offsets[:-1][rows], sizes[rows])]
        return rows, out.view(np.uint64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys * _SPREAD).sum(1, dtype=np.uint64)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _SPREAD[1]
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it is not known."""
        slot, found, todo = self._slot(keys), np.full(len(keys), -1, np.int64), np.arange(len(keys))
        while len(todo):
            at = self.slots[slot[todo]]
            todo, at = todo[at >= 0], at[at >= 0]
            same = (self.keys[at] == keys[todo]).all(1)
            found[todo[same]] = at[same]
            todo = todo[~same]
            slot[todo] = (slot[todo] + 1) & (len(self.slots) - 1)
        return found

    def add(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Distinct keys that are not known yet."""
        if not len(keys):
            return
        while 2 * (int(numbers.max()) + 1) > len(self.slots):  # at most half full; only a very long text gets here
            taken = self.slots[self.slots >= 0].astype(np.int64)
            self.bits += 1
            self.slots = np.full(1 << self.bits, -1, np.int32)
            self._enter(self.keys[taken], taken)
        self.keys = _room(self.keys, int(numbers.max()) + 1)
        self.keys[numbers] = keys
        self._enter(keys, numbers)

    def _enter(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            at = slot[todo]
            free = self.slots[at] < 0
            self.slots[at[free]] = numbers[todo[free]]
            todo = todo[self.slots[at] != numbers[todo]]
            slot[todo] = (slot[todo] + 1) & (len(self.slots) - 1)


def plain_letters(data: np.ndarray) -> np.ndarray:
    """Bytes of ASCII letters and of U+00C0 to U+017F, but the signs among them and the dotted I, whose lower case is two characters."""
    lead = (data >= 0xC3) & (data <= 0xC5)
    after = np.append(data[1:], np.uint8(0))
    lead &= ~((data == 0xC3) & ((after == 0x97) | (after == 0xB7))) & ~((data == 0xC4) & (after == 0xB0))
    follows = np.zeros(len(data), bool)
    follows[1:] = lead[:-1]
    return (_SIDE[data] == 1) | lead | follows


class Encoder:
    """Token ids of whole texts as the tokenizers library gives them, by pieces that are encoded once.

    A text is cut before a space or line feed that follows a visible ASCII character or a letter up to U+017F, and between such a letter and
    a visible ASCII character that is no letter, digit or apostrophe. No token of the tokenizers used here spans such a place (their
    patterns let white space stand only at the start of a token and part letters from punctuation, and no
    normal form joins across it), so the pieces' ids in a row are the text's ids. Added tokens (``<|endoftext|>``) are found first, in the text as it
    is, and are pieces of their own. A tokenizer that drops white space gets pieces without the one before them.

    New pieces are encoded many at once. Those of letters only are told apart by their tokens: the last one of a word has the tokenizer's
    word end, or the first one its leading space. Others that begin with white space and end in a visible ASCII character
    are told apart by the offsets of their tokens. Up to ``limit`` pieces stay known to the worker process; a batch that would exceed it starts anew.
    """

    #: Bytes of new pieces that are encoded as one text.
    JOINED = 1 << 17

    def __init__(self, path: str, limit: int = 1_000_000):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.added = {}
        for number, token in self.tokenizer.get_added_tokens_decoder().items():
            if token.normalized or token.lstrip or token.rstrip or token.single_word:
                raise ValueError(f"added token {token.content} is not plain text")
            self.added[token.content.encode()] = number
        self.tokenizer.encode_special_tokens = True  # what is left between added tokens is ordinary text
        self.lower = "Lowercase()" in repr(self.tokenizer.normalizer)
        self.spaceless = not self.tokenizer.encode(" \n", add_special_tokens=False).ids
        self.words, self.mark = self.tokenizer, None
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        word_end = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if word_end and self.spaceless:
            self.words = Tokenizer.from_file(path)
            self.words.normalizer = normalizers.Lowercase() if self.lower else normalizers.Sequence([])
            self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.mark = self._marked(names, lambda token: token.endswith(word_end))
        elif self.tokenizer.encode(" a", add_special_tokens=False).tokens[0].startswith("\u0120"):
            self.mark = self._marked(names, lambda token: token.startswith("\u0120"))
        self.limit = limit
        self._forget()

    @staticmethod
    def _marked(names: dict[str, int], test) -> np.ndarray:
        mark = np.zeros(max(names.values()) + 1, bool)
        mark[[number for token, number in names.items() if test(token)]] = True
        return mark

    def _forget(self) -> None:
        self.known = KnownPieces(self.limit)
        self.ids, self.starts, self.sizes = np.zeros(1024, np.uint32), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.count = self.n_ids = 0

    def _remember(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of new pieces whose ids follow one another."""
        n, end = self.count + len(sizes), self.n_ids + len(ids)
        self.ids, self.starts, self.sizes = _room(self.ids, end), _room(self.starts, n), _room(self.sizes, n)
        self.ids[self.n_ids:end] = ids
        self.sizes[self.count:n] = sizes
        self.starts[self.count:n] = self.n_ids + np.cumsum(sizes) - sizes
        numbers = np.arange(self.count, n)
        self.count, self.n_ids = n, end
        return numbers

    def _encode_each(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        coded = self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False) if pieces else []
        fresh = [[self.added[p]] if p in self.added else e.ids for p, e in zip(pieces, coded)]
        sizes = np.fromiter(map(len, fresh), np.int64, len(fresh))
        return np.fromiter(chain.from_iterable(fresh), np.uint32, int(sizes.sum())), sizes

    def _encode_joined(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        coded = self.tokenizer.encode(data.tobytes().decode(), add_special_tokens=False)
        ids = np.array(coded.ids, np.uint32)
        begins = np.fromiter(chain.from_iterable(coded.offsets), np.int64, 2 * len(ids))[::2]
        letters = np.append(0, np.cumsum((data & 0xC0) != 0x80))  # offsets count characters
        owner = np.searchsorted(letters[np.cumsum(sizes) - sizes], begins, "right") - 1
        return ids, np.bincount(owner, minlength=len(sizes)).astype(np.int64)

    def _encode_words(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of letters only, without or with a space before each, as the tokenizer keeps it."""
        if self.spaceless:
            spaced = np.full(len(data) + len(sizes), 32, np.uint8)
            spaced[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = data
            data = spaced
        ids = np.array(self.words.encode_batch_fast([data.tobytes().decode()], add_special_tokens=False)[0].ids, np.uint32)
        at = np.flatnonzero(self.mark[ids])
        if len(at) != len(sizes):
            raise AssertionError("words and marked tokens differ in number")
        return ids, np.diff(at, prepend=-1) if self.spaceless else np.diff(at, append=len(ids))

    def _encode(self, data: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Numbers of the pieces at ``rows``, which are encoded now."""
        numbers = np.zeros(len(rows), np.int64)
        sizes = np.diff(offsets)[rows]
        padded = np.append(data, np.uint8(0))  # an empty piece may stand at the end
        first, last = padded[offsets[rows]], padded[np.maximum(offsets[rows + 1] - 1, 0)]
        letters = np.append(0, np.cumsum(plain_letters(data)))
        inner = letters[offsets[rows + 1]] - letters[offsets[rows]]
        white = (first == 32) | (first == 10)
        plain = (inner == sizes) if self.spaceless else (first == 32) & (inner == sizes - 1)
        plain &= (inner > 0) & (self.mark is not None)
        together = ~plain & white & (last > 32) & (last < 127) & (sizes > 1)
        for some, how in ((np.flatnonzero(plain), self._encode_words), (np.flatnonzero(together), self._encode_joined)):
            part = np.cumsum(sizes[some]) // self.JOINED
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(some)]
            for i, j in zip(cuts, cuts[1:]):
                if j > i:
                    which = some[i:j]
                    numbers[which] = self._remember(*how(data[runs(offsets[rows[which]], sizes[which])], sizes[which]))
        single = np.flatnonzero(~plain & ~together)
        numbers[single] = self._remember(*self._encode_each([data[offsets[r]:offsets[r + 1]].tobytes() for r in rows[single]]))
        return numbers

    def _added_at(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Begin and end of all added tokens, none of which spans two rows; the first from the left counts, of equals the longest."""
        blob, found = data.tobytes(), []
        for token in self.added:
            at = blob.find(token)
            while at >= 0:
                end = at + len(token)
                if np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, end - 1, "right"):
                    found.append((at, -end))
                at = blob.find(token, at + 1)
        out, free = [], 0
        for at, end in sorted(found):
            if at >= free:
                out.append((at, -end))
                free = -end
        return out

    def __call__(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after another, and the number of ids of each row; ``end_id`` closes each row."""
        added = self._added_at(data, offsets)
        if self.lower:
            data = LOWER[data]
        gap = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            letters = plain_letters(data)
            last, side = data[:-1], np.where(letters, np.uint8(1), _SIDE[data])
            gap[1:-1] = ((data[1:] == 32) | (data[1:] == 10)) & ((last > 32) & (last < 127) | letters[:-1])
            gap[1:-1] |= (side[1:] + side[:-1] == 3)
        for a, b in added:
            gap[a:b + 1] = False
            gap[[a, b]] = True
        gap = gap[:-1]
        gap[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(gap)
        rows = np.searchsorted(offsets, starts, "right") - 1
        if self.spaceless:
            out = gap & ((data == 32) | (data == 10))
            starts = starts - (np.cumsum(out) - out)[starts]
            data = data[~out]
        coded = binary_array(data, np.append(starts, len(data))).dictionary_encode()
        which, (pieces, ends) = coded.indices.to_numpy(zero_copy_only=False), binary_parts(coded.dictionary)
        short, keys = self.known.keys_of(pieces, ends)
        entry = np.full(len(ends) - 1, -1, np.int64)
        entry[short] = self.known.find(keys)
        if self.count + int((entry < 0).sum()) > self.limit:
            self._forget()
            entry[:] = -1
        new = np.flatnonzero(entry < 0)
        entry[new] = self._encode(pieces, ends, new)
        fresh = np.zeros(len(entry), bool)
        fresh[new] = True
        self.known.add(keys[fresh[short]], entry[short][fresh[short]])
        length = self.sizes[entry][which]
        counts = np.bincount(rows, weights=length, minlength=len(offsets) - 1).astype(np.int64)
        out = self.ids[runs(self.starts[entry][which], length)]
        if end_id is None:
            return out, counts
        return np.insert(out, np.cumsum(counts), np.uint32(end_id)), counts + 1


_HELD: dict = {}


def held(key, make):
    """What ``make`` built for ``key`` in this worker process; another key's goes first, so one operator's cache is held at a time."""
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _HELD[key] = make()
    return _HELD[key]


def encoder(path: str) -> Encoder:
    """The encoder of this worker process."""
    return held(("encoder", path), lambda: Encoder(path))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def parts_for(total_bytes: int, df: DataFrame, target: int = 64 << 20) -> int:
    """Partitions of about ``target`` bytes, at least as many as the session shuffles into."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total_bytes / target))


def text_volume(docs: DataFrame, text: str = "text") -> int:
    return docs.select(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]


def component_labels(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, label) for each id of the edges (a, b): the smallest id it is linked to over any number of edges.

    Alternates large-star and small-star steps, each a grouped aggregate over edges that is written to
    the shared folder, until nothing changes; that takes about log(n) steps and never more edges than
    the input has. Nulls are not allowed; an empty input has an empty result.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    e = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        # the minima are written first: both sides of the joins are then dealt anew, and the neighbours of a heavy centre can be split
        near = both(e)
        least = settle(near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = near.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = settle(large.distinct(), "large")
        # a > b in every row of large: each a's smallest b becomes the centre of its other bs
        low = settle(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = settle(small.where("a <> b").distinct(), "edges")
        state = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.bit_xor(F.xxhash64("b", "a")).alias("y")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())
