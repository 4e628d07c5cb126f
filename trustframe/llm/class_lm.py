"""Class-based n-gram model: exchange clustering, class transitions and word emissions."""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustframe.llm.common import LOWER, binary_array, held, slices, split_words, text_bytes
from trustframe.operators.storage import settle

#: Clusters; words that are exchanged among themselves first; words with counts in each task, which are all exchanged; how often at most; words of a message.
CLUSTERS, HEAD, TABLE, PASSES, PART = 32, 512, 65536, 3, 4096
#: Words seen less often keep their shape's class: they stand for the words that no text has.
SEEN = 2
#: Weight of the class distribution in a transition, and what is taken off each count of a rare word.
PRIOR, OFF = 20.0, 0.75
#: Rare words have classes by what they look like: kind of the last byte (8) and any byte beyond ASCII (2).
SHAPES = 16
_LAST = np.full(256, 7, np.uint8)
_LAST[list(b"aeiouy")] = 0
_LAST[list(b"bcdfghjklmnpqrstvwxz")] = 1
_LAST[128:] = 2
_LAST[list(b"0123456789")] = 3
_LAST[list(b",;:")] = 4
_LAST[list(b".!?")] = 5
_LAST[list(b"*#$%&@")] = 6


def shapes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The shape (below SHAPES) of each word."""
    wide = np.add.reduceat(np.append(data >= 128, False), ends[:-1], dtype=np.int64) > 0 if len(ends) > 1 else np.zeros(0, bool)
    return _LAST[data[ends[1:] - 1]].astype(np.int64) + 8 * wide


def tokens(text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(number among the distinct words, these, their shapes, row) of all words of the texts; A-Z in lower case."""
    data, offsets = text_bytes(text)
    words, ends, rows = split_words(LOWER[data], offsets)
    coded = binary_array(words, ends).dictionary_encode()
    names = coded.dictionary
    where = np.frombuffer(names.buffers()[1], np.int64)[names.offset:names.offset + len(names) + 1]
    flat = np.frombuffer(names.buffers()[2] or b"", np.uint8)
    return coded.indices.to_numpy(zero_copy_only=False), names, shapes(flat, where), rows


@dataclass
class Words:
    """The most frequent words, by falling count: bounded tables that every task holds."""

    names: list[bytes]
    counts: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __getstate__(self):
        return self.names, self.counts, self.key

    def __setstate__(self, state):
        self.names, self.counts, self.key = state

    def find(self, words: pa.Array) -> np.ndarray:
        """The place of each word, -1 if it has none."""
        names = held(("names", self.key), lambda: pa.array(self.names, pa.large_binary()))
        return pc.fill_null(pc.index_in(words, names), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def with_ends(codes: np.ndarray, rows: np.ndarray, n: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(previous, current) codes of all tokens of n texts; each text is closed by an end, which also stands before it."""
    sizes = np.bincount(rows, minlength=n)
    now = np.insert(codes, np.cumsum(sizes), end)
    return np.concatenate([[end], now[:-1]]), now


def word_counts(train: DataFrame) -> DataFrame:
    """(word, n) over all texts, without the ends; counted in the tasks before the shuffle."""
    def count(batches):
        for b in slices(batches):
            which, names, _, _ = tokens(b.column("text"))
            yield pa.RecordBatch.from_arrays([names.cast(pa.binary()), pa.array(np.bincount(which, minlength=len(names)).astype(np.int64))], ["word", "n"])

    return train.select("text").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(vocabulary: DataFrame, most: int = TABLE) -> Words:
    """At most ``most`` words: all whose count is above the lowest level at which they fit."""
    levels = vocabulary.groupBy("n").agg(F.count("*").alias("types")).orderBy(F.desc("n")).limit(most).toPandas()
    fits = levels["types"].cumsum() <= most
    if not fits.any():
        return Words([], np.zeros(0, np.int64))
    table = vocabulary.where(F.col("n") >= int(levels["n"][fits].min())).toPandas()
    table["word"] = table["word"].map(bytes)
    table = table.sort_values(["n", "word"], ascending=[False, True])
    return Words(table["word"].tolist(), table["n"].to_numpy(np.int64))


def _summed(train: DataFrame, cells: int, add) -> np.ndarray:
    """Sums over all texts of what ``add(batch)`` counts: keys below ``cells``, a bound that no corpus changes."""
    def count(batches):
        total = np.zeros(cells, np.int64)
        for b in slices(batches):
            total += np.bincount(add(b), minlength=cells)
        some = np.flatnonzero(total)
        for at in range(0, len(some), 50_000):
            part = some[at:at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["cell", "n"])

    table = train.select("text").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(cells, np.int64)
    out[table["cell"].to_numpy(np.int64)] = table["n"].to_numpy(np.int64)
    return out


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, clusters: int, passes: int = 8, rest: int = 0) -> np.ndarray:
    """Cluster of each word from its bigram counts (words x words): each word in turn moves to the cluster that gains most.

    The gain is that of the class bigram likelihood, sum f(n(c, d)) - sum f(n(c, .)) - sum f(n(., d)) with f(x) = x log x.
    The last ``rest`` codes are partners only: each stays in a class of its own after the clusters.
    """
    n = len(pairs) - rest
    label = np.append(np.arange(n) % clusters, clusters + np.arange(rest))
    pairs = pairs.astype(np.float64)
    one = np.zeros((n + rest, clusters + rest))
    one[np.arange(n + rest), label] = 1
    after, before = pairs @ one, pairs.T @ one  # of each word, its followers and its leaders by cluster
    table = one.T @ after
    for _ in range(passes):
        moved = 0
        for w in range(n):
            old, own = label[w], pairs[w, w]
            out, into = after[w].copy(), before[w].copy()
            out[old] -= own
            into[old] -= own
            table[old] -= out
            table[:, old] -= into
            table[old, old] -= own
            grow, fall = _f(table + out) - _f(table), _f(table.T + into) - _f(table.T)
            gain = grow.sum(1) + fall.sum(1) - np.diag(grow) - np.diag(fall)
            gain += _f(np.diag(table) + out + into + own) - _f(np.diag(table))
            left, right = table.sum(1) + into, table.sum(0) + out  # also what stands beside the word itself
            gain -= _f(left + out.sum() + own) - _f(left) + _f(right + into.sum() + own) - _f(right)
            new = int(gain[:clusters].argmax())
            table[new] += out
            table[:, new] += into
            table[new, new] += own
            if new != old:
                moved += 1
                label[w] = new
                for side, counts in ((after, pairs[:, w]), (before, pairs[w])):
                    side[:, old] -= counts
                    side[:, new] += counts
        if not moved:
            break
    return label[:n]


def cluster_words(
    train: DataFrame, words: Words, clusters: int = CLUSTERS, head: int = HEAD, core: int = TABLE, passes: int = PASSES
) -> np.ndarray:
    """Cluster of each of the ``core`` most frequent words: all that tasks hold, but for words seen less than ``SEEN`` times.

    Bigrams of the ``head`` words, with all other words and the ends as one more partner, are counted over all texts and clustered
    by exchange. Then all words are exchanged, the further ones joining for the first time: ``passes`` times, until hardly any moves, the texts
    are read for what stands before and after each word, by cluster (by shape where a word has none, or the end), and every word in turn
    moves to the cluster that gains most.
    """
    head = min(head, len(words.names))
    core = max(head, min(core, int(np.count_nonzero(words.counts >= SEEN))))
    if not head:
        return np.zeros(0, np.int64)
    clusters = min(clusters, head)
    top = Words(words.names[:core], words.counts[:core])
    side = head + 1  # the last code stands for all other tokens

    def bigrams(batch):
        which, names, _, rows = tokens(batch.column("text"))
        code = top.find(names)
        code[(code < 0) | (code >= head)] = head
        last, now = with_ends(code[which], rows, batch.num_rows, head)
        return last * side + now

    counts = _summed(train, side * side, bigrams).reshape(side, side)
    label = exchange(counts, clusters, rest=1)
    if core == head:
        return label
    sizes = np.array([len(w) for w in words.names[:core]])
    shape = shapes(np.frombuffer(b"".join(words.names[:core]), np.uint8), np.append(0, np.cumsum(sizes)))
    place = np.concatenate([label, clusters + shape[head:]])
    for _ in range(passes):
        before = place
        place = exchange_step(*neighbours(train, top, place, clusters), place, clusters)
        if np.count_nonzero(place != before) <= core // 100:
            break
    return place


def neighbours(train: DataFrame, top: Words, place: np.ndarray, clusters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(what follows, what leads, how often it follows itself) of each word of ``top`` over all texts.

    Followers and leaders are counted by cluster, then by shape for words without one (``place`` has either), then the end.
    """
    core, width = len(place), clusters + SHAPES + 1
    columns = 2 * width + 1

    def count(batches):
        total = np.zeros(core * columns, np.int32)
        for b in slices(batches):
            which, names, form, rows = tokens(b.column("text"))
            code = top.find(names)
            group = np.where(code >= 0, np.append(place, 0)[code], clusters + form)
            last, now = with_ends(np.where(code >= 0, code, core)[which], rows, b.num_rows, core)
            last_group, now_group = with_ends(group[which], rows, b.num_rows, width - 1)
            led, leads = now < core, last < core
            cells = [last[leads] * columns + now_group[leads], now[led] * columns + width + last_group[led], now[led & (last == now)] * columns + 2 * width]
            cell, times = np.unique(np.concatenate(cells), return_counts=True)
            total[cell] += times.astype(np.int32)
        for part in range(0, core, PART):
            some = total[part * columns:(part + PART) * columns]
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([zlib.compress(some.tobytes(), 1)], pa.binary())], ["part", "counts"])

    def add(key, table):
        total = sum(np.frombuffer(zlib.decompress(v.as_buffer()), np.int32).astype(np.int64) for v in table["counts"])
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["part", "counts"])

    schema = "part bigint, counts binary"
    found = np.zeros(core * columns, np.int64)
    for r in train.select("text").mapInArrow(count, schema).groupBy("part").applyInArrow(add, schema).collect():
        some = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
        found[r["part"] * columns:r["part"] * columns + len(some)] = some
    found = found.reshape(core, columns)
    return found[:, :width], found[:, width:-1], found[:, -1]


def exchange_step(after: np.ndarray, before: np.ndarray, own: np.ndarray, place: np.ndarray, clusters: int, block: int = 64) -> np.ndarray:
    """The place of each word when every word in turn has moved to the cluster that gains most (see ``exchange``), by falling count.

    What stands beside a word is counted by the places before the step; ``block`` words at a time meet the same clusters.
    """
    place, width = place.copy(), after.shape[1]
    after, before, own = (v.astype(np.float64) for v in (after, before, own))
    out, into = np.zeros((clusters, width)), np.zeros((clusters, width))  # bigrams that begin, and that end, in each cluster
    some = place < clusters
    np.add.at(out, place[some], after[some])
    np.add.at(into, place[some], before[some])
    old = place.copy()
    rows = np.arange(len(place))
    after[rows, old] -= own  # a word beside itself moves as one
    before[rows, old] -= own

    def move(words: np.ndarray, to: np.ndarray, sign: int, out: np.ndarray, into: np.ndarray, each: np.ndarray) -> None:
        """Words enter (1) or leave (-1) their places; ``each`` tells whose tables are meant, if every word has its own."""
        for table, a, b in ((out, after, before), (into, before, after)):
            for i, w, k in zip(each, words, to):
                mine = table[i] if table.ndim == 3 else table
                mine[:, k] += sign * b[w, :clusters]
                if k < clusters:
                    mine[k] += sign * a[w]
                    mine[k, k] += sign * own[w]

    diagonal = np.arange(clusters)
    for start in range(0, len(place), block):
        words = rows[start:start + block]
        o, i = np.repeat(out[None], len(words), axis=0), np.repeat(into[None], len(words), axis=0)
        move(words, place[words], -1, o, i, np.arange(len(words)))
        a, b = after[words][:, None, :], before[words][:, None, :]
        grow, fall = _f(o + a) - _f(o), _f(i + b) - _f(i)
        gain = grow.sum(2) + fall.sum(2) - grow[:, diagonal, diagonal] - fall[:, diagonal, diagonal]
        mid = o[:, diagonal, diagonal]
        gain += _f(mid + a[:, 0, :clusters] + b[:, 0, :clusters] + own[words][:, None]) - _f(mid)
        left, right = o.sum(2) + b[:, 0, :clusters], i.sum(2) + a[:, 0, :clusters]
        gain -= _f(left + (a.sum(2) + own[words][:, None])) - _f(left) + _f(right + (b.sum(2) + own[words][:, None])) - _f(right)
        new = gain.argmax(1)
        moved = np.flatnonzero(new != place[words])
        move(words[moved], place[words[moved]], -1, out, into, moved)
        move(words[moved], new[moved], 1, out, into, moved)
        place[words] = new
    return place


@dataclass
class ClassModel:
    """All that a task needs to score: bounded by CLUSTERS, SHAPES and TABLE. Class 0 is the end of a text."""

    words: Words
    classes: np.ndarray  # of the frequent words
    ends: int  # training texts
    total: int  # training tokens, ends among them
    types: int
    steps: np.ndarray  # log10 P(class | previous class)
    tokens_of: np.ndarray  # training tokens of each class
    types_of: np.ndarray

    @property
    def first_shape(self) -> int:
        return len(self.tokens_of) - SHAPES

    def emission(self, count, cls):
        """log10 P(word | class). The classes of shapes keep OFF of each word's count for unknown words, as one event."""
        all_of, kinds = self.tokens_of[cls], self.types_of[cls]
        rare = cls >= self.first_shape
        known = np.where(rare, (count - OFF) / (all_of + 1), count / np.maximum(all_of, 1))
        return np.log10(np.where(count > 0, np.maximum(known, 1e-300), (OFF * kinds + 1) / (all_of + 1)))


def class_codes(model_words: Words, classes: np.ndarray, first_shape: int, names: pa.Array, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place among the frequent words or -1, class) of words."""
    place = model_words.find(names)
    return place, np.where(place >= 0, np.append(classes, 0)[place], first_shape + shape)


def fit(train: DataFrame, vocabulary: DataFrame, clusters: int = CLUSTERS) -> ClassModel:
    """Learns from all texts of ``train``; vocabulary is its ``word_counts``, written."""
    words = frequent(vocabulary)
    label = cluster_words(train, words, clusters)
    first_shape = 1 + clusters
    sizes = np.diff(np.append(0, np.cumsum([len(w) for w in words.names]))) if words.names else np.zeros(0, np.int64)
    flat = np.frombuffer(b"".join(words.names), np.uint8)
    shape = shapes(flat, np.append(0, np.cumsum(sizes)).astype(np.int64)) if words.names else np.zeros(0, np.int64)
    classes = np.concatenate([label + 1, first_shape + shape[len(label):]])
    n_classes = first_shape + SHAPES

    def steps(batch):
        which, names, form, rows = tokens(batch.column("text"))
        code = class_codes(words, classes, first_shape, names, form)[1]
        last, now = with_ends(code[which], rows, batch.num_rows, 0)
        return last * n_classes + now

    pairs = _summed(train, n_classes * n_classes, steps).reshape(n_classes, n_classes).astype(np.float64)

    def kinds(batches):
        for b in batches:
            data = b.column("word").cast(pa.large_binary())
            where = np.frombuffer(data.buffers()[1], np.int64)[data.offset:data.offset + len(data) + 1]
            form = shapes(np.frombuffer(data.buffers()[2] or b"", np.uint8), where)
            code = class_codes(words, classes, first_shape, data, form)[1]
            some, types = np.unique(code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(types)], ["class", "types"])

    table = vocabulary.select("word").mapInArrow(kinds, "class bigint, types bigint").groupBy("class").agg(F.sum("types").alias("types")).toPandas()
    types_of = np.zeros(n_classes, np.int64)
    types_of[table["class"].to_numpy(np.int64)] = table["types"].to_numpy(np.int64)
    tokens_of = pairs.sum(0)
    ends = int(tokens_of[0])
    types_of[0] = ends > 0
    share = (tokens_of + 1) / (tokens_of.sum() + n_classes)
    moves = np.log10((pairs + PRIOR * share) / (pairs.sum(1, keepdims=True) + PRIOR))
    return ClassModel(words, classes, ends, int(tokens_of.sum()), int(types_of.sum()), moves, tokens_of, types_of)


def score(docs: DataFrame, keep: list[str], model: ClassModel, vocabulary: DataFrame) -> DataFrame:
    """Adds n_tokens, n_known, train_tokens, base_score and score to the columns ``keep`` of docs (with a text).

    Each text is lower-cased (A-Z), cut at white space and closed by an end; null is an empty text. score is the sum of
    log10 P(class | previous class) + log10 P(word | class), where an unknown word counts as one event in the class of
    its shape. Frequent words are looked up in the task; of all others (row, word, class, number) go to the vocabulary
    by a join, and come back as three sums for each row. Without training texts everything is unknown.
    """
    rows = docs.select(F.struct(*keep).alias("row"), "text")
    base_of = lambda c: np.log10((c + 1) / (model.total + model.types + 1))
    schema = T.StructType().add("row", rows.schema["row"].dataType)
    for name, kind in (("rid", "long"), ("word", "binary"), ("class", "integer"), ("n", "long"), ("n_known", "long"), ("base", "double"), ("score", "double")):
        schema.add(name, kind)

    def local(batches):
        for b in slices(batches):
            which, names, form, doc = tokens(b.column("text"))
            n = b.num_rows
            place, code = class_codes(model.words, model.classes, model.first_shape, names, form)
            last, now = with_ends(code[which], doc, n, 0)
            count = np.append(model.words.counts, 0)[place]
            sizes = np.bincount(doc, minlength=n)
            closing = np.full(n, model.ends)
            total = np.bincount(np.repeat(np.arange(n), sizes + 1), weights=model.steps[last, now], minlength=n)
            frequent_word = place >= 0
            per_word = np.where(frequent_word, model.emission(count, code), 0.0)
            total += np.bincount(doc, weights=per_word[which], minlength=n) + model.emission(closing, np.zeros(n, np.int64))
            base = np.bincount(doc, weights=np.where(frequent_word, base_of(count), 0.0)[which], minlength=n) + base_of(closing)
            known = np.bincount(doc, weights=frequent_word[which], minlength=n).astype(np.int64) + (closing > 0)
            rare = ~frequent_word[which]
            key, times = np.unique(doc[rare] * max(len(names), 1) + which[rare], return_counts=True)
            owner, word = key // max(len(names), 1), key % max(len(names), 1)
            rid, m = b.column("rid"), len(key)
            nothing = lambda k, t: pa.nulls(k, t)
            types = [f.type for f in b.schema]
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), rid, nothing(n, pa.binary()), nothing(n, pa.int32()), pa.array(sizes + 1), pa.array(known), pa.array(base), pa.array(total)],
                ["row", "rid", "word", "class", "n", "n_known", "base", "score"],
            )
            if m:
                yield pa.RecordBatch.from_arrays(
                    [nothing(m, types[0]), rid.take(pa.array(owner)), names.take(pa.array(word)).cast(pa.binary()), pa.array(code[word], pa.int32()), pa.array(times), nothing(m, pa.int64()), nothing(m, pa.float64()), nothing(m, pa.float64())],
                    ["row", "rid", "word", "class", "n", "n_known", "base", "score"],
                )

    numbered = rows.withColumn("rid", F.monotonically_increasing_id())
    parts = settle(numbered.mapInArrow(local, schema), "scored")
    floats = lambda a: F.array(*[F.lit(float(x)) for x in a])
    per_class = lambda a: F.element_at(floats(a), F.col("class") - model.first_shape + 1)
    rare = parts.where("word IS NOT NULL").select("rid", "word", "class", "n")
    found = rare.join(vocabulary.select("word", F.col("n").alias("c")), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    own, types = per_class(model.tokens_of[model.first_shape:]), per_class(model.types_of[model.first_shape:])
    emitted = F.log10(F.when(F.col("c") > 0, F.col("c") - OFF).otherwise(types * OFF + 1) / (own + 1))
    based = F.log10((F.col("c") + 1) / F.lit(float(model.total + model.types + 1)))
    n: Column = F.col("n")
    sums = found.groupBy("rid").agg(
        F.sum(F.when(F.col("c") > 0, n).otherwise(0)).alias("more_known"), F.sum(n * based).alias("more_base"), F.sum(n * emitted).alias("more_score"),
    )
    return parts.where("word IS NULL").join(sums, "rid", "left").select(
        "row.*", F.col("n").alias("n_tokens"), (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


def class_scores(train: DataFrame, docs: DataFrame, keep: list[str]) -> DataFrame:
    """Learns the class model from ``train`` and scores ``docs``; see ``score``."""
    vocabulary = settle(word_counts(train), "vocabulary")
    return score(docs, keep, fit(train, vocabulary), vocabulary)
