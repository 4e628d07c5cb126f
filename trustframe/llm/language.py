"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustframe.llm.common import distinct_words, held, slices, split_words, text_bytes
from trustframe.operators.storage import settle

#: Longest run of bytes that the network reads from a fresh state; longer words are cut.
SPAN = 48


@dataclass
class Gated:
    """One direction. Gates z, r and the candidate n stand one below the other in w (input) and u (state)."""

    w: np.ndarray  # 3 hidden x 256: the input is one byte
    u: np.ndarray  # 3 hidden x hidden

    def forward(self, x: np.ndarray, keep: bool = False) -> tuple[list, list]:
        """x: steps x words. States per step (hidden x words), and what the way back needs."""
        n = self.u.shape[1]
        h, states, saved = np.zeros((n, x.shape[1]), np.float32), [], []
        for row in x:
            e = self.w.take(row, axis=1)
            gates = self.u[:2 * n] @ h
            gates += e[:2 * n]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r = gates[:n], gates[n:]
            c = self.u[2 * n:] @ (r * h)
            c += e[2 * n:]
            np.tanh(c, out=c)
            if keep:
                saved.append((h, z, r, c))
            h = c + z * (h - c)
            states.append(h)
        return states, saved

    def backward(self, x: np.ndarray, saved: list, above: list) -> list[np.ndarray]:
        """Gradients of w and u by backpropagation through time; above: gradients of the states per step."""
        n = self.u.shape[1]
        gw, gu = np.zeros_like(self.w), np.zeros_like(self.u)
        carry = np.zeros_like(above[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, c = saved[t]
            g = carry + above[t]
            gc = g * (1 - z) * (1 - c * c)
            gz = g * (h - c) * z * (1 - z)
            back = self.u[2 * n:].T @ gc
            gr = back * h * r * (1 - r)
            gate = np.concatenate([gz, gr])
            gu[:2 * n] += gate @ h.T
            gu[2 * n:] += gc @ (r * h).T
            np.add.at(gw.T, x[t], np.concatenate([gate, gc]).T)
            carry = g * z + back * r + self.u[:2 * n].T @ gate
        return [gw, gu]


class ByteTagger:
    """Two gated networks, one in each direction, and a softmax over the languages at each byte."""

    def __init__(self, langs: list[str], hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *s, k: (rng.standard_normal(s) * k).astype(np.float32)
        self.langs = langs
        self.ways = [Gated(draw(3 * hidden, 256, k=0.3), draw(3 * hidden, hidden, k=hidden**-0.5)) for _ in range(2)]
        self.out = draw(len(langs), 2 * hidden, k=0.1)
        self.bias = np.zeros((len(langs), 1), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [a for g in self.ways for a in (g.w, g.u)] + [self.out, self.bias]

    def _labels(self, x: np.ndarray, keep: bool = False) -> tuple:
        ahead, s1 = self.ways[0].forward(x, keep)
        back, s2 = self.ways[1].forward(x[::-1], keep)
        states = np.stack([np.concatenate([a, b]) for a, b in zip(ahead, back[::-1])])  # steps x 2 hidden x words
        scores = self.out @ states + self.bias
        scores -= scores.max(1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(1, keepdims=True)
        return scores, states, s1, s2

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of each language at each byte: steps x languages x words."""
        return self._labels(x)[0]

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Weighted cross-entropy of the positions' labels, and its gradients."""
        p, states, s1, s2 = self._labels(x, keep=True)
        hidden, words = states.shape[1] // 2, np.arange(x.shape[1])
        share = weight / (len(x) * weight.sum())
        loss = -float((np.log(p[:, y, words] + 1e-12) * share).sum())
        d = p.copy()
        d[:, y, words] -= 1
        d *= share
        below = self.out.T @ d
        ahead = self.ways[0].backward(x, s1, list(below[:, :hidden]))
        back = self.ways[1].backward(x[::-1], s2, list(below[::-1, hidden:]))
        out = np.einsum("tlw,thw->lh", d, states)
        return loss, [*ahead, *back, out, d.sum((0, 2))[:, None]]

    def fit(self, words: list[bytes], y: np.ndarray, weight: np.ndarray, epochs: int = 6, batch: int = 256, rate: float = 0.01, seed: int = 11) -> None:
        """Adam over batches of words of one length each; the rate falls to a tenth."""
        rng = np.random.default_rng(seed)
        groups = by_length(words)
        todo = [(x, rows[i:i + batch], i) for x, rows in groups for i in range(0, len(rows), batch)]
        params = self.parameters()
        m, v, step, steps = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0, epochs * len(todo)
        for _ in range(epochs):
            for k in rng.permutation(len(todo)):
                x, rows, i = todo[k]
                grads = self.gradients(x[:, i:i + batch], y[rows], weight[rows])[1]
                step += 1
                pace = rate * 0.1 ** (step / steps) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                for p, g, a, b in zip(params, grads, m, v):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= (pace * a / (np.sqrt(b) + 1e-8)).astype(np.float32)

    def word_scores(self, words: list[bytes], batch: int = 4096) -> np.ndarray:
        """Sums over its bytes of each word's log probabilities (words x languages)."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        for x, rows in by_length(words):
            for i in range(0, len(rows), batch):
                p = self.positions(np.ascontiguousarray(x[:, i:i + batch]))
                out[rows[i:i + batch]] = np.log(p + 1e-6).sum(0).T
        return out


def by_length(words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length: bytes (length x words), and the words' places in the list."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    found = []
    for rows in np.split(order, cuts):
        if len(rows) and sizes[rows[0]]:
            flat = np.frombuffer(b"".join([words[i] for i in rows]), np.uint8)
            found.append((np.ascontiguousarray(flat.reshape(len(rows), -1).T), rows))
    return found


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the network reads from a fresh state: each word, its end marked by a space, cut at ``SPAN`` bytes."""
    words, ends, rows = split_words(data, offsets)
    sizes = np.diff(ends) + 1
    marked = np.full(int(sizes.sum()), 32, np.uint8)
    marked[np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes - 1)] = words
    pieces = -(-sizes // SPAN)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    starts = np.cumsum(sizes) - sizes
    first = np.cumsum(pieces) - pieces
    begin = starts[owner] + (np.arange(len(owner)) - first[owner]) * SPAN
    return marked, np.append(begin, len(marked)), rows[owner]


def training_words(docs: DataFrame, per_lang: int = 3000, words_per_lang: int = 6000) -> DataFrame:
    """(lang, word, n) from a bounded sample of the labelled rows.

    The sample is a documented bound on labelled rows: about ``per_lang`` documents of each language by hash of the text,
    read whole; of their distinct words ``words_per_lang`` by hash. Sampled words count as often as they occur.
    """
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    unit = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sizes = settle(labelled.groupBy("lang").agg(F.count("*").alias("n")).withColumnRenamed("lang", "_lang"), "langs")
    near = labelled.join(sizes, F.col("lang") == F.col("_lang")).where(unit < F.lit(float(per_lang)) / F.col("n")).select("text", "lang")

    def count(batches):
        for b in slices(batches):
            langs = np.asarray(b.column("lang").to_pylist(), object)
            marked, ends, rows = spans(*text_bytes(b.column("text")))
            which, words = distinct_words(marked, ends)
            if len(which):
                names, codes = np.unique(langs[rows].astype(str), return_inverse=True)
                keys, n = np.unique(codes.astype(np.int64) * len(words) + which, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[keys // len(words)], pa.string()), pa.array([words[i] for i in keys % len(words)], pa.binary()), pa.array(n, pa.int64())],
                    ["lang", "word", "n"],
                )

    counted = settle(near.mapInArrow(count, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    types = settle(counted.groupBy("lang").agg(F.count("*").alias("types")).withColumnRenamed("lang", "_lang"), "types")
    drawn = F.pmod(F.xxhash64("word"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    kept = counted.join(types, F.col("lang") == F.col("_lang")).where((drawn < F.lit(float(words_per_lang)) / F.col("types")) | (F.col("n") > 200))
    return kept.select("lang", "word", "n")


def fit_tagger(docs: DataFrame, hidden: int = 16, epochs: int = 6, **sample) -> ByteTagger | None:
    """Trains on (text, lang); None if nothing is labelled."""
    table = training_words(docs, **sample).orderBy("lang", "word").toPandas()
    if not len(table):
        return None
    langs = sorted(table["lang"].unique())
    tagger = ByteTagger(langs, hidden)
    y = np.searchsorted(langs, table["lang"].to_numpy().astype(str))
    weight = np.sqrt(table["n"].to_numpy(np.float32))
    for k in range(len(langs)):  # each language weighs the same
        weight[y == k] /= weight[y == k].sum()
    weight *= len(weight) / len(langs)
    tagger.fit([bytes(w) for w in table["word"]], y, weight.astype(np.float32), epochs)
    return tagger


#: Words that stay known to a worker process.
KNOWN = 100_000


def _pooled(tagger: ByteTagger, key: str, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sums of log probabilities over all bytes of each text, and its bytes. Words stay known to the worker process."""
    cache = held(("words", key), lambda: {"known": {}, "table": np.zeros((0, len(tagger.langs)), np.float32)})
    if len(cache["known"]) > KNOWN:
        cache.update(known={}, table=cache["table"][:0])
    known, table = cache["known"], cache["table"]
    marked, ends, rows = spans(*text_bytes(column))
    which, words = distinct_words(marked, ends)
    new = [w for w in words if w not in known]
    known.update(zip(new, range(len(table), len(table) + len(new))))
    table = np.concatenate([table, tagger.word_scores(new)]) if new else table
    cache["table"] = table
    n = len(column)
    if not len(which):
        return np.zeros((n, len(tagger.langs))), np.zeros(n)
    picked = table[np.fromiter((known[w] for w in words), np.int64, len(words))][which]
    pooled = np.stack([np.bincount(rows, weights=picked[:, k], minlength=n) for k in range(picked.shape[1])], 1)
    return pooled, np.bincount(rows, weights=np.diff(ends), minlength=n)


def identify(docs: DataFrame, tagger: ByteTagger | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs, which has a text, as ``row``, then lang_pred and score.

    Every byte of every text is labelled in the context of its word. The document's probability of a language is the
    geometric mean over its bytes, normalised; the largest wins, ties go to the first name. A text that is null or
    has no letter, or a model without languages, gives ``und`` with score 0. An empty table stays empty.
    """
    import uuid

    key, langs = uuid.uuid4().hex, (tagger.langs if tagger else [])
    rows = docs.select(F.struct(*keep).alias("row"), "text")
    kind = rows.schema["row"].dataType

    def label(batches):
        for b in slices(batches):
            text = b.column("text")
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            names, score = np.full(len(text), "und", object), np.zeros(len(text))
            if langs:
                pooled, size = _pooled(tagger, key, text)
                mean = pooled / np.maximum(size, 1)[:, None]
                p = np.exp(mean - mean.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                names[letters] = np.asarray(langs, object)[best[letters]]
                score[letters] = p[np.arange(len(p)), best][letters]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(names, pa.string()), pa.array(score)], ["row", "lang_pred", "score"])

    return rows.mapInArrow(label, T.StructType().add("row", kind).add("lang_pred", "string").add("score", "double"))
