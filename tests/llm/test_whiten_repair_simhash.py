"""Whitening, conversation repair and SimHash components against brute force, and their edge rows."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trustframe.llm import queries, repair, simhash, whitening

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, row string, part int, kind string, times int, vec_id long, end string"
VECTORS = "vec_id long, x array<bigint>, i int, n long, v string, part int"


@pytest.fixture
def ranges(spark):
    """Keeps small ranges apart, so that conversations cross them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# ---- whitening


def whitened(rows, kept=32):
    x = np.array(rows, np.int64)
    n, moved = len(x), len(x) * x - x.sum(0)
    c = moved / n
    value, vector = np.linalg.eigh(c.T @ c / n)
    value, vector = value[::-1][:kept], vector[:, ::-1][:, :kept]
    return (moved**2).sum(1), c @ (vector / np.sqrt(value)), value / np.trace(c.T @ c / n)


def test_whitening_is_that_of_numpy(spark):
    got = queries.op11_whitening(spark, SF).toPandas()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    dev, want, share = whitened(np.floor(64 * np.stack(rows.embedding).astype(float)).astype(np.int64) + 1000000)
    assert len(got) == 32 * len(rows) and (got.n == len(rows)).all() and got.identity_error.max() < 1e-9
    assert (got.deviation == got.vec_id.map(dict(zip(rows.vec_id, dev)))).all()
    found = got.pivot(index="vec_id", columns="component", values="whitened").loc[rows.vec_id].to_numpy()
    assert np.abs(found * np.sign((found * want).sum(0)) - want).max() < 1e-9
    assert np.allclose(got.groupby("component").explained.first(), share, rtol=1e-9)


def test_whitening_edges(spark):
    def run(rows):
        return whitening.whiten(spark.createDataFrame([(i, x, 1, 2, "v", 3) for i, x in rows], VECTORS)).collect()

    assert run([]) == [] and run([(1, None), (2, [])]) == [] and run([(1, [5, 5]), (2, [5, 5])]) == []
    got = run([(1, [5, 5]), (2, [5, 8]), (None, [5, 1]), (3, [1]), (2, [5, 8]), (4, None)])
    assert sorted((r.vec_id or 0, r.component, r.n, r.deviation) for r in got) == [(0, 1, 4, 324), (1, 1, 4, 4), (2, 1, 4, 100), (2, 1, 4, 100)]
    scaled = spark.sql("select 1 k, array(float(0.5), float(-0.01)) e union all select 2, array(float('nan')) union all select 3, array(float('inf')) union all select 4, array(null) union all select 5, null")
    assert sorted((r.k, r.x) for r in scaled.select("k", whitening.scaled(F.col("e")).alias("x")).where("x is not null").collect()) == [(1, [1000032, 999999])]


def test_whitening_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "NUMBERS", 21)
    monkeypatch.setattr(whitening, "COLUMNS", 3)
    monkeypatch.setattr(whitening, "MIDDLE", 2)
    x = np.random.default_rng(4).integers(0, 900, (60, 8)) + 10**6
    frame = spark.createDataFrame([(i, v.tolist(), 0, 0, "", 0) for i, v in enumerate(x)], VECTORS).repartition(5)
    got = whitening.whiten(frame, 5).toPandas()
    dev, want, _ = whitened(x, 5)
    found = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(found * np.sign((found * want).sum(0)) - want).max() < 1e-9 and got.identity_error.max() < 1e-9
    assert (got.deviation == dev[got.vec_id]).all()


# ---- conversation repair


def damage(rows):
    text, out = lambda v: " " if v is None else str(v), []
    for conv, turn, role, words in rows:
        role, words, kind = text(role), text(words), zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        words = "" if kind == 1 else re.sub("[.!?]", "", words) if kind == 2 else words
        out += [(conv, turn, "user" if kind == 4 else role, words)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """Shortest path over (row, state) with the letters as second key: cost, letters, hash, faults."""
    seen, info, count = set(), [], [0, 0, 0]
    for role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        again = bool(visible) and (role, text) in seen
        open_ = bool(visible) and not again and visible[-1] not in ".!?"
        seen.add((role, text))
        count = [count[0] + (not visible), count[1] + again, count[2] + open_]
        info.append((role, text, not visible or again, open_))
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    then, word = {"": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user:", "a": "assistant:"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, letters, i, q, out = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(info) and q in ("", "a"):
            return *count, illegal, cost, letters, hashlib.sha256("\n".join(out).encode()).hexdigest()
        heapq.heappush(heap, (cost + 2, letters + "I", i, then[q], (*out, word[then[q]])))
        if i < len(info):
            role, text, gone, open_ = info[i]
            heapq.heappush(heap, (cost + 3, letters + "D", i + 1, q, out))
            if not gone:
                heapq.heappush(heap, (cost + 2 + open_, letters + "R", i + 1, then[q], (*out, word[then[q]] + text)))
                if role[:1] == then[q] or (role[:1] == "s" and q == ""):
                    heapq.heappush(heap, (cost + open_, letters + "K", i + 1, role[:1], (*out, f"{role}:{text}")))


def repaired(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[0]]
    for r in sorted(damage(rows), key=lambda r: (r[1] is not None, r[1] or 0)):
        by[r[0]].append(r)
    out = {}
    for conv, some in by.items():
        turns = {r[1] for r in some} - {None}
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *cheapest([r[2:] for r in some]))
    return out


def found(frame):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in frame.collect()}


def test_repair_is_the_shortest_path(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert found(queries.op12_checkpointed_repair(spark, "/root/testdata/sf0.01")) == repaired([tuple(r) for r in rows])


def test_repair_of_a_conversation_in_many_ranges(spark, ranges, tmp_path):
    random.seed(1)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None], ["a.", "b?", "c", "", " x! ", "d\n", None]
    rows = [(7, t, random.choice(roles), random.choice([*texts, f"t{t}.", f"t{t}.", f"t{t}"])) for t in range(900)]
    rows += [(None, t, "user", f"{t}.") for t in (1, 2, None)] + [(8, None, "assistant", "x."), (9, 4, "system", "long " * 50_000)]
    rows += [(10, 5, "user", "same")] * 40
    random.shuffle(rows)
    frame = spark.createDataFrame([(*r, "x", 1, "k", 2, 3, "e") for r in rows], TURNS)
    frame.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    assert found(queries.op12_checkpointed_repair(spark, str(tmp_path))) == repaired(rows)
    turns = repair.steps(queries.damaged(frame))
    assert turns.where("conv_id = 7").select("part").distinct().count() > 1 and repair.borders(turns).count() > 1


def test_repair_edges(spark, tmp_path):
    spark.createDataFrame([], TURNS).write.parquet(f"{tmp_path}/a/conversations.parquet")
    assert queries.op12_checkpointed_repair(spark, f"{tmp_path}/a").count() == 0
    gone = next(c for c in range(99) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 1, "user", "x", "", 0, "", 0, 0, "")], TURNS).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert found(queries.op12_checkpointed_repair(spark, f"{tmp_path}/b")) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_checkpoints_do_not_change_the_edits():
    random.seed(3)
    for _ in range(200):
        codes = [random.randrange(16) for _ in range(random.randrange(40))]
        whole = list(repair.edits(codes, repair.END, repair.NOTHING, True))
        cut = random.randrange(len(codes) + 1)
        end = repair.through(repair.transfer(codes[cut:]), repair.END)
        first = list(repair.edits(codes[:cut], end, repair.NOTHING, False))
        state = first[-1][2] if first else repair.NOTHING
        rest = [(i + cut if i >= 0 else i, a, s) for i, a, s in repair.edits(codes[cut:], repair.END, state, True)]
        assert first + rest == whole


# ---- SimHash


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    x = np.array([p for _, p in prints], np.uint64)
    near, label = np.bitwise_count(x[:, None] ^ x) <= 4, np.arange(len(x))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    least = {k: min((d for (d, _), r in zip(prints, label) if r == k and d is not None), default=None) for k in set(label.tolist())}
    return sorted(((d, f"{p:016x}", least[r]) for (d, p), r in zip(prints, label)), key=str)


DOCS = "doc_id long, text string, fp long, root string, component_id int, a int"


def test_simhash_is_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(-5, None), (900_001, ""), (900_002, " \n"), (900_003, "One"), (900_004, "one"), (900_004, "one"), (None, "one"), (None, "a b c d e f g"), (2**63 - 1, "é b"), (900_005, "w " * 120_000)]
    rows = [(d, (t or "") if d != -5 else None) for d, t in rows]
    frame = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], DOCS)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_components(frame).collect()), key=str)
    assert got == components([(d, fingerprint(t)) for d, t in rows])
    assert simhash.near_components(frame.limit(0)).count() == 0


def test_simhash_links_of_large_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(9)
    seeds = rng.integers(0, 1 << 64, 12, dtype=np.uint64)
    many = {int(s) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for s in seeds for _ in range(60)} | {0, (1 << 64) - 1}
    x = np.array(sorted(many), np.uint64)
    edges = simhash.links(spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")).collect()
    label = {int(v): int(v) for v in x.view(np.int64)}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v

    for a, b in edges:
        label[root(a)] = root(b)
    want = components([(int(v), int(v)) for v in x])
    assert len({root(v) for v in label}) == len({c for _, _, c in want})
    assert [len(simhash.cell_masks(n)) for n in (10, 1 << 22, 1 << 31, 1 << 40)] == [5, 15, 35, 70]


def test_pivots_discard_no_link():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 64, 4000, dtype=np.uint64)
    b = a.copy()
    b[:2000] ^= np.array([sum(1 << int(i) for i in rng.choice(64, 4, replace=False)) for _ in range(2000)], np.uint64)
    b[2000:] = rng.permutation(b[2000:])
    table = np.bitwise_count(np.append(a, b)[:, None] ^ simhash._PIVOTS).astype(np.int16)
    left = simhash.survivors(np.arange(4000), np.arange(4000, 8000), table)
    assert set(range(2000)) <= set(left.tolist()) and (left >= 2000).mean() < 0.01
