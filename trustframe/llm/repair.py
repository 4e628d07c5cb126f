"""Structure repair of conversations: the cheapest edits by a dynamic program that keeps costs at checkpoints only.

A row is kept, given the role user or assistant, or deleted, and rows may be inserted, so that the initials of the roles
read ``(s?(ua)+)?``. The state is what has been emitted: nothing, s, u or a. The cost vector of a place holds, for each state, the
least cost of all that follows. Going backward, only the vectors at every sqrt(n)-th row are stored; going forward, one block
at a time is computed again from its checkpoint, and the least letter that fits the costs is taken.

A conversation of any size is dealt by ranges of (turn, row): the part of a conversation in one range is a chunk. Chunks are joined by
the cost matrix (state before, state after) of each, so only conversations that cross ranges take two more, small, passes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from math import inf, isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustframe.operators.storage import settle

VISIBLE = r"[^\x20\x09-\x0D]"
#: States, and the state after an inserted or renamed row: a user's turn follows anything but a user's.
NOTHING, S, U, A = range(4)
NEXT = (U, U, A, U)
RENAME, DELETE, INSERT, UNFINISHED = 2, 3, 2, 1
#: Least costs after the last row, by state: user and assistant follow s, assistant follows u.
END = (0, 2 * INSERT, INSERT, 0)
ROLE = {U: "user", A: "assistant"}
#: Initials of adjacent roles that may follow one another.
LEGAL = ("su", "ua", "au")
Vector = tuple


def keeps(code: int, state: int) -> int | None:
    """The state after the row is kept, if it may be.

    A code is 4 x kind of the initial (s, u, a, other), 2 if the row must be deleted, 1 if it is truncated.
    """
    kind = code >> 2
    if code & 2 or kind == 3:
        return None
    if kind == 0:
        return S if state == NOTHING else None
    return NEXT[state] if NEXT[state] == (U if kind == 1 else A) else None


@lru_cache(1 << 16)
def _before(code: int, after: Vector) -> Vector:
    cost = []
    for q in range(4):
        best = DELETE + after[q]
        if not code & 2:
            best = min(best, RENAME + (code & 1) * UNFINISHED + after[NEXT[q]])
            to = keeps(code, q)
            if to is not None:
                best = min(best, (code & 1) * UNFINISHED + after[to])
        cost.append(best)
    for _ in range(2):  # two insertions lead through all states
        cost = [min(c, INSERT + cost[NEXT[q]]) for q, c in enumerate(cost)]
    return tuple(cost)


def before(code: int, after: Vector) -> Vector:
    """The cost vector before a row, from that after it."""
    low = min(after)
    return tuple(low + c for c in _before(code, tuple(c - low for c in after)))


def transfer(codes: list[int]) -> list[Vector]:
    """For each state after the rows, the least cost of getting there from each state before them."""
    found = []
    for r in range(4):
        vector = tuple(0 if q == r else inf for q in range(4))
        for code in reversed(codes):
            vector = before(code, vector)
        found.append(vector)
    return found


def through(matrix: list[Vector], end: Vector) -> Vector:
    """The cost vector before a chunk, from that after it."""
    return tuple(min(matrix[r][q] + end[r] for r in range(4)) for q in range(4))


def edits(codes: list[int], end: Vector, state: int, last: bool) -> Iterator[tuple[int, str, int]]:
    """(row, letter, state after) of the cheapest edits, of equals the ASCII-least: D, I, K, R. An insertion has row -1.

    ``end`` is the cost vector after the rows; the ``last`` chunk of a conversation also gets what must follow.
    """
    n = len(codes)
    step = isqrt(n) + 1
    marks, vector = {}, end
    for i in range(n - 1, -1, -1):
        if (i + 1) % step == 0 or i == n - 1:
            marks[i + 1] = vector
        vector = before(codes[i], vector)
    for at in range(0, n, step):
        stop = min(at + step, n)
        block = [marks[stop]]
        for i in range(stop - 1, at - 1, -1):
            block.append(before(codes[i], block[-1]))
        block.reverse()
        for i in range(at, stop):
            here, after, code = block[i - at], block[i - at + 1], codes[i]
            extra = (code & 1) * UNFINISHED
            while True:
                if DELETE + after[state] == here[state]:
                    yield i, "D", state
                elif INSERT + here[NEXT[state]] == here[state]:
                    state = NEXT[state]
                    yield -1, "I", state
                    continue
                elif (to := keeps(code, state)) is not None and extra + after[to] == here[state]:
                    state = to
                    yield i, "K", state
                else:
                    state = NEXT[state]
                    yield i, "R", state
                break
    while last and state in (S, U):
        state = NEXT[state]
        yield -1, "I", state


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which some are null."""
    renamed = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_{k}" for k in keys])


def joined(conversations: DataFrame, facts: DataFrame) -> DataFrame:
    """Conversations with what is known of them; a null conv_id finds its own."""
    return _same(conversations, facts, ["conv_id"], "left")


def cleaned(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, row): null roles and texts are one space; row names what a row holds, its place included."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    filled = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    place = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("conv_id", "turn")]
    sized = [F.length("role").cast("string"), F.col("role"), F.col("text")]
    return filled.withColumn("row", F.unhex(F.md5(F.concat_ws(":", *place, *sized).cast("binary"))))


def steps(rows: DataFrame) -> DataFrame:
    """One row per distinct (conv_id, turn, role, text), without its text, in ranges of (conv_id, turn, row).

    times: how often it occurs (the others are adjacent copies); blank, again (role and text occur earlier), unfinished; code: what edits
    depend on; part: its range.
    """
    shape = cleaned(rows).select(
        "conv_id", "turn", "row", F.substring("role", 1, 1).alias("initial"), (~F.col("text").rlike(VISIBLE)).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("unfinished"),
        F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"))).alias("said"),
    )
    one = settle(shape.groupBy(*shape.columns).agg(F.count("*").alias("times")), "turns")
    first = one.where("NOT blank").groupBy("conv_id", "said").agg(F.min(F.struct("turn", "row")).alias("first"), F.count("*").alias("n")).where("n > 1")
    marked = _same(one, settle(first.drop("n"), "repeated"), ["conv_id", "said"], "left")
    again = F.col("first").isNotNull() & ~F.struct("turn", "row").eqNullSafe(F.col("first")) & ~F.col("blank")
    kind = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    code = 4 * kind + 2 * (F.col("blank") | F.col("again")).cast("int") + F.col("unfinished").cast("int")
    order = ["conv_id", "turn", "row"]
    dealt = marked.withColumn("again", again).withColumn("code", code).drop("first", "said").repartitionByRange(*order).sortWithinPartitions(*order)
    return settle(dealt.withColumn("part", F.spark_partition_id()), "steps")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, int, pa.Table]]:
    """(conv_id, part, rows) of one chunk after the other; a chunk is bounded by its range."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        keys = list(zip(b.column("conv_id").to_pylist(), b.column("part").to_pylist()))
        at = 0
        while at < len(keys):
            if held and keys[at] != now:
                yield *now, pa.Table.from_batches(held)
                held = []
            now, end = keys[at], at + 1
            while end < len(keys) and keys[end] == now:
                end += 1
            held.append(b.slice(at, end - at))
            at = end
    if held:
        yield *now, pa.Table.from_batches(held)


KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}


def _per_chunk(rows: DataFrame, schema: str, make) -> DataFrame:
    """All that ``make`` (conv_id, part, rows of a chunk) gives, as a table of ``schema`` after conv_id, which keeps its type."""
    def run(batches):
        batches = (b for b in batches if b.num_rows)
        for b in batches:
            fields = [pa.field("conv_id", b.schema.field("conv_id").type), *[pa.field(f.split()[0], KINDS[f.split()[1]]) for f in schema.split(", ")]]
            out: list[tuple] = []
            for conv, part, table in _chunks(chain([b], batches)):
                for row in make(conv, part, table):
                    out.append((conv, *row))
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=pa.schema(fields))
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=pa.schema(fields))

    conv = rows.schema["conv_id"].dataType.simpleString()
    dealt = rows.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "row")
    return dealt.mapInArrow(run, f"conv_id {conv}, {schema}")


def _codes(table: pa.Table) -> list[int]:
    return table.column("code").to_pylist()


def _ends(conv, part, listed: pa.Table):
    """(part, end, last, joints) of each chunk of one conversation, from the chunks' matrices in order."""
    found = listed.column("chunks").to_pylist()[0]
    end, after = END, None
    for c in reversed(found):
        joint = int(after is not None and c["close"] + after not in LEGAL)
        yield c["part"], [float(v) for v in end], after is None, joint
        matrix = [tuple(c["matrix"][4 * r:4 * r + 4]) for r in range(4)]
        end, after = through(matrix, end), c["open"]


def _entries(conv, part, listed: pa.Table):
    """(part, entry): the state before each chunk of one conversation."""
    state = NOTHING
    for c in listed.column("chunks").to_pylist()[0]:
        yield c["part"], state
        state = c["exits"][state]


def _listed(chunks: DataFrame) -> DataFrame:
    """The chunks of each conversation in one row: at most as many as there are ranges."""
    entry = F.struct("part", *[c for c in chunks.columns if c not in ("conv_id", "part")])
    return chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("chunks")).select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("turn"), F.lit(0).alias("row"), "chunks")


BORDER = "part int, end array<double>, last boolean, joint int"


def borders(turns: DataFrame) -> DataFrame:
    """(conv_id, part, end, last, joint, entry) of the chunks of conversations that have more than one."""
    spread = turns.groupBy("conv_id").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b")
    crossing = settle(_same(turns, settle(spread.select("conv_id"), "crossing"), ["conv_id"], "left_semi"), "crossing")

    def matrix(conv, part, table):
        found = transfer(_codes(table))
        yield part, [float(v) for r in found for v in r], table.column("initial")[0].as_py(), table.column("initial")[-1].as_py()

    def exits(conv, part, table):
        codes, end, last = _codes(table), tuple(table.column("end")[0].as_py()), table.column("last")[0].as_py()
        out = []
        for state in range(4):
            for _, _, state in edits(codes, end, state, last):  # noqa: B020
                pass
            out.append(state)
        yield part, out

    matrices = _per_chunk(crossing, "part int, matrix array<double>, open string, close string", matrix)
    ends = settle(_per_chunk(_listed(matrices), BORDER, _ends), "ends")
    left = _per_chunk(_same(crossing, ends, ["conv_id", "part"]), "part int, exits array<int>", exits)
    entries = _per_chunk(_listed(left), "part int, entry int", _entries)
    return settle(_same(ends, entries, ["conv_id", "part"]), "borders")


def faults(turns: DataFrame, joints: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal) of each conversation of ``steps``; ``joints`` are its ``borders``."""
    order = Window.partitionBy("conv_id", "part").orderBy("turn", "row")
    pair = F.concat(F.lag("initial").over(order), F.col("initial"))
    sums = turns.withColumn("bad", F.coalesce((~pair.isin(*LEGAL)).cast("int"), F.lit(0)) + F.col("times") - 1)
    fresh = ~F.col("blank") & ~F.col("again")
    long = lambda c: F.sum(c).cast("long")
    counted = sums.groupBy("conv_id").agg(
        long(F.when(F.col("blank"), F.col("times")).otherwise(0)).alias("blank"),
        long(F.when(F.col("blank"), 0).when(F.col("again"), F.col("times")).otherwise(F.col("times") - 1)).alias("duplicate"),
        long((fresh & F.col("unfinished")).cast("int")).alias("truncated"), long("bad").alias("inside"),
    )
    across = joints.groupBy("conv_id").agg(F.sum("joint").alias("across"))
    turn = turns.where("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
    gaps = turn.groupBy("conv_id").agg((F.try_subtract(F.max("turn"), F.min("turn")) + 1 - F.count("*")).alias("gaps"))
    both = _same(_same(counted, settle(across, "across"), ["conv_id"], "left"), settle(gaps, "gaps"), ["conv_id"], "left")
    zero = F.lit(0).cast("long")
    return both.select("conv_id", F.coalesce("gaps", zero).alias("gaps"), "blank", "duplicate", "truncated", (F.col("inside") + F.coalesce("across", zero)).alias("illegal"))


def cheapest_edits(turns: DataFrame, joints: DataFrame) -> DataFrame:
    """(conv_id, part, step, row, edit, times, role, cost): the edits in order of (conv_id, part, step).

    times is more than one where adjacent copies of a row are deleted; role is that of a renamed or inserted row.
    """
    known = _same(turns, joints, ["conv_id", "part"], "left")

    def find(conv, part, table):
        rows, times, codes = (table.column(c).to_pylist() for c in ("row", "times", "code"))
        end, last, entry = (table.column(c)[0].as_py() for c in ("end", "last", "entry"))
        step = 0
        for i, letter, state in edits(codes, tuple(end) if end else END, entry or NOTHING, end is None or last):
            extra = codes[i] & 1 if i >= 0 else 0
            if letter == "D":
                yield part, step, rows[i], "D", times[i], None, DELETE * times[i]
            elif letter == "I":
                yield part, step, None, "I", 1, ROLE[state], INSERT
            else:
                yield part, step, rows[i], letter, 1, ROLE[state] if letter == "R" else None, (RENAME if letter == "R" else 0) + extra * UNFINISHED
                if times[i] > 1:
                    step += 1
                    yield part, step, rows[i], "D", times[i] - 1, None, DELETE * (times[i] - 1)
            step += 1

    return _per_chunk(known, "part int, step bigint, row binary, edit string, times bigint, role string, cost bigint", find)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faults of each conversation of (conv_id, turn, role, text), and its edits with role and text.

    The first: (conv_id, gaps, blank, duplicate, truncated, illegal), one row per conversation. The second: (conv_id, part, step, edit,
    times, cost, role, text), whose order in a conversation is (part, step); without the rows of edit D it is the repaired conversation.

    Rows are taken by turn, nulls first; rows of one turn by a hash of role and text, so equal ones are adjacent. A null conv_id
    is a conversation of its own, null roles and texts are one space. A row is blank without any character but white space, a
    duplicate if the conversation has its role and text earlier, truncated if its last such character is none of .!?; the first
    that holds counts. gaps are the missing turns between least and greatest, nulls ignored. illegal counts adjacent rows whose role initials are not su, ua or
    au. Blank rows and duplicates must go. An empty table gives two empty tables; other columns are ignored.
    """
    turns = steps(rows)
    joints = borders(turns)
    found = settle(cheapest_edits(turns, joints), "edits")
    texts = cleaned(rows).select("row", F.struct("role", "text").alias("was")).groupBy("row").agg(F.first("was").alias("was"))
    columns = ["conv_id", "part", "step", "edit", "times", "cost"]
    held = found.where("row IS NOT NULL").join(texts, "row").select(*columns, F.coalesce("role", "was.role").alias("role"), F.col("was.text").alias("text"))
    full = held.unionByName(found.where("row IS NULL").select(*columns, "role", F.lit("").alias("text")))
    return faults(turns, joints), full


def digests(edited: DataFrame) -> DataFrame:
    """(conv_id, cost, audit, repaired_sha256) of each conversation: the edits' letters, and the repaired ``role:text`` lines.

    A hash of all lines in order is one task's work per conversation; it reads them as a stream and holds only the letters.
    """
    conv = edited.schema["conv_id"].dataType.simpleString()

    def run(batches):
        now, state, kind = None, None, None

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]], kind), pa.array([state[0]], pa.int64()), pa.array(["".join(state[1])]), pa.array([state[2].hexdigest()])],
                ["conv_id", "cost", "audit", "repaired_sha256"],
            )

        for b in batches:
            kind = b.schema.field("conv_id").type
            for c, letter, times, cost, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "edit", "times", "cost", "role", "text"))):
                if now is None or now[0] != c:
                    if now is not None:
                        yield row()
                    now, state = (c,), [0, [], hashlib.sha256(), False]
                state[0] += cost
                state[1].append(letter * times)
                if letter != "D":
                    state[2].update((("\n" if state[3] else "") + f"{role}:{text}").encode())
                    state[3] = True
        if now is not None:
            yield row()

    dealt = edited.repartition("conv_id").sortWithinPartitions("conv_id", "part", "step")
    return dealt.mapInArrow(run, f"conv_id {conv}, cost bigint, audit string, repaired_sha256 string")
