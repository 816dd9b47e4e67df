"""Repair of conversation structure by divide and conquer.

A conversation should read ``(s?(ua)+)?``: an optional system row, then user and assistant
rows in turn.  The cheapest edits that make it so keep a row (free), change its role to
user or assistant (2), delete it (3; blank and repeated rows must go) or insert an empty row
(2); a truncated row that stays costs 1.  Of equally cheap edits the ones whose initials
(D, I, K, R) come first in order are taken.

Four states say what a repaired prefix ends with: nothing, s, u or a.  Hirschberg's idea: the
cost vector of the four states, run forward over the first half, and the one run backward over
the second half meet in the middle; the best state to cross in splits the work in two.  Besides
its cost each state carries the rank of its initials among the four, which settles ties without
storing any initials, so every vector has constant size and memory is linear.

* Rows are sorted by (conversation, turn) over the whole cluster by ranges, so a conversation of
  any length is spread over tasks.  A task cuts its stretch of a conversation into blocks and
  condenses each to a 4 x 4 matrix of costs and ranks.
* The blocks of a conversation (one small matrix for thousands of rows) are crossed first;
  then every block, its first and last state known, is crossed inside, in parallel.
* Texts move once, to meet their edits, and are read as a sorted stream.

Defined cases: NULL conversation ids are one conversation; NULL turns come first; rows of one turn
are taken by role, then by a hash of the text; NULL roles and texts count as one space; roles
other than those with the initials s, u, a stay only after a change of role; an empty table gives
empty results; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumcast.staging import stage

#: Rows in a block.
BLOCK = 4096
#: Rows handed on at once.
_ROWS = 4096

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: Where an inserted (or re-roled) row leads: a user row after anything but a user row, else an assistant row.
FOLLOWING = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Kinds of rows: 0 must go; else 1 + 2 * (0 other, 1 s, 2 u, 3 a) + truncated.
MUST_GO = 0
KINDS = range(9)


def kind_of(initial: str, truncated: bool) -> int:
    return 1 + 2 * ({"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(initial, 0)) + truncated


def _allowed(state: int, following: int) -> bool:
    return following == FOLLOWING[state] or (state == NOTHING and following == SYSTEM)


@functools.cache
def _row(kind: int):
    """4 x 4 best (cost, initials) to take a row of this kind, insertions before it included."""
    best = [[None] * 4 for _ in STATES]
    for p in STATES:
        at = p
        for inserted in range(4):
            ways = [(at, 3, "D")]
            if kind != MUST_GO:
                truncated, own = (kind - 1) % 2, (kind - 1) // 2
                if own and _allowed(at, own):
                    ways.append((own, truncated, "K"))
                ways.append((FOLLOWING[at], 2 + truncated, "R"))
            for q, cost, initial in ways:
                way = (2 * inserted + cost, "I" * inserted + initial)
                best[p][q] = min(best[p][q] or way, way)
            at = FOLLOWING[at]
    return tuple(map(tuple, best))


#: After the last row: insertions until nothing or an assistant row is last.  The end is state 0.
_END = tuple((way, None, None, None) for way in ((0, ""), (4, "II"), (2, "I"), (0, "")))


def _ranked(entries: list) -> list:
    """Replace what entries (cost, comparable) compare by with its rank among them."""
    place = {c: i for i, c in enumerate(sorted({e[1] for e in entries if e}))}
    return [e and (e[0], place[e[1]]) for e in entries]


def _then(a: tuple, m: tuple, back: bool = False) -> list:
    """A vector over the states, taken through a matrix (forward), or a matrix taken to a vector (back)."""
    out = []
    for to in STATES:
        ways = []
        for via in STATES:
            x, y = (m[to][via], a[via]) if back else (a[via], m[via][to])
            if x and y:
                ways.append((x[0] + y[0], (x[1], y[1])))
        out.append(min(ways, default=None))
    return out


def forward(vector: tuple, matrix: tuple) -> tuple:
    return tuple(_ranked(_then(vector, matrix)))


def backward(vector: tuple, matrix: tuple) -> tuple:
    return tuple(_ranked(_then(vector, matrix, back=True)))


def _lowered(entries: tuple) -> tuple:
    least = min(e[0] for e in entries if e)
    return tuple(e and (e[0] - least, e[1]) for e in entries)


# Costs only matter against each other, so few vectors occur and each step is looked up.
@functools.lru_cache(1 << 16)
def _forward_row(vector: tuple, kind: int) -> tuple:
    return _lowered(forward(vector, _row(kind)))


@functools.lru_cache(1 << 16)
def _backward_row(vector: tuple, kind: int) -> tuple:
    return _lowered(backward(vector, _row(kind)))


@functools.lru_cache(1 << 16)
def _extend(flat: tuple, kind: int) -> tuple[tuple, int]:
    """16 entries, ranked together, taken through one more row; and what all costs were lowered by."""
    m = _row(kind)
    out = [e for p in STATES for e in _then(flat[4 * p:4 * p + 4], m)]
    least = min(e[0] for e in out if e)
    return tuple(e and (e[0] - least, e[1]) for e in _ranked(out)), least


def condense(kinds: bytes) -> list[int]:
    """A block as 16 costs, then 16 ranks; -1 where there is no way."""
    flat, base = tuple((0, 0) if p == q else None for p in STATES for q in STATES), 0
    for kind in kinds:
        flat, more = _extend(flat, kind)
        base += more
    return [e[0] + base if e else -1 for e in flat] + [e[1] if e else -1 for e in flat]


def _matrix(numbers: list[int]) -> tuple:
    return tuple(tuple((numbers[4 * p + q], numbers[16 + 4 * p + q]) if numbers[4 * p + q] >= 0 else None for q in STATES) for p in STATES)


def _unit(state: int) -> tuple:
    return tuple((0, 0) if s == state else None for s in STATES)


def crossings(items, start: int, end: int, ahead, back) -> list[int]:
    """State after each item, but for the last one: the least way from ``start`` to ``end``."""
    out = [end] * len(items)
    todo = [(0, len(items), start, end)]
    while todo:
        lo, hi, p, q = todo.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        f, b = _unit(p), _unit(q)
        for i in range(lo, mid):
            f = ahead(f, items[i])
        for i in range(hi - 1, mid - 1, -1):
            b = back(b, items[i])
        x = min((f[s][0] + b[s][0], f[s][1], b[s][1], s) for s in STATES if f[s] and b[s])[3]
        out[mid - 1] = x
        todo += [(lo, mid, p, x), (mid, hi, x, q)]
    return out


def initials(kinds: bytes, start: int, end: int) -> list[str]:
    """Initials of the least edits of each row of a block."""
    states = [start, *crossings(kinds, start, end, _forward_row, _backward_row)]
    return [_row(k)[p][q][1] for k, p, q in zip(kinds, states, states[1:])]


def cross_blocks(matrices: list[tuple]) -> tuple[list[int], int]:
    """State after each block of a whole conversation, and its cost."""
    items = [*matrices, _END]
    f = _unit(NOTHING)
    for m in items:
        f = forward(f, m)
    return crossings(items, NOTHING, NOTHING, forward, backward)[:-1], f[NOTHING][0]


# --- tables -------------------------------------------------------------------------

_FAULTS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint"


def prepared(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` with NULL roles and texts as one space, and ``digest`` of both."""
    rows = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"),
                       F.coalesce(text, F.lit(" ")).alias("text"))
    return rows.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))))


def kinds(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct rows of a conversation without texts: ``copies`` of each in portions of a block at
    most (``nth`` is the first one's number), ``seen`` if an earlier turn has the same, ``blank``, ``cut``."""
    bare = F.rtrim("text", F.lit(" \t\n\x0b\f\r"))
    slim = rows.select("conv_id", "turn", F.col("role"), "digest", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut")) \
        .groupBy("conv_id", "turn", "role", "digest", "blank", "cut").agg(F.count("*").alias("n"))
    several = slim.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min(F.struct("turn")).alias("least"), F.count("*").alias("m")).filter("m > 1")
    again = slim.join(several, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    later = F.col("least").isNotNull() & ~F.col("turn").eqNullSafe(F.col("least.turn"))
    portion = F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(block))).alias("nth")
    return again.withColumn("seen", later).select("conv_id", "turn", "role", "digest", "blank", "cut", "seen", "n", portion) \
        .withColumn("copies", F.least(F.lit(block), F.col("n") - F.col("nth"))).drop("n")


class _Block:
    """Rows of one conversation that follow each other in a task."""

    def __init__(self, conv, place: int):
        self.conv, self.place = conv, place
        self.kinds, self.keys = bytearray(), []
        self.faults = [0, 0, 0, 0]
        self.first = self.last = None  # initials
        self.low = self.high = self.first_turn = self.last_turn = None
        self.turns = 0

    def add(self, turn, role, digest, nth, blank, cut, seen, copies):
        initial = role[:1]
        if self.first is None:
            self.first, self.first_turn = initial, turn
        elif self.last + initial not in ("su", "ua", "au"):
            self.faults[3] += 1
        self.faults[3] += copies - 1
        if turn is not None:
            self.turns += turn != self.last_turn
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.last, self.last_turn = initial, turn
        fresh = not (blank or seen or nth)
        self.faults[0 if blank else 1] += copies - fresh
        self.faults[2] += fresh and cut
        self.kinds += bytes([kind_of(initial, cut) if fresh else MUST_GO]) + bytes([MUST_GO]) * (copies - 1)
        self.keys.append((turn, role, digest, nth, copies))

    def row(self) -> tuple:
        return (self.conv, self.place, condense(bytes(self.kinds)), *self.faults, self.first, self.last, self.low, self.high, self.first_turn, self.last_turn,
                self.turns, bytes(self.kinds), *([k[i] for k in self.keys] for i in range(5)))


def _emit(rows: Iterator[tuple], schema: pa.Schema, at_once: int = _ROWS):
    held = []
    for r in rows:
        held.append(r)
        if len(held) == at_once:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _read(batches, columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            yield from zip(*(part.column(c).to_pylist() for c in columns))


def _through(df: DataFrame, work, schema: str) -> DataFrame:
    """``work`` turns a task's rows (tuples, in order) into result rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow, names = to_arrow_schema(StructType.fromDDL(schema)), df.columns

    def kernel(batches):
        yield from _emit(work(_read(batches, names)), arrow)

    return df.mapInArrow(kernel, schema)


def blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of every conversation in order of ``place``: a matrix, counts, what the neighbours need, and the rows."""
    conv, turn = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))

    def work(stream):
        place, now = TaskContext.get().partitionId() << 32, None
        for c, turn, role, digest, blank, cut, seen, nth, copies in stream:
            if now is None or now.conv != c or len(now.kinds) + copies > block:
                if now is not None:
                    yield now.row()
                    place += 1
                now = _Block(c, place)
            now.add(turn, role, digest, nth, blank, cut, seen, copies)
        if now is not None:
            yield now.row()

    order = ["conv_id", "turn", "role", "digest", "nth"]
    sorted_rows = kinds(rows, block).repartitionByRange(*order).sortWithinPartitions(*order)
    return _through(sorted_rows.select("conv_id", "turn", "role", "digest", "blank", "cut", "seen", "nth", "copies"), work,
                    f"conv_id {conv}, place bigint, matrix array<bigint>, {_FAULTS}, first string, last string, low {turn}, high {turn}, "
                    f"first_turn {turn}, last_turn {turn}, turns bigint, kinds binary, turn array<{turn}>, role array<string>, digest array<binary>, "
                    "nth array<bigint>, copies array<bigint>")


def crossed(held: DataFrame) -> DataFrame:
    """For each block its first and last state (``start``, ``end``); for each conversation, with no ``place``, its counts,
    cost and closing insertions."""
    conv = held.schema["conv_id"].dataType.simpleString()

    def whole(c, found):
        states, cost = cross_blocks([_matrix(b[2]) for b in found])
        for b, p, q in zip(found, [NOTHING, *states], states):
            yield (c, b[1], p, q, None, None, None, None, None, None, None)
        faults = [sum(b[3 + i] for b in found) for i in range(4)]
        turns = sum(b[13] for b in found)
        for a, b in zip(found, found[1:]):
            faults[3] += a[8] + b[7] not in ("su", "ua", "au")
            turns -= a[12] is not None and a[12] == b[11]
        low = min((b[9] for b in found if b[9] is not None), default=None)
        high = max((b[10] for b in found if b[10] is not None), default=None)
        yield (c, None, None, None, high - low + 1 - turns if turns else 0, *faults, cost, _END[states[-1]][0][1])

    def work(stream):
        found = []
        for row in stream:
            if found and found[0][0] != row[0]:
                yield from whole(found[0][0], found)
                found = []
            found.append(row)
        if found:
            yield from whole(found[0][0], found)

    slim = held.select("conv_id", "place", "matrix", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "first_turn", "last_turn", "turns")
    return _through(slim.repartition("conv_id").sortWithinPartitions("conv_id", "place"), work,
                    f"conv_id {conv}, place bigint, start int, end int, gaps bigint, {_FAULTS}, cost bigint, closing string")


def edits(held: DataFrame, states: DataFrame) -> DataFrame:
    """Initials of the edits of every distinct row: ``conv_id``, ``turn``, ``role``, ``digest``, ``nth``, ``edits``."""
    conv, turn = (held.schema[c].dataType.simpleString() for c in ("conv_id", "first_turn"))

    def work(stream):
        for c, kinds, p, q, turns, roles, digests, nths, copies in stream:
            found, at = initials(kinds, p, q), 0
            for t, r, d, n, m in zip(turns, roles, digests, nths, copies):
                yield c, t, r, d, n, "".join(found[at:at + m])
                at += m

    of = states.filter("place IS NOT NULL").select("place", "start", "end")
    return _through(held.join(of, "place").select("conv_id", "kinds", "start", "end", "turn", "role", "digest", "nth", "copies"), work,
                    f"conv_id {conv}, turn {turn}, role string, digest binary, nth bigint, edits string")


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The repaired rows and one row of counts for each conversation.

    The first has ``conv_id``, ``place`` (1, 2, …), ``edit`` (D, I, K, R), ``role``, ``text`` (NULL both for deleted rows);
    a conversation's rows stand together in one partition, in order.  The second has ``conv_id``, ``gaps``, ``blank``,
    ``duplicate``, ``truncated``, ``illegal``, ``cost``.
    """
    ready = prepared(rows, conv_id, turn, role, text)
    held = stage(blocks(ready, block), "turns-blocks", compression="zstd")
    states = stage(crossed(held), "turns-states", compression="zstd")
    none = F.lit(None)
    texts = ready.select("conv_id", F.lit(0).alias("part"), "turn", "role", "digest", F.lit(-1).cast("bigint").alias("nth"), none.cast("string").alias("edits"), "text")
    changes = edits(held, states).select("conv_id", F.lit(0).alias("part"), "turn", "role", "digest", "nth", "edits", none.cast("string").alias("text"))
    closing = states.filter("place IS NULL").select("conv_id", F.lit(1).alias("part"), none.cast(ready.schema["turn"].dataType).alias("turn"),
                                                    none.cast("string").alias("role"), none.cast("binary").alias("digest"), none.cast("bigint").alias("nth"),
                                                    F.col("closing").alias("edits"), none.cast("string").alias("text"))
    order = ["conv_id", "part", "turn", "role", "digest", "nth"]
    stream = texts.union(changes).union(closing).repartition("conv_id").sortWithinPartitions(*order)

    def work(rows):
        now, place, at, words = object(), 0, NOTHING, None
        for c, role, initials, text in rows:
            if c != now:
                now, place, at = c, 0, NOTHING
            if initials is None:
                words = text
                continue
            for edit in initials:
                place += 1
                if edit == "D":
                    yield c, place, edit, None, None
                elif edit == "K":
                    at = kind_of(role[:1], False) // 2
                    yield c, place, edit, role, words
                else:
                    at = FOLLOWING[at]
                    yield c, place, edit, ROLE[at], "" if edit == "I" else words

    done = _through(stream.select("conv_id", "role", "edits", "text"), work,
                    f"conv_id {ready.schema['conv_id'].dataType.simpleString()}, place bigint, edit string, role string, text string")
    return done, states.filter("place IS NULL").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id``, ``audit`` and ``repaired_sha256`` of ``repair``'s rows, read as a stream."""
    def work(rows):
        now, some, audit, sha, lines = None, False, [], None, 0
        for c, edit, role, text in rows:
            if not some or c != now:
                if some:
                    yield now, "".join(audit), sha.hexdigest()
                now, some, audit, sha, lines = c, True, [], hashlib.sha256(), 0
            audit.append(edit)
            if edit != "D":
                sha.update((("\n" if lines else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                lines += 1
        if some:
            yield now, "".join(audit), sha.hexdigest()

    return _through(repaired.select("conv_id", "edit", "role", "text"), work,
                    f"conv_id {repaired.schema['conv_id'].dataType.simpleString()}, audit string, repaired_sha256 string")


def damaged(rows: DataFrame, faults: Column) -> DataFrame:
    """Rows with faults planted by number: 0 drops the row, 1 empties its text, 2 takes its full stops, exclamation and
    question marks away, 3 repeats it, 4 makes it a user's."""
    text = F.coalesce("text", F.lit(" "))
    rows = rows.withColumn("fault", faults).filter("fault <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")
