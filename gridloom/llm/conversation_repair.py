"""Conversation repair by Wagner-Fischer alignment of turns to an alternating grammar.

A sound conversation is empty, or reads ``(s?(ua)+)`` in the initials of its roles: an optional system
turn, then user and assistant in turn.  The turns of a conversation are aligned to the grammar's string
of each feasible length by Wagner-Fischer tables; a quick feasible repair gives the incumbent cost, and
with it the Ukkonen band outside which no cell can lie on a cheaper alignment.  Every target of least
cost is traced back to its audit, the string of edit initials, and the least audit wins.

Rows are sorted by range over (conversation, turn).  A conversation inside one range and of at most
``SEGMENT`` turns is repaired where it lies.  Others are cut into segments: a segment is aligned from
every grammar state to every other, and the segments of a conversation are folded in order, so a
conversation that holds most rows is aligned by many tasks.  Only its digest, which is sequential by
its nature, is one stream, of bounded memory but for the audit that it returns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gridloom.llm.text import require
from gridloom.session import cut_lineage

KEEP, REROLE, DELETE, INSERT, MEND = 0, 3, 4, 3, 3
SEGMENT = 512
#: Turns that a task gathers before it aligns them together, and bytes of their text.
GATHER, GATHER_BYTES = 4096, 8 << 20
WHITE_SPACE = "\\x20\\x09-\\x0D"
HIGH = np.int32(1 << 28)
OTHER, SYSTEM, USER, ASSISTANT = range(4)
#: Grammar states: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
ACCEPT = (START, AFTER_A)
LETTERS = np.frombuffer(b"DIKR", np.uint8)


def damage(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` damaged by ``crc32(conv_id:turn) % 20``.

    0 drops the row (kept as ``gone``, so that the conversation is still known), 1 empties its text, 2
    removes ``.!?`` from it, 3 repeats it (``copy`` 1), 4 sets its role to user.  Null ids, turns, roles
    and texts count as one space.  Other columns are left out.
    """
    require(conversations, "conv_id", "turn", "role", "text")

    def words(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(words("conv_id"), F.lit(":"), words("turn"))) % 20
    rows = conversations.select("conv_id", "turn", words("role").alias("role"), words("text").alias("text"), fate.alias("_fate"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("_fate") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("_fate") <= 1, F.lit("")).when(F.col("_fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("_fate") == 0).alias("gone"),
        F.explode(F.when(F.col("_fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


# --- alignment ------------------------------------------------------------------


@dataclass
class Turns:
    """Equally long lists of turns, one list per row: role codes, and the costs of keeping and reroling."""

    role: np.ndarray
    keep: np.ndarray
    rerole: np.ndarray

    @staticmethod
    def of(role: np.ndarray, dead: np.ndarray, cut: np.ndarray) -> Turns:
        mend = np.where(cut, MEND, 0)
        keep = np.where(dead, HIGH, KEEP + mend).astype(np.int32)
        return Turns(role, keep, np.where(dead, HIGH, REROLE + mend).astype(np.int32))


def incumbent(t: Turns) -> np.ndarray:
    """Cost of a feasible repair of each list: turn by turn, keep what fits, else rerole or delete, close at the end."""
    n, k = t.role.shape
    state, cost = np.full(n, START), np.zeros(n, np.int64)
    for i in range(k):
        role = t.role[:, i]
        due = np.where(state == AFTER_U, ASSISTANT, USER)
        fits = ((role == due) | ((role == SYSTEM) & (state == START))) & (t.keep[:, i] < HIGH)
        change = ~fits & (t.rerole[:, i] <= DELETE)
        cost += np.where(fits, t.keep[:, i], np.where(change, t.rerole[:, i], DELETE))
        state = np.where(fits & (role == SYSTEM), AFTER_S, np.where(fits | change, due, state))
    return cost + np.select([state == AFTER_U, state == AFTER_S], [INSERT, 2 * INSERT], 0)


class Table:
    """Wagner-Fischer costs of aligning the turns from ``i`` on to the last ``r`` roles of a grammar string that ends in ``last``.

    The strings of all lengths that end alike share one table.  ``cost[i]`` holds all lists and every r;
    cells outside the band of ``width`` around the diagonal are not computed.
    """

    def __init__(self, t: Turns, last: int, width: int):
        n, k = t.role.shape
        self.t, self.last, self.k, self.size = t, last, k, k + width + 1
        r = np.arange(self.size, dtype=np.int32)
        self.due = np.where(r % 2 == 1, last, USER + ASSISTANT - last)
        self.cost = np.full((k + 1, n, self.size), HIGH, np.int32)
        self.cost[k, :, : width + 1] = INSERT * r[: width + 1]
        for i in range(k - 1, -1, -1):
            a, b = max(0, k - i - width), min(self.size, k - i + width + 1)
            below = self.cost[i + 1]
            base = below[:, a:b] + DELETE
            c = max(a, 1)
            fit = np.where(t.role[:, i, None] == self.due[None, c:b], t.keep[:, i, None], t.rerole[:, i, None])
            base[:, c - a :] = np.minimum(base[:, c - a :], below[:, c - 1 : b - 1] + fit)
            slope = INSERT * r[a:b]
            self.cost[i, :, a:b] = np.minimum(np.minimum.accumulate(base - slope, axis=1) + slope, HIGH)
        # The same with a system turn in front, which only a kept system turn can be.
        self.led = np.full((k + 1, n, self.size), HIGH, np.int32)
        for i in range(k - 1, -1, -1):
            first = np.where(t.role[:, i] == SYSTEM, t.keep[:, i], HIGH)[:, None]
            self.led[i] = np.minimum(np.minimum(self.led[i + 1] + DELETE, self.cost[i + 1] + first), HIGH)

    def trace(self, row: np.ndarray, led: np.ndarray, r: np.ndarray) -> list[bytes]:
        """The least audit of each alignment: list ``row`` to ``r`` roles, with or without a system turn in front."""
        row, led, r, i = row.copy(), led.copy(), r.copy(), np.zeros(len(row), np.int64)
        out = np.zeros((len(row), self.k + self.size), np.uint8)
        at = np.arange(len(row))
        t, k, step = self.t, self.k, 0
        while True:
            live = (i[at] < k) | (r[at] > 0) | led[at]
            at = at[live]
            if not len(at):
                return [bytes(x[x > 0]) for x in out]
            w, x, y, s = row[at], i[at], r[at], led[at]
            here = np.where(s, self.led[x, w, y], self.cost[x, w, y])
            more = x < k
            nx, py = np.minimum(x + 1, k), np.maximum(y - 1, 0)
            delete = more & (np.where(s, self.led[nx, w, y], self.cost[nx, w, y]) + DELETE == here)
            insert = ~delete & ~s & (y > 0) & (self.cost[x, w, py] + INSERT == here)
            keep_cost = t.keep[w, np.minimum(x, k - 1)] if k else np.full(len(x), HIGH)
            role = t.role[w, np.minimum(x, k - 1)] if k else np.zeros(len(x), np.int64)
            rest = np.where(s, self.cost[nx, w, y], self.cost[nx, w, py])
            fits = np.where(s, role == SYSTEM, (role == self.due[y]) & (y > 0))
            keep = ~delete & ~insert & more & fits & (rest + keep_cost == here)
            out[at, step] = LETTERS[np.select([delete, insert, keep], [0, 1, 2], 3)]
            i[at] = np.where(insert, x, x + 1)
            r[at] = np.where(delete | s, y, y - 1)
            led[at] = s & delete
            step += 1


def targets(entry: int, leave: int, size: int) -> list[tuple[bool, int]]:
    """(system turn in front, number of further roles) of the strings that lead from one state to another."""
    n = range(size)
    if leave == START:
        return [(False, 0)] if entry == START else []
    if leave == AFTER_S:
        return [(False, 0)] if entry == AFTER_S else [(True, 0)] if entry == START else []
    if entry in (AFTER_U, AFTER_A):
        return [(False, r) for r in n if r % 2 == (entry != leave)]
    odd = leave == AFTER_U
    plain = [(False, r) for r in n if r > 0 and r % 2 == odd]
    return plain + ([(True, r) for _, r in plain] if entry == START else [])


def align(t: Turns, pairs: list[tuple[int, int]], slack: int = 0) -> dict[tuple[int, int], list[tuple[int, bytes] | None]]:
    """Least cost and least audit of each list, for each (state before, state after); None if there is none."""
    n = t.role.shape[0]
    width = int(incumbent(t).max(initial=0)) // min(INSERT, DELETE) + slack
    tables = {last: Table(t, last, width) for last in ({USER} if any(b == AFTER_U for _, b in pairs) else set()) | {ASSISTANT}}
    out: dict[tuple[int, int], list[tuple[int, bytes] | None]] = {}
    for pair in pairs:
        table = tables[USER if pair[1] == AFTER_U else ASSISTANT]
        aims = targets(*pair, table.size)
        best: list[tuple[int, bytes] | None] = [None] * n
        if aims:
            led, r = np.array([a for a, _ in aims]), np.array([b for _, b in aims])
            cost = np.where(led, table.led[0][:, r], table.cost[0][:, r])
            least = cost.min(axis=1)
            row, which = np.nonzero((cost == least[:, None]) & (least < HIGH)[:, None])
            for x, audit in zip(row, table.trace(row, led[which], r[which])):
                if best[x] is None or audit < best[x][1]:
                    best[x] = (int(least[x]), audit)
        out[pair] = best
    return out


ALL_PAIRS = [(a, b) for a in range(4) for b in range(4) if targets(a, b, 3)]
WHOLE = [(START, b) for b in ACCEPT]


def replay(audit: bytes, roles: list[str], texts: list[str], state: int) -> list[str]:
    """``role:text`` of the turns that an audit leaves, from a grammar state."""
    out, i = [], 0
    for letter in audit.decode():
        if letter == "D":
            i += 1
            continue
        due = "assistant" if state == AFTER_U else "user"
        if letter == "K" and roles[i][:1] == "s":
            state = AFTER_S
        else:
            state = AFTER_U if due == "user" else AFTER_A
        if letter == "I":
            out.append(f"{due}:")
            continue
        out.append(f"{roles[i] if letter == 'K' else due}:{texts[i]}")
        i += 1
    return out


# --- rows into segments ---------------------------------------------------------


@dataclass
class Segment:
    """Consecutive turns of one conversation, and what must be known of them to join them to the next."""

    conv: object
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    faults: list[int] = field(default_factory=list)
    turns: list[int | None] = field(default_factory=list)
    bytes: int = 0

    def counts(self) -> list[int]:
        """blank, duplicate, truncated, adjacent pairs that the grammar does not have, distinct turns."""
        first = [self.faults.count(x) for x in (1, 2, 3)]
        initials = [x[:1] for x in self.roles]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        known = [x for x in self.turns if x is not None]
        return [*first, illegal, sum(a != b for a, b in zip(known, known[1:])) + bool(known)]

    @property
    def span(self) -> tuple[int | None, int | None]:
        known = [x for x in self.turns if x is not None]
        return (known[0], known[-1]) if known else (None, None)


CODES = {"s": SYSTEM, "u": USER, "a": ASSISTANT}


def align_segments(segments: list[Segment], pairs: list[tuple[int, int]], slack: int) -> list[dict[tuple[int, int], tuple[int, bytes]]]:
    """``align`` of segments of any lengths: those of one length together."""
    out: list[dict[tuple[int, int], tuple[int, bytes]]] = [{} for _ in segments]
    by_length: dict[int, list[int]] = {}
    for x, s in enumerate(segments):
        by_length.setdefault(len(s.roles), []).append(x)
    for k, members in by_length.items():
        # Tables of one call stay below some tens of MB.
        room = max(1, (2 << 20) // ((k + 1) * (2 * k + 8)))
        for at in range(0, len(members), room):
            pick = members[at : at + room]
            role = np.array([[CODES.get(x[:1], OTHER) for x in segments[m].roles] for m in pick], np.int64).reshape(len(pick), k)
            fault = np.array([segments[m].faults for m in pick], np.int64).reshape(len(pick), k)
            found = align(Turns.of(role, (fault == 1) | (fault == 2), fault == 3), pairs, slack)
            for pair, best in found.items():
                for m, b in zip(pick, best):
                    if b is not None:
                        out[m][pair] = b
    return out


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, repaired string"
OPEN = "part int, place long, roles array<string>, texts array<string>, counts array<long>, low long, high long, moves array<struct<a: int, b: int, cost: long, audit: string>>"


def _finish(s: Segment, moves: dict[tuple[int, int], tuple[int, bytes]], with_text: bool) -> tuple:
    cost, audit = min(moves[p] for p in WHOLE if p in moves)
    text = "\n".join(replay(audit, s.roles, s.texts, START))
    blank, duplicate, truncated, illegal, distinct = s.counts()
    low, high = s.span
    gaps = 0 if low is None else high - low + 1 - distinct
    digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
    return gaps, blank, duplicate, truncated, illegal, cost, audit.decode(), digest, text if with_text else None


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Segment, bool, bool]]:
    """Segments of the sorted rows, each with: begins a run of its conversation, ends it."""
    now: Segment | None = None
    begins = True
    for batch in batches:
        for conv, turn, role, text, gone, fault in zip(*(batch.column(x).to_pylist() for x in range(6))):
            if now is None or conv != now.conv:
                if now is not None:
                    yield now, begins, True
                now, begins = Segment(conv), True
            elif len(now.roles) >= SEGMENT:
                yield now, begins, False
                now, begins = Segment(conv), False
            if not gone:
                now.roles.append(role)
                now.texts.append(text)
                now.faults.append(fault)
                now.turns.append(turn)
                now.bytes += len(text)
    if now is not None:
        yield now, begins, True


def repair(rows: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per conversation of ``rows`` (``conv_id, turn, role, text, gone, copy``, as ``damage`` gives them).

    Turns stand in order of ``turn``, nulls first; equal turns by role, text digest and copy.  Each row's
    first fault counts: blank, duplicate (role and text seen earlier), truncated.  Edits: Keep 0, Rerole
    3, Delete 4 (required for blank and duplicate rows), Insert an empty turn 3; a truncated row that stays
    adds 3.  ``audit`` is the least string of edit initials among the cheapest.  ``repaired`` (``role:text``
    lines) is null unless ``with_text``.

    Null ids are one conversation; null turns come first and are left out of ``gaps``.  Repeated rows are
    duplicates.  A conversation all of whose rows are ``gone`` has zeros, an empty audit and the digest of
    the empty string.  Roles with other initials are kept by no grammar string.  Empty table: no rows.
    """
    require(rows, "conv_id", "turn", "role", "text", "gone", "copy")
    digest = F.md5(F.col("text").cast("binary"))
    again = Window.partitionBy("conv_id", "gone", "role", "_digest").orderBy(F.col("turn").asc_nulls_first(), "copy")
    numbered = rows.select("conv_id", "turn", "role", "text", "gone", "copy", digest.alias("_digest")).withColumn("_nth", F.row_number().over(again))
    fault = (
        F.when(~F.col("text").rlike(f"[^{WHITE_SPACE}]"), 1)
        .when(F.col("_nth") > 1, 2)
        .when(~F.col("text").rlike(f"[.!?][{WHITE_SPACE}]*\\z"), 3)
        .otherwise(0)
    )
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("_digest"), F.col("copy"), F.col("_nth")]
    kept = numbered.withColumn("fault", fault)
    ordered = kept.repartitionByRange(*keys[:4]).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*keys)
    conv, turn = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The first and the last run of a range may go on in another one, so they stay open.
        held: list[tuple[Segment, int, bool]] = []
        part, place, last = 0, 0, None

        def stream() -> Iterator[pa.RecordBatch]:
            nonlocal part
            for batch in batches:
                if batch.num_rows:
                    part = batch.column(6)[0].as_py()
                    yield batch

        def flush() -> Iterator[pa.RecordBatch]:
            for is_open in (False, True):
                mine = [(s, p) for s, p, o in held if o == is_open]
                if mine:
                    moves = align_segments([s for s, _ in mine], ALL_PAIRS if is_open else WHOLE, 4 if is_open else 0)
                    yield _open(mine, moves, part) if is_open else _closed(mine, moves)
            held.clear()

        def _closed(mine, moves) -> pa.RecordBatch:
            done = [(s.conv, *_finish(s, m, with_text)) for (s, _), m in zip(mine, moves)]
            return _batch([*zip(*done)], None)

        def _open(mine, moves, part: int) -> pa.RecordBatch:
            rows = [
                {
                    "part": part, "place": p, "roles": s.roles, "texts": s.texts, "counts": s.counts(), "low": s.span[0], "high": s.span[1],
                    "moves": [{"a": a, "b": b, "cost": c, "audit": x.decode()} for (a, b), (c, x) in m.items()],
                }
                for (s, p), m in zip(mine, moves)
            ]
            return _batch([[s.conv for s, _ in mine], *[[None] * len(mine)] * 9], rows)

        first, n, size = True, 0, 0
        for segment, begins, ends in _segments(stream()):
            if last is not None:
                held.append(last)
            last = (segment, place, first or not (begins and ends))
            place += 1
            first = first and not ends
            n, size = n + len(segment.roles), size + segment.bytes
            if n >= GATHER or size >= GATHER_BYTES:
                yield from flush()
                n = size = 0
        if last is not None:
            held.append((last[0], last[1], True))
        yield from flush()

    types = {"conv_id": _arrow(rows, "conv_id")}

    def _batch(columns: list, opened: list[dict] | None) -> pa.RecordBatch:
        n = len(columns[0])
        fields = [types["conv_id"], *[pa.int64()] * 6, *[pa.string()] * 3]
        arrays = [pa.array(list(c), f) for c, f in zip(columns, fields)]
        arrays.append(pa.array(opened if opened is not None else [None] * n, OPEN_TYPE))
        return pa.RecordBatch.from_arrays(arrays, NAMES)

    out = ordered.select("conv_id", "turn", "role", "text", "gone", "fault", "_part").mapInArrow(run, f"conv_id {conv}, {RESULT}, open struct<{_colons(OPEN)}>")
    written = cut_lineage(out)
    open_rows = written.where("open is not null").select("conv_id", "open.*")
    folded = open_rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")
    joined = folded.mapInArrow(lambda batches: fold(batches, with_text, types["conv_id"]), f"conv_id {conv}, {RESULT}")
    both = written.where("open is null").drop("open").unionByName(joined)
    return both if with_text else both.drop("repaired")


def _colons(ddl: str) -> str:
    """Field list of a struct type from a table's column list."""
    out, depth = [], 0
    for piece in ddl.split(", "):
        out.append(piece.replace(" ", ": ", 1) if depth == 0 else piece)
        depth += piece.count("<") - piece.count(">")
    return ", ".join(out)


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    return to_arrow_type(df.schema[name].dataType)


MOVE_TYPE = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
OPEN_TYPE = pa.struct(
    [("part", pa.int32()), ("place", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())),
     ("low", pa.int64()), ("high", pa.int64()), ("moves", pa.list_(MOVE_TYPE))]
)
NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "repaired", "open"]


@dataclass
class _Way:
    """The cheapest repair so far that ends in one grammar state."""

    cost: int
    audits: list[bytes]
    digest: object
    texts: list[str] | None
    written: bool

    @property
    def audit(self) -> bytes:
        if len(self.audits) > 1:
            self.audits = [b"".join(self.audits)]
        return self.audits[0] if self.audits else b""


def fold(batches: Iterator[pa.RecordBatch], with_text: bool, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Join the segments of each conversation, in order: the cheapest way into each state, with its running digest."""
    done: list[tuple] = []
    now, some, ways, total, low, high, role = None, False, {}, [0] * 5, None, None, ""

    def close() -> tuple:
        cost, audit, best = min((ways[s].cost, ways[s].audit, s) for s in ACCEPT if s in ways)
        gaps = 0 if low is None else high - low + 1 - total[4]
        way = ways[best]
        return (now, gaps, *total[:4], cost, audit.decode(), way.digest.hexdigest(), "\n".join(way.texts) if with_text else None)

    for batch in batches:
        for x in batch.to_pylist():
            if not some or x["conv_id"] != now:
                if some:
                    done.append(close())
                now, some = x["conv_id"], True
                ways = {START: _Way(0, [], hashlib.sha256(), [] if with_text else None, False)}
                total, low, high, role = [0] * 5, None, None, ""
            total = [a + b for a, b in zip(total, x["counts"])]
            if x["roles"]:
                if role:
                    total[3] += role[0] + x["roles"][0][:1] not in ("su", "ua", "au")
                role = x["roles"][-1][:1] or "\0"
            if x["low"] is not None:
                # A turn that two segments share is one turn.
                total[4] -= high is not None and high == x["low"]
                low = x["low"] if low is None else low
                high = x["high"]
            nearest: dict[int, tuple[int, bytes, int, bytes]] = {}
            for m in x["moves"]:
                if m["a"] in ways:
                    way, piece = ways[m["a"]], m["audit"].encode()
                    offer = (way.cost + m["cost"], way.audit + piece, m["a"], piece)
                    if m["b"] not in nearest or offer[:2] < nearest[m["b"]][:2]:
                        nearest[m["b"]] = offer
            following = {}
            for state, (cost, audit, before, piece) in nearest.items():
                way = ways[before]
                lines = replay(piece, x["roles"], x["texts"], before)
                digest = way.digest.copy()
                if lines:
                    digest.update(("\n" * way.written + "\n".join(lines)).encode("utf-8", "surrogatepass"))
                following[state] = _Way(cost, [audit], digest, way.texts + lines if with_text else None, way.written or bool(lines))
            ways = following
    if some:
        done.append(close())
    columns = [*zip(*done)] if done else [[]] * 10
    fields = [kind, *[pa.int64()] * 6, *[pa.string()] * 3]
    yield pa.RecordBatch.from_arrays([pa.array(list(c), f) for c, f in zip(columns, fields)], NAMES[:-1])
