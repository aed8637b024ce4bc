"""Near-duplicate lines across documents by a segment-partition edit join.

Two lines within ``edits`` of each other share, if one of them is cut into ``edits + 1`` segments,
at least one whole segment, and at few possible shifts.  Every line puts its segments into an
index, with its length, and looks up those substrings of itself that a shorter or equally long
line could have as segments.  What shares an entry is verified by banded bit-parallel edit
distance.  Where an entry is crowded, both rests of its lines, left and right of the shared segment,
must be within their share of the edits, so the longest rest is cut and looked up in the same way and
the others stay open, until few lines share an entry or no rest is longer than its edits; nothing is cut off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.components import components
from gridloom.llm.text import WHITE, SpanHash, array_column, flat, mix, passes, require, signed
from gridloom.session import cut_lineage

#: Edits (of code points) within which two lines are near-duplicates, and the least length of a
#: line, in code points, that takes part at all.
EDITS = 2
MIN_CHARS = 20
#: Lines that an entry may hold before it is refined, and code points of all of them before its
#: lines are compared by their letters alone and only likely pairs by their texts.
CROWDED, CROWDED_CHARS = 4096, 8 << 20
#: Keys (16 bytes each) up to which a list of them is broadcast; a longer one is joined by shuffle.
BROADCAST_KEYS = 1_000_000
#: Classes of code points that are counted before a pair is verified.
LETTERS = 64

_GOLD = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


@dataclass
class Lines:
    """Lines of a batch: code points ``[starts, ends)`` without the white space around them."""

    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    place: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return self.ends - self.starts

    def digests(self) -> np.ndarray:
        return np.stack([SpanHash(self.points, which)(self.starts, self.ends) for which in (0, 1)], 1)


def read_lines(column: pa.Array, min_chars: int) -> Lines:
    """The lines of at least ``min_chars`` code points; ``place`` counts all lines of a text from 0."""
    data, offs = flat(column)
    n = len(offs) - 1
    breaks = np.flatnonzero(data == 0x0A)
    owner = np.concatenate([np.searchsorted(offs, breaks, "right") - 1, np.arange(n)])
    ends = np.concatenate([breaks, offs[1:]])
    order = np.lexsort((ends, owner))
    owner, ends = owner[order], ends[order]
    new = np.ones(len(owner), bool)
    new[1:] = owner[1:] != owner[:-1]
    starts = np.where(new, offs[owner], np.concatenate([[0], ends[:-1] + 1]))
    first = np.flatnonzero(new)
    place = np.arange(len(owner)) - np.repeat(first, np.diff(np.concatenate([first, [len(owner)]])))
    # White space around: the next and the last byte that is none.
    filled = np.flatnonzero(~WHITE[data])
    lo, hi = np.searchsorted(filled, starts), np.searchsorted(filled, ends)
    some = hi > lo
    owner, place, lo, hi = owner[some], place[some], lo[some], hi[some]
    starts, ends = filled[lo] if len(lo) else lo, (filled[hi - 1] + 1) if len(hi) else hi
    lead = (data & 0xC0) != 0x80
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=at[1:])
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts, ends = at[starts], at[ends]
    long = ends - starts >= min_chars
    return Lines(points, starts[long], ends[long], owner[long], place[long])


# --- segments -------------------------------------------------------------------


def _key(parent: np.ndarray, m: np.ndarray, t: int, i: int, segment: np.ndarray) -> np.ndarray:
    salt = np.uint64((t * 8 + i + 1) * _GOLD & _ALL)
    return mix(mix(segment ^ parent) + salt + m.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


@dataclass
class Entries:
    """Rows of the index (role 1) or of look-ups (role 2), and what remains of the line beside the match.

    ``sides`` (rows x rests x 4) holds for each rest its bounds ``a, b`` in the line, the edits
    ``t`` it may have, and the length ``m`` of the same rest of the indexed line.
    """

    source: np.ndarray
    key: np.ndarray
    role: np.ndarray
    sides: np.ndarray

    @staticmethod
    def join(parts: list[Entries]) -> Entries:
        return Entries(*(np.concatenate([getattr(p, f) for p in parts]) for f in Entries.__dataclass_fields__))

    def where(self, mask: np.ndarray) -> Entries:
        return Entries(*(getattr(self, f)[mask] for f in Entries.__dataclass_fields__))


def segment(
    hashes: SpanHash, base: np.ndarray, parent: np.ndarray, role: int, a: np.ndarray, b: np.ndarray, t: int, m: np.ndarray, full: bool = True
) -> Entries:
    """Cut the rests ``[a, b)`` of lines that begin at ``base`` for ``t`` edits; ``source`` numbers the input.

    The part left of segment i may have i edits and the part right of it t - i (i is the first
    segment up to whose end there are no more than i edits), so its shift is bounded on both sides.
    Both parts are kept, without ``full`` none.  A part without edits is empty.
    """
    out = []
    every = np.arange(len(base))
    gap = (b - a) - m
    for i in range(t + 1):
        p, q = m * i // (t + 1), m * (i + 1) // (t + 1)
        for shift in [0] if role == 1 else range(-i, i + 1):
            ok = (np.abs(gap - shift) <= t - i) & (p + shift >= 0) & (q + shift <= b - a)
            if role == 1:
                ok = np.ones(len(base), bool)
            x = every[ok]
            lo, hi = a[x] + p[x] + shift, a[x] + q[x] + shift
            key = _key(parent[x], m[x], t, i, hashes(base[x] + lo, base[x] + hi))
            sides = np.zeros((len(x), 2 if full else 0, 4), np.int64)
            if full:
                for side, four in enumerate(((a[x], lo, i, p[x]), (hi, b[x], t - i, m[x] - q[x]))):
                    for f, value in enumerate(four):
                        sides[:, side, f] = value
            out.append(Entries(x, key, np.full(len(x), role), sides))
    return Entries.join(out)


def open_sides(sides: np.ndarray, edits: int) -> np.ndarray:
    """The rests that may have edits, in their order, and empty ones up to ``edits`` of them.

    Each of them may have one edit at least and all together ``edits``, so no more are open.
    """
    order = np.argsort(sides[:, :, 2] == 0, axis=1, kind="stable")
    sides = np.take_along_axis(sides, order[:, :, None], 1)[:, :edits]
    out = np.zeros((len(sides), edits, 4), np.int64)
    out[:, : sides.shape[1]] = np.where(sides[:, :, 2:3] > 0, sides, 0)
    return out


def first_entries(lines: Lines, edits: int, full: bool = False) -> Entries:
    """Index entries of all lines, and their look-ups of lines at most ``edits`` shorter."""
    hashes = SpanHash(lines.points)
    size, zero = lines.sizes, np.zeros(len(lines.starts), np.int64)
    parent = zero.astype(np.uint64)
    parts = [segment(hashes, lines.starts, parent, 1, zero, size, edits, size, full)]
    for shorter in range(edits + 1):
        parts.append(segment(hashes, lines.starts, parent, 2, zero, size, edits, size - shorter, full))
    return Entries.join(parts)


@lru_cache(100_000)
def last_forms(rest: str, t: int, role: int) -> tuple[str, ...]:
    """Keys of a rest whose indexed counterpart is no longer than ``t``: an indexed rest and a looked-up
    one share a key exactly if they are within ``t`` edits.

    Letters are kept, changed (a mark in their place) or left out; the looked-up rest says how many
    it leaves out, the indexed one how many more its own changes allow.
    """
    out = set()
    for choice in product((0, 1, 2), repeat=len(rest)):
        cost = sum(c > 0 for c in choice)
        if cost > t:
            continue
        form = "".join(f"={c}" if k == 0 else "*" for c, k in zip(rest, choice) if k < 2)
        for gone in range(t - cost + 1) if role == 1 else [choice.count(2)]:
            out.add(f"{gone}:{form}")
    return tuple(sorted(out))


# --- verification ---------------------------------------------------------------


def trimmed(first: str, second: str) -> tuple[str, str]:
    """Both without their common beginning and end, which no edit distance needs."""
    for _ in range(2):
        low, high = 0, min(len(first), len(second))
        while low < high:
            middle = (low + high + 1) // 2
            if first[low:middle] == second[low:middle]:
                low = middle
            else:
                high = middle - 1
        first, second = first[low:][::-1], second[low:][::-1]
    return first, second


def within(first: list[str], second: list[str], edits: int) -> np.ndarray:
    """Which pairs are within ``edits`` of each other: bit-parallel over diagonals, for all pairs at once.

    Bit d of ``reach[e]`` says that with e edits the first i characters of one line can be turned
    into the first i + d - edits of the other; only those 2 * edits + 1 diagonals matter.  A pair
    whose bits are all gone is finished.
    """
    n = len(first)
    out = np.zeros(n, bool)
    if n:
        first, second = map(list, zip(*map(trimmed, first, second)))
    la, lb = np.array([len(s) for s in first], np.int64), np.array([len(s) for s in second], np.int64)
    live = np.flatnonzero(np.abs(la - lb) <= edits)
    if not len(live):
        return out
    width = 2 * edits + 1
    full = (1 << width) - 1
    x = np.frombuffer("".join(first).encode("utf-32-le"), np.uint32)
    # One letter more, for second lines of which nothing is left.
    y = np.frombuffer(("".join(second) + "\0").encode("utf-32-le"), np.uint32)
    xa, ya = np.cumsum(la) - la, np.cumsum(lb) - lb
    reach = [np.full(n, ((1 << (e + 1)) - 1) << edits, np.int64) for e in range(edits + 1)]
    i = 0
    while len(live):
        ended = la[live] == i
        if ended.any():
            done = live[ended]
            out[done] = reach[edits][done] >> (lb[done] - la[done] + edits) & 1
            live = live[~ended]
            if not len(live):
                break
        match = np.zeros(len(live), np.int64)
        c = x[xa[live] + i]
        for d in range(width):
            j = i + d - edits
            ok = (j >= 0) & (j < lb[live])
            match |= (ok & (y[np.minimum(ya[live] + max(j, 0), len(y) - 1)] == c)).astype(np.int64) << d
        below = None
        for e in range(edits + 1):
            old = reach[e][live]
            new = old & match
            if below is not None:
                # A changed letter keeps the diagonal, one left out of the second line moves it
                # down; one added to the second line moves it up, within the new column.
                new |= below | below >> 1 | fresh << 1 & full
            below, fresh = old, new
            reach[e][live] = new
        live = live[reach[edits][live] != 0]
        i += 1
    return out


# --- the operator ---------------------------------------------------------------


def _entry_rows(docs: DataFrame, edits: int, min_chars: int, full: bool = False, wanted: DataFrame | None = None) -> DataFrame:
    """``key, line`` (64 bits of its digest) of the first cut, if ``full`` also ``role, sides``; a line counts once per pass.

    With ``wanted (key)``, only those keys: a short list is looked up where the text is read, a
    longer one is joined.
    """
    short = None if wanted is None else _short_list(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches):
            lines = read_lines(batch.column(0), min_chars)
            line = lines.digests()[:, 0]
            _, once = np.unique(line, return_index=True)
            lines = Lines(lines.points, lines.starts[once], lines.ends[once], lines.row[once], lines.place[once])
            got = first_entries(lines, edits, full)
            if short is not None:
                got = got.where(_listed(signed(got.key), short.value))
            keyed = [pa.array(signed(got.key)), pa.array(signed(line[once][got.source]))]
            if full:
                keyed += [pa.array(got.role.astype(np.int32)), _sides_column(open_sides(got.sides, edits))]
            yield pa.RecordBatch.from_arrays(keyed, ["key", "line", "role", "sides"][: len(keyed)])

    rows = docs.select("text").mapInArrow(run, "key long, line long" + ", role int, sides array<int>" * full)
    return rows if wanted is None or short is not None else rows.join(wanted, "key", "left_semi")


def _sides_column(sides: np.ndarray) -> pa.Array:
    width = sides.shape[1] * 4
    return array_column(sides.astype(np.int32).ravel(), np.arange(len(sides) + 1) * width, pa.int32())


def _short_list(wanted: DataFrame):
    """The keys of a one-column table, sorted and broadcast, if they are counted to be few; else None."""
    if wanted.count() > BROADCAST_KEYS:
        return None
    return wanted.sparkSession.sparkContext.broadcast(np.sort(np.asarray(wanted.toArrow().column(0))))


def _listed(keys: np.ndarray, listed: np.ndarray) -> np.ndarray:
    if not len(listed):
        return np.zeros(len(keys), bool)
    return listed[np.minimum(np.searchsorted(listed, keys), len(listed) - 1)] == keys


def _line_texts(docs: DataFrame, wanted: DataFrame, min_chars: int) -> DataFrame:
    """``line, node, words`` of the lines in ``wanted (line)``, each text once, as a table."""
    short = _short_list(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches):
            lines = read_lines(batch.column(0), min_chars)
            digest = lines.digests()
            _, once = np.unique(digest[:, 0], return_index=True)
            if short is not None:
                once = once[_listed(signed(digest[once, 0]), short.value)]
            text = [lines.points[a:b].tobytes().decode("utf-32-le") for a, b in zip(lines.starts[once], lines.ends[once])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(digest[once, 0])), pa.array([d.tobytes() for d in digest[once]], pa.binary()), pa.array(text, pa.string())],
                ["line", "node", "words"],
            )

    rows = docs.select("text").mapInArrow(run, "line long, node binary, words string")
    return cut_lineage((rows if short is not None else rows.join(wanted, "line", "left_semi")).dropDuplicates(["node"]))


def _refine(rows: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """Cut the longest rest of the lines of crowded entries once more: ``key, line, role, sides, last``.

    Of rows that share a key all rests have the same edits and indexed lengths, so all are cut in the
    same place.  Where no indexed rest is longer than its edits the row is at its end (``last``): its
    keys are the forms of its rests, and any indexed and any other row of one key are linked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches, "words"):
            text = batch.column(batch.schema.get_field_index("words")).to_pylist()
            size = np.array([len(s) for s in text], np.int64)
            points = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32)
            hashes, base = SpanHash(points), np.cumsum(size) - size
            key, line, role = (np.asarray(batch.column(batch.schema.get_field_index(f))).astype(np.int64) for f in ("key", "line", "role"))
            flat_sides = batch.column(batch.schema.get_field_index("sides")).flatten()
            sides = np.asarray(flat_sides).astype(np.int64).reshape(len(text), edits, 4)
            t, m = sides[:, :, 2], sides[:, :, 3]
            left = np.where(m > t, m, -1)
            which = left.argmax(1) if edits else np.zeros(len(text), np.int64)
            ended = left.max(1, initial=-1) < 0
            for k in range(edits):
                for r in (1, 2):
                    for edit in range(1, edits + 1):
                        x = np.flatnonzero(~ended & (which == k) & (role == r) & (t[:, k] == edit))
                        if len(x):
                            a, b, _, long = sides[x, k].T
                            got = segment(hashes, base[x], key[x].view(np.uint64), r, a, b, edit, long)
                            own = sides[x][got.source]
                            cut = open_sides(np.concatenate([own[:, :k], got.sides, own[:, k + 1 :]], 1), edits)
                            yield _refined(got.key, line[x][got.source], got.role, cut, False)
            x = np.flatnonzero(ended)
            source, forms = [], []
            for j in x.tolist():
                rests = [(text[j][a:b], e, int(role[j])) for a, b, e, _ in sides[j].tolist() if e]
                for form in product(*(last_forms(*rest) for rest in rests)):
                    source.append(j)
                    forms.append("\n".join(form))
            if source:
                data = pa.array(forms, pa.large_string())
                values, offs = flat(data)
                hashed = mix(SpanHash(values)(offs[:-1], offs[1:]) ^ mix(key[source].view(np.uint64)) + np.uint64(_GOLD))
                yield _refined(hashed, line[source], role[source], np.zeros((len(source), edits, 4), np.int64), True)

    joined = rows.join(texts.select("line", "words"), "line").select("key", "line", "role", "sides", "words")
    return joined.mapInArrow(run, "key long, line long, role int, sides array<int>, last boolean")


def _refined(key: np.ndarray, line: np.ndarray, role: np.ndarray, sides: np.ndarray, last: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(signed(key)), pa.array(line), pa.array(role.astype(np.int32)), _sides_column(sides), pa.array(np.full(len(key), last))],
        ["key", "line", "role", "sides", "last"],
    )


def _verified(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """``a, b``: the nodes of those pairs of lines that are within ``edits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches, "wa"):
            good = within(batch.column(2).to_pylist(), batch.column(3).to_pylist(), edits)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    left = texts.select(F.col("line").alias("x"), F.col("node").alias("a"), F.col("words").alias("wa"))
    right = texts.select(F.col("line").alias("y"), F.col("node").alias("b"), F.col("words").alias("wb"))
    both = pairs.join(left, "x").join(right, "y").select("a", "b", "wa", "wb")
    return both.mapInArrow(run, "a binary, b binary")


def letter_counts(text: list[str]) -> np.ndarray:
    """How often each class of code points stands in each text."""
    size = np.array([len(t) for t in text], np.int64)
    owner = np.repeat(np.arange(len(text)), size)
    points = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32) % LETTERS
    return np.bincount(owner * LETTERS + points, minlength=len(text) * LETTERS).astype(np.int32).reshape(len(text), LETTERS)


def likely_pairs(count: np.ndarray, size: np.ndarray, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j that may be within ``edits``, block by block: an edit changes the counts by two at most."""
    for a in range(0, len(size), 32):
        part = np.arange(a, min(a + 32, len(size)))
        apart = np.abs(count[part][:, None, :] - count[None, a:, :]).sum(-1)
        i, j = np.nonzero((apart <= 2 * edits) & (np.abs(size[part][:, None] - size[None, a:]) <= edits))
        yield i[i < j] + a, j[i < j] + a


def group_links(node: list[bytes], text: list[str], edits: int) -> list[tuple[int, int]]:
    """Links between the lines of one group that connect all its lines within ``edits``: a forest."""
    size = np.array([len(t) for t in text], np.int64)
    root = np.arange(len(text))
    out = []
    for i, j in likely_pairs(letter_counts(text), size, edits):
        pick = root[i] != root[j]
        i, j = i[pick], j[pick]
        good = within([text[k] for k in i], [text[k] for k in j], edits)
        for x, y in zip(i[good].tolist(), j[good].tolist()):
            if root[x] != root[y]:
                root[root == root[y]] = root[x]
                out.append((x, y))
    return out


def _long_pairs(rows: DataFrame, edits: int) -> DataFrame:
    """``x, y``: likely pairs of lines inside the groups ``key, line, words``, found without gathering the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches, "words"):
            text = batch.column(2).to_pylist()
            counts = pa.array([c.tobytes() for c in letter_counts(text)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(t) for t in text], pa.int64()), counts], ["key", "line", "size", "counts"])

    def run(group: pa.Table) -> pa.Table:
        line, size = np.asarray(group.column("line")), np.asarray(group.column("size"))
        counts = np.frombuffer(b"".join(group.column("counts").to_pylist()), np.int32).reshape(len(line), LETTERS)
        found = list(likely_pairs(counts, size, edits))
        x, y = (line[np.concatenate([f[k] for f in found])] for k in (0, 1))
        return pa.table({"x": np.minimum(x, y), "y": np.maximum(x, y)})

    counted = rows.mapInArrow(count, "key long, line long, size long, counts binary")
    return counted.groupBy("key").applyInArrow(run, "x long, y long")


def _grouped(rows: DataFrame, edits: int) -> DataFrame:
    """``a, b``: links inside the groups ``key, node, words``."""

    def run(group: pa.Table) -> pa.Table:
        node, text = group.column("node").to_pylist(), group.column("words").to_pylist()
        links = group_links(node, text, edits)
        return pa.table({"a": pa.array([node[i] for i, _ in links], pa.binary()), "b": pa.array([node[j] for _, j in links], pa.binary())})

    return rows.groupBy("key").applyInArrow(run, "a binary, b binary")


def line_links(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, crowded: int = CROWDED) -> DataFrame:
    """``a, b``: nodes (16-byte digests) of different lines within ``edits``, enough of them that their
    components are those of all such links."""

    def shared(rows: DataFrame, *found) -> DataFrame:
        return cut_lineage(rows.groupBy("key").agg(F.min("line").alias("lo"), F.max("line").alias("hi"), *found).where("lo != hi").drop("lo", "hi"))

    def sized(rows: DataFrame) -> DataFrame:
        return rows.join(texts.select("line", F.length("words").alias("_size")), "line").groupBy("key").agg(
            F.countDistinct("line").alias("n"), F.sum("_size").alias("chars"), F.min("line").alias("lo"), F.max("line").alias("hi")
        )

    def among(load: DataFrame) -> DataFrame:
        return rows.join(load.select("key"), "key", "left_semi").select("key", "line").distinct()

    few = (F.col("n") > 2) & (F.col("n") <= crowded)
    keys = shared(_entry_rows(docs, edits, min_chars))
    rows = cut_lineage(_entry_rows(docs, edits, min_chars, wanted=keys).distinct())
    texts = _line_texts(docs, cut_lineage(rows.select("line").distinct()), min_chars)
    whole = None
    pairs, groups = [], []
    while True:
        load = cut_lineage(sized(rows))
        pairs.append(load.where("n = 2").select(F.col("lo").alias("x"), F.col("hi").alias("y")))
        groups.append(among(load.where(few & (F.col("chars") <= CROWDED_CHARS))))
        long = load.where(few & (F.col("chars") > CROWDED_CHARS))
        if not long.isEmpty():
            pairs.append(_long_pairs(among(long).join(texts, "line").select("key", "line", "words"), edits))
        busy = load.where((F.col("n") > crowded) & (F.col("n") > 2))
        if busy.isEmpty():
            break
        crowds = cut_lineage(busy.select("key"))
        if whole is None:
            whole = _entry_rows(docs, edits, min_chars, True, crowds)
        hot = cut_lineage(whole.join(crowds, "key", "left_semi").distinct())
        # A link has an indexed line; keys that are only looked up hold none.
        cut = cut_lineage(_refine(hot.join(hot.where("role = 1").select("key").distinct(), "key", "left_semi"), texts, edits).distinct())
        indexed = F.min(F.when(F.col("role") == 1, F.col("line"))).alias("hub")
        ends = cut.where("last")
        stars = ends.join(shared(ends, indexed).where("hub IS NOT NULL"), "key").where("line != hub")
        pairs.append(stars.select(F.least("line", "hub").alias("x"), F.greatest("line", "hub").alias("y")))
        whole = cut.where("NOT last").drop("last")
        rows = cut_lineage(whole.select("key", "line").distinct().join(shared(whole, indexed).where("hub IS NOT NULL"), "key", "left_semi"))
    direct = pairs[0]
    for more in pairs[1:]:
        direct = direct.unionByName(more)
    found = _verified(direct.distinct(), texts, edits)
    for members in groups:
        named = members.join(texts, "line").select("key", "node", "words")
        found = found.unionByName(_grouped(named, edits))
    return found.distinct()


def line_classes(
    docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, crowded: int = CROWDED, exact_from: int | None = None
) -> DataFrame:
    """``doc_id, text_hash, place, node, root, copies, links, first, short`` of every line of at least ``exact_from`` code points.

    ``exact_from`` is ``min_chars`` if not given.  Lines below ``min_chars`` (``short``) are in one class only
    if they are equal, others if edits link them.  ``root`` is the class of the line: its representative, the
    least node.  ``copies`` is its number of lines, and ``links`` the number of its representative pairs (the
    representative and each other distinct line); a class of k distinct lines hangs together by k - 1 links.
    ``first`` holds for the one that stays: least doc_id (null last), then text hash, then place.
    """
    require(docs, "doc_id", "text")
    least = min_chars if exact_from is None else max(1, min(exact_from, min_chars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches):
            lines = read_lines(batch.column(2), least)
            row = pa.array(lines.row)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(row),
                    batch.column(1).take(row),
                    pa.array(lines.place.astype(np.int32)),
                    pa.array([d.tobytes() for d in lines.digests()], pa.binary()),
                    pa.array(lines.sizes < min_chars),
                ],
                ["doc_id", "text_hash", "place", "node", "short"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = cut_lineage(keyed.mapInArrow(run, f"doc_id {kind}, text_hash long, place int, node binary, short boolean"))
    roots = cut_lineage(components(line_links(docs, edits, min_chars, crowded)))
    rooted = found.join(roots, "node", "left").select("doc_id", "text_hash", "place", "node", "short", F.coalesce("root", "node").alias("root"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "place")
    classes = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("copies"), F.min(order).alias("_first")).where("copies > 1")
    classes = classes.join(roots.groupBy("root").agg((F.count(F.lit(1)) - 1).alias("links")), "root", "left")
    first = (
        F.col("doc_id").eqNullSafe(F.col("_first.doc_id")) & (F.col("text_hash") == F.col("_first.text_hash")) & (F.col("place") == F.col("_first.place"))
    )
    return rooted.join(classes, "root", "left").select(
        "doc_id", "text_hash", "place", "node", "root", F.coalesce("copies", F.lit(1)).alias("copies"),
        F.coalesce("links", F.lit(0)).alias("links"), (F.col("_first").isNull() | first).alias("first"), "short",
    )


def drop_lists(classes: DataFrame, drop_short: bool = False) -> DataFrame:
    """``doc_id, text_hash, n_lines, n_repeated, drop, classes``: places of the lines that go, per text,
    and the classes of its repeated lines as (place, class_id, copies, links).

    Short lines are counted and have classes; they go only with ``drop_short``.
    Equal (id, text) rows share one list; of such rows all but one lose their lines when the
    caller's rows are told apart, see ``dedup``.
    """
    once = classes.distinct()
    return once.groupBy("doc_id", "text_hash").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count(F.when(F.col("copies") > 1, 1)).alias("n_repeated"),
        F.sort_array(F.collect_list(F.when(~F.col("first") & (F.lit(drop_short) | ~F.col("short")), F.col("place")))).alias("drop"),
        F.sort_array(F.collect_list(F.when(F.col("copies") > 1, F.struct("place", F.hex("root").alias("class_id"), "copies", "links")))).alias("classes"),
    )


def dedup(
    docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, crowded: int = CROWDED, drop_from: int | None = None
) -> DataFrame:
    """``docs``, with all their columns, without repeated lines.

    Of each class of lines (of ``min_chars`` code points or more without white space around,
    linked by at most ``edits`` edits) the first line stays, by doc_id (null last), text hash and
    place; shorter and empty lines stay, unless ``drop_from`` is below ``min_chars``: then exact repeats of
    ``drop_from`` code points or more go too.  A document that loses every line that has a word is
    dropped; one that had none stays as it is (null, empty or white text included).  Rows equal in
    id and text are one document here: all of them stay alike.  Empty table: no rows.
    """
    require(docs, "doc_id", "text")
    lists = cut_lineage(drop_lists(line_classes(docs, edits, min_chars, crowded, drop_from), True).where(F.size("drop") > 0))
    theirs = lists.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.col("drop").alias("_drop"))
    on = docs["doc_id"].eqNullSafe(theirs["_d"]) & (F.xxhash64(docs["text"]) == theirs["_h"])
    lines = F.split(docs["text"], "\n")
    gone = F.coalesce(theirs["_drop"], F.array().cast("array<int>"))
    left = F.filter(lines, lambda _, i: ~F.array_contains(gone, i))
    new = F.when(theirs["_drop"].isNull(), docs["text"]).otherwise(F.array_join(left, "\n"))
    columns = [new.alias("text") if c == "text" else docs[c] for c in docs.columns]
    return docs.join(theirs, on, "left").where(theirs["_drop"].isNull() | new.rlike("[^\\x20\\x09-\\x0D]")).select(*columns)
