"""Collocations of two to four words by direct-address tiling of ranked ids.

Frequent words are numbered by falling frequency.  The square of all pairs of numbers is cut into tiles:
where many pairs of a batch fall into one tile (the frequent words), they are counted by ``bincount`` into
a dense tile; the rest are counted as sorted coordinates.  Frequent pairs are numbered in the same way, and
adjoining pairs counted by the same tiles give phrases of three words, and those of four: a phrase is frequent
only if both phrases one word shorter are.

Sequences of numbers are written once a level; what a level keeps is what frequent phrases cover.  Numbers are
looked up from a broadcast table up to ``LOOKUP_ROWS`` rows and joined by key beyond.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.text import LOWER, SpanHash, Words, array_column, flat, mix, passes, require, separator_table, signed, spans
from gridloom.operators.numbering import dense_index
from gridloom.session import cut_lineage

#: Least frequency of a phrase, and words of the longest.
LEAST = 30
LONGEST = 4
SCALE = 2_000_000
#: Numbers along a tile's side; pairs of a batch that make a tile dense; dense tiles and sparse pairs that a task holds.
SIDE = 256
DENSE_PAIRS = SIDE * SIDE // 16
HELD_TILES = 48
HELD_PAIRS = 300_000
#: Pairs that are counted in one go.
PAIRS = 1 << 16
#: Rows of a lookup table that is broadcast (16 bytes each).
LOOKUP_ROWS = 4_000_000
#: Numbers of one stored sequence, from which on it ends at the next gap.
CHUNK = 1 << 10
PASS_BYTES = 1 << 20

GAP = -1
#: Numbers of a level: 90 thousand million words could hold so many frequent ones at most.
MOST_IDS = 3_000_000_000
PIECE_ENDS = separator_table([*b".,;:!?", *range(0x0A, 0x0E)])
WORD_ENDS = PIECE_ENDS | separator_table(b" \t")


# --- words ----------------------------------------------------------------------


def _lang_keys(langs: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Code of each row's language in this batch, and the languages; null is ``und``."""
    coded = langs.cast(pa.string()).fill_null("und").dictionary_encode()
    return np.asarray(coded.indices, np.int64), coded.dictionary.to_pylist()


def word_keys(w: Words, hashes: np.ndarray, lang: np.ndarray, names: list[str]) -> np.ndarray:
    """64-bit keys of (language, word)."""
    salt = mix(np.array([zlib.crc32(n.encode("utf-8", "surrogatepass")) + 1 for n in names] or [0], np.uint64))
    return mix(hashes ^ salt[lang[w.row_of]]) if len(hashes) else hashes


def read(text: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of a batch, their hashes, and flags: the first of its piece."""
    data, offs = flat(text)
    data = LOWER[data]
    w = spans(data, offs, WORD_ENDS)
    ends = np.zeros(len(data) + 1, np.int64)
    np.cumsum(PIECE_ENDS[data], out=ends[1:])
    piece, row = ends[w.starts], w.row_of
    first = np.ones(len(w.starts), bool)
    first[1:] = (piece[1:] != piece[:-1]) | (row[1:] != row[:-1])
    return w, SpanHash(data)(w.starts, w.ends), first


def strings_of(w: Words, at: np.ndarray) -> pa.Array:
    """Words ``at`` as a string column."""
    size = w.ends[at] - w.starts[at]
    offs = np.concatenate([[0], np.cumsum(size)])
    take = np.arange(offs[-1]) + np.repeat(w.starts[at] - offs[:-1], size)
    return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(w.data[take].tobytes())]).cast(pa.string())


def count_words(docs: DataFrame, least: int) -> DataFrame:
    """``lang, word, a`` of all frequent words; a row with a null word holds the language's number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches, "text", PASS_BYTES):
            lang, names = _lang_keys(batch.column(0))
            w, hashes, _ = read(batch.column(1))
            _, first, n = np.unique(word_keys(w, hashes, lang, names), return_index=True, return_counts=True)
            owner = lang[w.row_of]
            total = np.bincount(owner, minlength=len(names))
            columns = [
                pa.array(names, pa.string()).take(pa.array(np.concatenate([owner[first], np.arange(len(names))]))),
                pa.concat_arrays([strings_of(w, first), pa.nulls(len(names), pa.string())]),
                pa.array(np.concatenate([n, total]), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "a"])

    rows = docs.select("lang", "text").mapInArrow(run, "lang string, word string, a long")
    return rows.groupBy("lang", "word").agg(F.sum("a").alias("a")).where((F.col("a") >= least) | F.col("word").isNull())


# --- sequences ------------------------------------------------------------------

SEQUENCE = "chunk long, ids array<long>"


def _emit(ids: np.ndarray, serial: Iterator[int]) -> Iterator[pa.RecordBatch]:
    """Stored sequences: runs of at least two numbers, each with a gap behind; none is cut inside a run."""
    known = ids != GAP
    beside = np.zeros(len(ids), bool)
    beside[:-1] |= known[1:]
    beside[1:] |= known[:-1]
    keep = known & beside
    # One gap after each run.
    keep[1:] |= keep[:-1] & ~keep[1:]
    ids = np.where(known & beside, ids, GAP)[keep]
    gaps = np.flatnonzero(ids == GAP) + 1
    a = 0
    while a < len(ids):
        at = np.searchsorted(gaps, min(a + CHUNK, len(ids)))
        b = int(gaps[at]) if at < len(gaps) else len(ids)
        yield pa.RecordBatch.from_arrays([pa.array([next(serial)], pa.int64()), array_column(ids[a:b], np.array([0, b - a]), pa.int64())], ["chunk", "ids"])
        a = b


def _serial() -> Iterator[int]:
    """Numbers that no other task gives."""
    at = TaskContext.get().partitionId() << 33
    while True:
        yield at
        at += 1


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Numbers of each batch of stored sequences, a gap between sequences."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index("ids"))
        offs = np.asarray(column.offsets, np.int64)
        ids = np.asarray(column.flatten(), np.int64)
        yield np.insert(ids, offs[1:-1] - offs[0], GAP)


def lookup(keys: np.ndarray, known: np.ndarray, ids: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.full(len(keys), GAP, np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, ids[at], GAP)


def _shared(table: DataFrame, key: str):
    got = table.select(key, "id").toArrow()
    order = np.argsort(np.asarray(got.column(key)), kind="stable")
    return table.sparkSession.sparkContext.broadcast((np.asarray(got.column(key))[order], np.asarray(got.column("id"))[order]))


def word_sequences(docs: DataFrame, words: DataFrame, size: int, limit: int) -> DataFrame:
    """Numbers of the words of all texts, as stored sequences; gaps at pieces' ends and rare words."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, names = _lang_keys(batch.column(0))
            texts = batch.column(1)
            data, offs = flat(texts)
            w = Words(data, offs, offs[:-1].copy(), offs[1:].copy(), np.arange(len(texts) + 1))
            keys = word_keys(w, SpanHash(data)(w.starts, w.ends), lang, names)
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), batch.column(2)], ["key", "id"])

    keys = words.select("lang", "word", "id").mapInArrow(keyed, "key long, id long")
    shared = _shared(keys, "key") if size <= limit else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = _serial()
        for batch in passes(batches, "text", PASS_BYTES):
            lang, names = _lang_keys(batch.column(0))
            w, hashes, first = read(batch.column(1))
            mine = signed(word_keys(w, hashes, lang, names))
            if shared is None:
                # Keys go on to the join; none of them is the gap.
                mine = np.where(mine == GAP, 0, mine)
            else:
                mine = lookup(mine, *shared.value)
            yield from _emit(np.insert(mine, np.flatnonzero(first), GAP), serial)

    found = docs.select("lang", "text").mapInArrow(run, SEQUENCE)
    if shared is not None:
        return cut_lineage(found)
    stored = cut_lineage(found)
    return cut_lineage(_joined(stored.select("chunk", F.posexplode("ids").alias("pos", "key")), keys, ["key"]))


def phrase_sequences(sequences: DataFrame, phrases: DataFrame, size: int, ids: int, limit: int) -> DataFrame:
    """Numbers of the phrases one word longer, each at the place where it begins."""
    if size > limit:
        pairs = F.expr(f"transform(ids, (x, i) -> struct(x AS l, coalesce(try_element_at(ids, i + 2), {GAP}L) AS r))")
        placed = sequences.select("chunk", F.posexplode(pairs).alias("pos", "p")).select("chunk", "pos", "p.l", "p.r")
        return cut_lineage(_joined(placed, phrases.select("l", "r", "id"), ["l", "r"]))
    shared = _shared(phrases.select((F.col("l") * ids + F.col("r")).alias("key"), "id"), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = _serial()
        for seq in _sequences(batches):
            both = (seq[:-1] != GAP) & (seq[1:] != GAP)
            longer = np.full(len(seq), GAP, np.int64)
            at = np.flatnonzero(both)
            longer[at] = lookup(seq[at] * ids + seq[at + 1], *shared.value)
            yield from _emit(longer, serial)

    return cut_lineage(sequences.mapInArrow(run, SEQUENCE))


def _joined(placed: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Stored sequences whose places are looked up by a join; one group is one stored sequence."""
    known = placed.join(table, on).groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("have"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = _serial()
        for batch in batches:
            have = batch.column(0)
            offs, rows = np.asarray(have.offsets), have.flatten()
            pos, ids = (np.asarray(rows.field(i), np.int64) for i in (0, 1))
            for a, b in zip(offs[:-1] - offs[0], offs[1:] - offs[0]):
                seq = np.full(int(pos[a:b].max(initial=-1)) + 1, GAP, np.int64)
                seq[pos[a:b]] = ids[a:b]
                yield from _emit(seq, serial)

    return known.select("have").mapInArrow(run, SEQUENCE)


# --- tiles ----------------------------------------------------------------------


class Tiles:
    """Pair counts of a task: dense tiles by number, everything else as sorted coordinates."""

    def __init__(self, ids: int):
        self.across = ids // SIDE + 1
        if self.across * SIDE >= MOST_IDS:
            raise ValueError(f"{ids} numbers at one level; their square must fit 63 bits")
        self.dense: dict[int, np.ndarray] = {}
        self.sparse: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        tile = (left // SIDE) * self.across + right // SIDE
        local = (left % SIDE) * SIDE + right % SIDE
        names, owner, n = np.unique(tile, return_inverse=True, return_counts=True)
        full = (n >= DENSE_PAIRS) | np.isin(names, np.fromiter(self.dense, np.int64, len(self.dense)))
        if full.any():
            for x in np.flatnonzero(full):
                cells = np.bincount(local[owner == x], minlength=SIDE * SIDE)
                have = self.dense.get(int(names[x]))
                self.dense[int(names[x])] = cells if have is None else have + cells
            rest = ~full[owner]
            tile, local = tile[rest], local[rest]
        self.sparse.append(self._tally(tile * (SIDE * SIDE) + local))
        self.held += len(self.sparse[-1][1])
        if self.held > HELD_PAIRS:
            self._merge()

    @staticmethod
    def _tally(at: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates (tile and place in it) in order, and their counts."""
        if n is None:
            at = np.sort(at)
        else:
            order = np.argsort(at, kind="stable")
            at, n = at[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
        if n is None:
            return at[first], np.diff(np.concatenate([first, [len(at)]]))
        return at[first], np.add.reduceat(n, first) if len(at) else n

    def _merge(self) -> None:
        self.sparse = [self._tally(*(np.concatenate(x) for x in zip(*self.sparse)))]
        self.held = len(self.sparse[0][1])

    @property
    def full(self) -> bool:
        return self.held > HELD_PAIRS // 2 or len(self.dense) > HELD_TILES

    def take(self) -> pa.RecordBatch:
        """All counts as rows ``l, r, a``; nothing is held afterwards."""
        if self.sparse:
            self._merge()
        tiles, locals_, counts = [], [], []
        for name, cells in self.dense.items():
            at = np.flatnonzero(cells)
            tiles.append(np.full(len(at), name))
            locals_.append(at)
            counts.append(cells[at])
        for at, n in self.sparse:
            tiles.append(at // (SIDE * SIDE))
            locals_.append(at % (SIDE * SIDE))
            counts.append(n)
        none = [np.zeros(0, np.int64)]
        tile, local, n = (np.concatenate(x or none) for x in (tiles, locals_, counts))
        self.__init__(self.across * SIDE - 1)
        left, right = tile // self.across * SIDE + local // SIDE, tile % self.across * SIDE + local % SIDE
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (left, right, n)], ["l", "r", "a"])


def count_pairs(sequences: DataFrame, ids: int, least: int) -> DataFrame:
    """``l, r, a``: numbers that adjoin at least ``least`` times.  ``ids`` bounds the numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = Tiles(ids)
        for seq in _sequences(batches):
            for a in range(0, len(seq), PAIRS):
                part = seq[a : a + PAIRS + 1]
                both = (part[:-1] != GAP) & (part[1:] != GAP)
                tiles.add(part[:-1][both], part[1:][both])
                if tiles.full:
                    yield tiles.take()
        yield tiles.take()

    rows = sequences.mapInArrow(run, "l long, r long, a long")
    return rows.groupBy("l", "r").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


# --- phrases --------------------------------------------------------------------


def phrases(docs: DataFrame, least: int = LEAST, limit: int = LOOKUP_ROWS) -> tuple[DataFrame, list[DataFrame]]:
    """``lang, n`` of each language, and the frequent phrases of 1, 2, .. words.

    A phrase has ``id, lang, phrase, a`` and, from two words on, ``l, r`` (ids of the phrases without its last
    and its first word) and ``cuts``: (k, frequency of the first k words, frequency of the others).
    """
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    counted = cut_lineage(count_words(docs, least))
    totals = counted.where("word IS NULL").select("lang", F.col("a").alias("n"))
    ranked = dense_index(counted.where("word IS NOT NULL"), [F.col("a").desc(), "lang", "word"], "id")
    words = cut_lineage(ranked.select(F.col("id").cast("long").alias("id"), "lang", "word", "a"))
    size = words.count()
    levels = [words.select("id", "lang", F.col("word").alias("phrase"), "a", F.array("a").alias("heads"), F.array("a").alias("tails"))]
    sequences = word_sequences(docs, words, size, limit)
    for length in range(2, LONGEST + 1):
        ranked = dense_index(cut_lineage(count_pairs(sequences, size, least)), [F.col("a").desc(), "l", "r"], "id")
        found = cut_lineage(ranked.select(F.col("id").cast("long").alias("id"), "l", "r", "a"))
        ids, size = size, found.count()
        if length < LONGEST:
            sequences = phrase_sequences(sequences, found, size, ids, limit)
        # heads: frequencies of the first 1, 2, .. words; tails: of the last 1, 2, .. words.
        left = levels[-1].select(F.col("id").alias("l"), "lang", F.col("phrase").alias("_p"), "heads")
        right = levels[-1].select(F.col("id").alias("r"), F.substring_index("phrase", " ", -1).alias("_w"), "tails")
        both = found.join(left, "l").join(right, "r")
        levels.append(
            cut_lineage(
                both.select(
                    "id", "lang", F.concat_ws(" ", "_p", "_w").alias("phrase"), "a", "l", "r",
                    F.transform("heads", lambda h, k: F.struct((k + 1).alias("k"), h.alias("l"), F.element_at("tails", -(k + 1)).alias("r"))).alias("cuts"),
                    F.concat("heads", F.array("a")).alias("heads"), F.concat("tails", F.array("a")).alias("tails"),
                )
            )
        )
    return totals, levels


def collocations(docs: DataFrame, top: int = 2000, least: int = LEAST, limit: int = LOOKUP_ROWS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's ``top`` phrases.

    Lower-cased (A-Z) texts are split at ``[.,;:!?]`` and line ends into pieces, those at spaces and tabs into
    words.  ``a``: occurrences of the phrase; ``n``: words of the language; ``l``, ``r``: frequencies of both
    parts at the cut of the least score ``floor(2000000 a / (l + r))``, ties at the earliest cut.  A phrase
    inside a longer frequent one that has at least 80 % of its occurrences is left out.  Ranks: score
    descending, a descending, phrase ascending.

    A null language is ``und``, a null text empty.  Repeated rows count each.  A language without frequent
    phrases has no rows, nor has an empty table.  Other columns are ignored.
    """
    require(docs, "lang", "text")
    totals, levels = phrases(docs, least, limit)
    parts = []
    for x, level in enumerate(levels[1:], 1):
        cut = F.expr(
            f"array_min(transform(cuts, c -> struct(CAST({SCALE} AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0)) div "
            "(CAST(c.l AS DECIMAL(20,0)) + CAST(c.r AS DECIMAL(20,0))) AS score, c.k AS k, c.l AS l, c.r AS r)))"
        )
        own = level.select("id", "lang", "phrase", "a", cut.alias("cut"))
        if x + 1 < len(levels):
            longer = levels[x + 1].select(F.explode(F.array("l", "r")).alias("id"), F.col("a").alias("more")).groupBy("id").agg(F.max("more").alias("more"))
            own = own.join(longer, "id", "left").where(F.col("more").isNull() | (F.col("more") * 5 < F.col("a") * 4))
        parts.append(own.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
