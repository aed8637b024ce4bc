"""Language-model scores from a probabilistic suffix tree.

A text is the byte string of its lower-cased words, one space between words and one line feed as
the end.  All contexts of up to ``DEPTH`` bytes are counted over the whole training corpus; a
context is retained if it is frequent enough and its next-byte distribution diverges from that of
the context one byte shorter.  Distributions are smoothed into those of their parents, and every
byte is scored in the state of the longest retained suffix of what stands before it.

The word counts of the base score are exact counts over the corpus, by 64-bit fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.text import BATCH_ROWS, LOWER, WHITE, SpanHash, Words, array_column, flat, is_fold, passes, require, signed, spans
from gridloom.session import cut_lineage

#: Longest context in bytes; a context and its next byte fill 48 bits.
DEPTH = 5
#: Least share of all positions that a context needs, and of that share a next byte in it: at most
#: 10 / MIN_SHARE entries per depth can exist, which bounds the model whatever the corpus.
MIN_SHARE = 1e-6
MIN_NEXT = 0.1
#: Least divergence (nats per byte) of a context from its parent.
MIN_DIVERGENCE = 0.002
#: Words of at least this share of all tokens are looked up in place; there are at most
#: 1 / COMMON_SHARE of them.  The others are joined, and none of those is frequent.
COMMON_SHARE = 1e-6
#: Distinct keys of both kinds that a task holds before it passes its counts on, and bytes of text of
#: one pass: together they bound a worker's memory.
HELD_KEYS = 400_000
PASS_BYTES = 1 << 20

END = 0x0A
#: The token that closes each text.
END_TOKEN = np.int64(1)
ROW_BITS = 10
assert BATCH_ROWS < 1 << ROW_BITS


def stream(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Scored bytes of each row and their row offsets."""
    size = w.ends - w.starts + 1
    ends = np.cumsum(size)
    begins = ends - size
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(begins - w.starts, size)
    out = w.data[np.minimum(at, max(len(w.data) - 1, 0))] if len(at) else np.zeros(0, np.uint8)
    out = out.copy()
    n = w.counts
    if len(ends):
        out[ends - 1] = 0x20
        out[ends[w.rows[1:][n > 0] - 1] - 1] = END
    edges = np.concatenate([[0], ends])[w.rows]
    empty = np.flatnonzero(n == 0)
    out = np.insert(out, edges[empty], END)
    return out, edges + np.concatenate([[0], np.cumsum(n == 0)])


def grams(text: np.ndarray, rows: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Each byte with the ``depth`` bytes before it, the byte itself lowest; a row starts after an end."""
    # ``depth`` ends stand before each row, so that one shift serves all rows.
    at = np.arange(len(text)) + np.repeat(depth * np.arange(1, len(rows)), np.diff(rows))
    padded = np.full(len(text) + depth * (len(rows) - 1), END, np.uint8)
    padded[at] = text
    code = np.zeros(len(padded), np.int64)
    inner = code[depth:]
    for d in range(depth, -1, -1):
        inner <<= 8
        inner |= padded[depth - d : len(padded) - d]
    return code[at]


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their total counts."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    total = np.diff(np.concatenate([first, [len(keys)]])) if counts is None else np.add.reduceat(counts, first)
    return keys[first], total


class _Held:
    """Counts of one kind that a task has not passed on yet."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(tally(keys))
        self.size += len(self.parts[-1][0])
        if self.size > HELD_KEYS // 2:
            self.parts = [tally(*map(np.concatenate, zip(*self.parts)))]
            self.size = len(self.parts[0][0])

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = tally(*map(np.concatenate, zip(*self.parts))) if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.parts, self.size = [], 0
        return out


def _read(column: pa.Array) -> tuple[Words, np.ndarray]:
    data, offs = flat(column)
    w = spans(LOWER[data], offs, WHITE)
    return w, signed(SpanHash(w.data)(w.starts, w.ends))


def count(docs: DataFrame) -> DataFrame:
    """``kind`` (0 word, 1 context with next byte), ``key`` and ``n`` over all texts of ``docs``, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (_Held(), _Held())

        def out(kind: int) -> pa.RecordBatch:
            keys, n = held[kind].take()
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["kind", "key", "n"]
            )

        for batch in passes(batches, "text", PASS_BYTES):
            w, hashes = _read(batch.column(0))
            held[0].add(np.concatenate([hashes, np.full(batch.num_rows, END_TOKEN)]))
            held[1].add(grams(*stream(w)))
            if held[0].size + held[1].size > HELD_KEYS:
                yield out(0)
                yield out(1)
        yield out(0)
        yield out(1)

    rows = docs.select("text").mapInArrow(run, "kind int, key long, n long")
    return cut_lineage(rows.groupBy("kind", "key").agg(F.sum("n").alias("n")))


@dataclass
class SuffixTree:
    """Per depth: retained contexts with their totals and successor numbers, and (context, byte) counts."""

    root: np.ndarray
    contexts: list[np.ndarray]
    totals: list[np.ndarray]
    fans: list[np.ndarray]
    entries: list[np.ndarray]
    counts: list[np.ndarray]

    def probability(self, code: np.ndarray) -> np.ndarray:
        """Of the lowest byte of each code, in the state of the longest retained suffix of the others."""
        p = self.root[code & 0xFF]
        alive = np.arange(len(code))
        for d in range(1, len(self.contexts) + 1):
            known = self.contexts[d - 1]
            if not len(known) or not len(alive):
                break
            context = (code[alive] >> 8) & ((1 << (8 * d)) - 1)
            at = np.minimum(np.searchsorted(known, context), len(known) - 1)
            hit = known[at] == context
            alive, at = alive[hit], at[hit]
            entry = code[alive] & ((1 << (8 * (d + 1))) - 1)
            e = np.minimum(np.searchsorted(self.entries[d - 1], entry), len(self.entries[d - 1]) - 1)
            n = np.where(self.entries[d - 1][e] == entry, self.counts[d - 1][e], 0)
            fan = self.fans[d - 1][at]
            p[alive] = (n + fan * p[alive]) / (self.totals[d - 1][at] + fan)
        return p


def grow(counted: DataFrame, depth: int = DEPTH, min_share: float = MIN_SHARE, min_divergence: float = MIN_DIVERGENCE) -> SuffixTree:
    """The tree from the table of ``count``.

    Shorter contexts are sums over longer ones, taken in Spark; the frequent part, bounded by
    ``min_share``, comes to the driver, where the divergence tests prune it.
    """
    long = counted.where("kind = 1")
    levels = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col("key").bitwiseAND(F.lit((1 << (8 * (d + 1))) - 1)).alias("e")) for d in range(depth + 1)]))
    entries = long.select(levels.alias("x"), "n").groupBy("x.d", "x.e").agg(F.sum("n").alias("n"))
    total = long.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    least = max(1.0, MIN_NEXT * min_share * total)
    got = entries.where(F.col("n") >= least).toArrow()
    return prune(*(np.asarray(got.column(c)) for c in ("d", "e", "n")), min_share * total, depth, min_divergence)


def prune(level: np.ndarray, entry: np.ndarray, n: np.ndarray, least: float, depth: int, min_divergence: float) -> SuffixTree:
    """The tree of contexts that occur ``least`` times and diverge from their parents."""
    counts0 = np.zeros(256)
    counts0[entry[level == 0]] = n[level == 0]
    root = (counts0 + 1.0) / (counts0.sum() + 256.0)
    tree = SuffixTree(root, [], [], [], [], [])
    keep: list[np.ndarray] = []
    for d in range(1, depth + 1):
        pick = level == d
        order = np.argsort(entry[pick])
        e, c = entry[pick][order], n[pick][order].astype(np.float64)
        contexts, first = np.unique(e >> 8, return_index=True)
        sums = np.add.reduceat(c, first) if len(c) else np.zeros(0)
        fan = np.diff(np.concatenate([first, [len(e)]])).astype(np.float64)
        # Divergence of each context from the tree that is one byte shallower.
        parent = tree.probability(e.copy()) if len(e) else np.zeros(0)
        owner = np.repeat(np.arange(len(contexts)), fan.astype(np.int64))
        share = c / sums[owner] if len(c) else c
        divergence = np.bincount(owner, share * np.log(share / parent), minlength=len(contexts)) if len(c) else np.zeros(0)
        tree.contexts.append(contexts)
        tree.totals.append(sums)
        tree.fans.append(fan)
        tree.entries.append(e)
        tree.counts.append(c)
        keep.append((sums >= least) & (divergence >= min_divergence))
    # A retained context keeps its suffixes, so that states are found by lengthening.
    for d in range(depth, 1, -1):
        mask = (1 << (8 * (d - 1))) - 1
        keep[d - 2] |= np.isin(tree.contexts[d - 2], tree.contexts[d - 1][keep[d - 1]] & mask)
    for d in range(depth):
        kept = keep[d]
        mine = np.isin(tree.entries[d] >> 8, tree.contexts[d][kept])
        tree.entries[d], tree.counts[d] = tree.entries[d][mine], tree.counts[d][mine]
        tree.contexts[d], tree.totals[d], tree.fans[d] = tree.contexts[d][kept], tree.totals[d][kept], tree.fans[d][kept]
    return tree


def score(docs: DataFrame, train: Column, common_share: float = COMMON_SHARE) -> DataFrame:
    """Scores of every row of ``docs`` under counts and a tree learned from the rows where ``train`` holds.

    Returns ``doc_id, held_out`` (not learned from)``, n_tokens, n_known, train_tokens, base_score, score``.

    Null or empty text: the end token alone.  A null ``train`` counts as false.  Rows equal in id
    and text have equal results, each its own row.  Without training rows every word is unknown
    and every byte equally likely.  Empty table: no rows.  Other columns are ignored.
    """
    require(docs, "doc_id", "text")
    spark = docs.sparkSession
    learned = F.coalesce(train, F.lit(False))
    counted = count(docs.where(learned))
    totals = counted.where("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_all, norm = totals["n"], totals["n"] + 0.1 * (totals["v"] + 1)
    least = common_share * n_all
    common = counted.where((F.col("kind") == 0) & (F.col("n") >= least)).select("key", "n").toArrow()
    order = np.argsort(np.asarray(common.column("key")))
    known = tuple(np.asarray(common.column(c))[order] for c in ("key", "n"))
    model = spark.sparkContext.broadcast((known, grow(counted)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (keys, n), tree = model.value
        logs = np.log10((n + 0.1) / norm)
        for batch in passes(batches, "text", PASS_BYTES):
            w, hashes = _read(batch.column(batch.schema.get_field_index("text")))
            rows = batch.num_rows
            # The base score: common words here, the others by join.
            token = np.concatenate([hashes, np.full(rows, END_TOKEN)])
            owner = np.concatenate([w.row_of, np.arange(rows)])
            at = np.minimum(np.searchsorted(keys, token), max(len(keys) - 1, 0))
            hit = keys[at] == token if len(keys) else np.zeros(len(token), bool)
            base = np.bincount(owner[hit], logs[at[hit]] if len(keys) else None, minlength=rows).astype(np.float64)
            rare, mine = token[~hit], owner[~hit]
            by_row = np.argsort(mine, kind="stable")
            edges = np.concatenate([[0], np.cumsum(np.bincount(mine, minlength=rows))])
            # The tree: distinct contexts of the batch once, then back to their rows.
            text, at_row = stream(w)
            place = np.sort(grams(text, at_row) << ROW_BITS | np.repeat(np.arange(rows), np.diff(at_row)))
            code = place >> ROW_BITS
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            value = np.repeat(np.log10(tree.probability(code[first])), np.diff(np.concatenate([first, [len(code)]])))
            total = np.bincount(place & ((1 << ROW_BITS) - 1), value, minlength=rows)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(batch.schema.get_field_index(c)) for c in ("row", "doc_id", "held_out")),
                    pa.array(w.counts + 1, pa.int64()),
                    pa.array(np.bincount(owner[hit], minlength=rows), pa.int64()),
                    pa.array(base),
                    pa.array(total),
                    array_column(rare[by_row], edges, pa.int64()),
                ],
                ["row", "doc_id", "held_out", "n_tokens", "n_common", "base", "score", "rare"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    # The row's key: its id and text.  Twins are told apart again at the end, by their number.
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", (~learned).alias("held_out"), "text")
    local = cut_lineage(
        keyed.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_common long, base double, score double, rare array<long>")
    )
    others = counted.where((F.col("kind") == 0) & (F.col("n") < least)).select(F.col("key").alias("word"), F.log10((F.col("n") + 0.1) / F.lit(norm)).alias("l"))
    joined = local.select("row", F.explode("rare").alias("word")).join(others, "word").select("row", "l")
    own = ["doc_id", "held_out", "n_tokens", "n_common", "base", "score"]
    types = {f.name: f.dataType for f in local.schema}
    both = local.select("row", *own, F.size("rare").cast("long").alias("n_rare"), F.lit(1).alias("copy"), F.lit(None).cast("double").alias("l")).unionByName(
        joined.select("row", *[F.lit(None).cast(types[c]).alias(c) for c in own], F.lit(None).cast("long").alias("n_rare"), F.lit(None).cast("int").alias("copy"), "l")
    )
    merged = both.groupBy("row").agg(
        *[F.max(c).alias(c) for c in [*own, "n_rare"]], F.count("copy").alias("copies"), F.coalesce(F.sum("l"), F.lit(0.0)).alias("l"), F.count("l").alias("found")
    )
    found = (F.col("found") / F.col("copies")).cast("long")
    unknown = float(np.log10(0.1 / norm))
    return merged.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_common") + found).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("l") / F.col("copies") + (F.col("n_rare") - found) * unknown).alias("base_score"),
        "score",
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")


def outside_fold(modulus: int = 10, remainder: int = 0) -> Column:
    """True for the rows to learn from: all but one fold of the ids."""
    return ~is_fold("doc_id", modulus, remainder)
