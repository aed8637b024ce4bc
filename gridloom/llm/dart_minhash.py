"""Near-duplicates by DartMinHash: weighted signatures from hashed darts, joined by bands.

Each element owns a region as wide as its weight.  Darts fall on that region by a Poisson process
that only the hash of the element decides; a dart has a rank and a coordinate of the signature, and
each coordinate keeps its earliest dart.  Ranks are opened interval by interval until every
coordinate of a text has a dart, so a text costs its length plus about k log k darts, and two texts
agree in a coordinate with the probability of their weighted Jaccard similarity.

Signatures are cut into bands.  Texts that share a band are compared with one of them (the
exact similarity of their elements), links make components, and only where a band still holds
more than one component are its other pairs bounded and, where the bound allows, compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.components import components
from gridloom.llm.text import NOT_ALNUM, SpanHash, array_column, mix, passes, require, shingles, signed, words
from gridloom.session import cut_lineage

#: Words of a shingle, and the least similarity of near-duplicates.
SHINGLE = 5
SIMILARITY = 0.8
#: Bands and coordinates per band: at similarity 0.8 a pair shares no band once in 30,000 times.
BANDS, BAND_ROWS = 26, 5
#: Length of the first rank interval; each later interval ends at twice its start.
FIRST_RANKS = 1 / 64
#: Rounds in which other members of a band lead, before its remaining pairs are bounded and
#: compared.  Only the cost depends on it.
ROUNDS = 1
#: 64-bit words of a bitmap of missing cells.
GAP_WORDS = 4

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... events."""
    terms = [np.exp(-mean)]
    while len(terms) < 24:
        terms.append(terms[-1] * mean / len(terms))
    return np.minimum(np.cumsum(terms), 1.0)


def cells(column: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit regions of a batch of texts: the hash of each (shingle, how often it occurred before),
    row offsets, and a 16-byte digest of each text's words.

    A text of fewer words than a shingle, but not none, has one shingle of all its words.
    """
    w = words(column, NOT_ALNUM, lower=True)
    hashes = SpanHash(w.data)(w.starts, w.ends)
    gram, rows = shingles(hashes, w.rows, shingle)
    owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    key = mix(gram ^ mix(owner.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    first = np.flatnonzero(new)
    turn = np.empty(len(key), np.int64)
    turn[order] = np.arange(len(key)) - np.repeat(first, np.diff(np.concatenate([first, [len(key)]])))
    cell = mix(gram + turn.astype(np.uint64) * _GOLD)
    digest = np.stack([SpanHash(hashes, which)(w.rows[:-1], w.rows[1:]) for which in (0, 1)], 1)
    return cell, rows, digest


def signatures(cell: np.ndarray, rows: np.ndarray, k: int, first_ranks: float = FIRST_RANKS) -> np.ndarray:
    """The earliest dart (its hash) per row and coordinate; 0 throughout for a row without cells."""
    n = len(rows) - 1
    out = np.zeros(n * k, np.uint64)
    filled = np.zeros(n * k, bool)
    missing = np.where(np.diff(rows) > 0, k, 0)
    owner = np.repeat(np.arange(n), np.diff(rows))
    low, length, level = 0.0, first_ranks, 0
    while (missing > 0).any():
        active = (missing > 0)[owner]
        x, mine = cell[active], owner[active]
        # An interval longer than one is cut into pieces of one.
        pieces = max(1, round(length))
        mean = length / pieces
        if pieces > 1:
            piece = np.tile(np.arange(pieces, dtype=np.uint64), len(x))
            x, mine = np.repeat(x, pieces), np.repeat(mine, pieces)
        else:
            piece = np.zeros(len(x), np.uint64)
        x = mix(x + np.uint64((level + 1) * int(_GOLD) % (1 << 64)) + piece * np.uint64(0xD1B54A32D192ED03))
        count = np.searchsorted(_poisson(mean), (x >> np.uint64(11)).astype(np.float64) * 2.0**-53, "right")
        hit = np.flatnonzero(count)
        times = count[hit]
        which = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        source = np.repeat(hit, times)
        dart = mix(x[source] ^ mix(which.astype(np.uint64) + _GOLD))
        coordinate = ((dart >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        slot = mine[source] * k + coordinate
        open_ = ~filled[slot]
        slot, dart = slot[open_], dart[open_]
        # Rank within the interval: the piece, then the low half of the hash.
        rank = (piece[source][open_] << np.uint64(32)) | (dart & np.uint64(0xFFFFFFFF))
        order = np.lexsort((rank, slot))
        slot, dart = slot[order], dart[order]
        best = np.ones(len(slot), bool)
        best[1:] = slot[1:] != slot[:-1]
        slot, dart = slot[best], dart[best]
        out[slot] = mix(dart)
        filled[slot] = True
        missing = missing - np.bincount(slot // k, minlength=n)
        low += length
        length, level = low, level + 1
    return out.reshape(n, k)


def bands(signature: np.ndarray, n_bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """One hash per row and band; the number of the band is part of it."""
    cut = signature.reshape(len(signature), n_bands, rows)
    total = np.broadcast_to(np.arange(1, n_bands + 1, dtype=np.uint64) * _GOLD, cut.shape[:2]).copy()
    for j in range(rows):
        total = mix(total ^ cut[:, :, j])
    return total


def sketch(docs: DataFrame, shingle: int = SHINGLE, n_bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """``doc_id, text_hash, node, n_cells, bands`` for every row: ``node`` is the digest of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches):
            cell, rows, digest = cells(batch.column(2), shingle)
            value = bands(signatures(cell, rows, n_bands * band_rows), n_bands, band_rows)
            size = np.diff(rows)
            value = value[size > 0]
            at = np.concatenate([[0], np.cumsum(np.where(size > 0, n_bands, 0))])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([d.tobytes() for d in digest], pa.binary()),
                    pa.array(size, pa.int64()),
                    array_column(signed(np.ascontiguousarray(value.ravel())), at, pa.int64()),
                ],
                ["doc_id", "text_hash", "node", "n_cells", "bands"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return keyed.mapInArrow(run, f"doc_id {kind}, text_hash long, node binary, n_cells long, bands array<long>")


def _cells_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``node, cells`` (sorted) of the texts named by ``wanted (doc_id, text_hash, node)``, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches):
            cell, rows, _ = cells(batch.column(1), shingle)
            cell = signed(cell)
            owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), array_column(cell[np.lexsort((cell, owner))], rows, pa.int64())], ["node", "cells"]
            )

    w = wanted.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "node")
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = texts.join(w, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h"))).select("node", "text")
    return cut_lineage(found.mapInArrow(run, "node binary, cells array<long>").dropDuplicates(["node"]))


def _distances(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """``pairs (a, b)`` with ``distance``, one less their exact weighted Jaccard similarity."""
    left = of.select(F.col("node").alias("a"), F.col("cells").alias("_x"))
    right = of.select(F.col("node").alias("b"), F.col("cells").alias("_y"))
    common = F.size(F.array_intersect("_x", "_y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", (1 - common / (F.size("_x") + F.size("_y") - common)).alias("distance"))


def _mixed(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows ``band, node, leader, root`` of bands whose members lie in several components."""
    placed = shared.join(roots, "node", "left").select("band", "node", "leader", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("band")
    return placed.join(mixed, "band")


def _against_leader(pairs: DataFrame, content: DataFrame) -> DataFrame:
    """``node, leader, n_led`` (cells of the leader)``, beyond`` (cells that the leader lacks)`` and ``gaps``.

    ``gaps`` is a bitmap of the leader's cells that the node lacks, by hash, in 64-bit words: two
    nodes together lack at least as many of the leader's cells as their bitmaps together have bits.
    """
    left = content.select("node", F.col("cells").alias("_x"))
    right = content.select(F.col("node").alias("leader"), F.col("cells").alias("_y"))
    both = pairs.join(left, "node").join(right, "leader").select("node", "leader", "_x", "_y", F.array_except("_y", "_x").alias("_lack"))

    def word(i: int) -> Column:
        mine = F.filter("_lack", lambda c: F.pmod(F.shiftright(c, 6), F.lit(GAP_WORDS)) == i)
        bits = F.transform(mine, lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(c, F.lit(64)).cast("int")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda w, b: w.bitwiseOR(b))

    lack = F.size("_lack")
    return both.select(
        "node", "leader", F.size("_y").alias("n_led"), (F.size("_x") - F.size("_y") + lack).alias("beyond"),
        F.array(*[word(i) for i in range(GAP_WORDS)]).alias("gaps"),
    )


def _remaining(left: DataFrame, nodes: DataFrame, content: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: the pairs of members of different components in a band that can still be links.

    Exact bounds rule the others out.  Cells that no other of these texts has are common to no
    pair, so of the cells beyond the leader's at most the rest are; and of the leader's cells a pair
    has at most those that neither lacks.  The similarity is at most c / (sizes - c) for the sum c
    of both.  A pair is made once, in the first band that it shares.
    """
    names = left.select("node").distinct()
    alone = (
        content.join(names, "node").select("node", F.explode("cells").alias("cell"))
        .groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1")
        .groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    )
    known = nodes.select("node", "n_cells", "bands").join(names, "node").join(alone, "node", "left").select(
        "node", "n_cells", F.coalesce("alone", F.lit(0)).alias("alone"), "bands"
    )
    # A text with too many cells of its own has no link at all; a leader has met all the others.
    open_ = (F.col("n_cells") - F.col("alone") >= similarity * F.col("n_cells")) & (F.col("node") != F.col("leader"))
    rows = cut_lineage(left.join(known, "node").where(open_))
    led = _against_leader(rows.select("node", "leader").distinct(), content)
    rows = cut_lineage(rows.join(led, ["node", "leader"]).withColumn("rest", F.col("beyond") - F.col("alone")))
    x, y = rows.alias("x"), rows.alias("y")
    lacked = sum((F.bit_count(F.col("x.gaps")[i].bitwiseOR(F.col("y.gaps")[i])) for i in range(GAP_WORDS)), F.lit(0))
    both = F.col("x.n_led") - lacked + F.least("x.rest", "y.rest")
    # Bands are hashes with their number in them, so equal values are the same band.
    shares = F.array_position(F.transform(F.arrays_zip(F.col("x.bands").alias("p"), F.col("y.bands").alias("q")), lambda z: z["p"] == z["q"]), True)
    here = F.array_position("x.bands", F.col("x.band"))
    return x.join(
        y,
        (F.col("x.band") == F.col("y.band")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
        & (both >= similarity * (F.col("x.n_cells") + F.col("y.n_cells") - both))
        & (shares == here),
    ).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def near_duplicates(
    docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, n_bands: int = BANDS, band_rows: int = BAND_ROWS
) -> DataFrame:
    """``doc_id, text_hash, node, class_id, class_size, keeper`` for every row of ``docs``.

    Classes are the components of links between texts of weighted Jaccard similarity
    ``similarity`` or more on word shingles (words ``[0-9a-z]`` and all beyond ASCII, A-Z lowered);
    texts of the same words are one node.  ``class_id`` is the least doc_id of the class,
    ``class_size`` its rows, and ``keeper`` holds for the rows of the one (id, text) that represents
    it: the least id (null last), then the least text hash.

    Texts without words (null, empty, signs only) are classes of their own.  Rows that share an id
    are told apart by their text; equal rows are in one class.  Null ids belong to classes like any
    others; a class of null ids only has a null class_id.  Empty table: no rows.  Other columns are
    ignored.
    """
    require(docs, "doc_id", "text")
    drawn = cut_lineage(sketch(docs, shingle, n_bands, band_rows))
    filled = drawn.where("n_cells > 0")
    # One row per node, whatever the number of copies: partial aggregation before the shuffle.
    nodes = cut_lineage(
        filled.groupBy("node").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("row"),
            F.first("n_cells").alias("n_cells"),
            F.first("bands").alias("bands"),
        )
    )
    members = nodes.select("node", F.explode("bands").alias("band"))
    led = members.groupBy("band").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = cut_lineage(members.join(led, "band"))
    pairs = shared.where(F.col("node") != F.col("leader")).select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    rows = shared.select("node").distinct().join(nodes.select("node", "row"), "node").select("row.doc_id", "row.text_hash", "node")
    content = _cells_of(docs, rows, shingle)
    measured = cut_lineage(_distances(pairs, content))
    close = 1 - similarity + 1e-12
    roots = cut_lineage(components(measured.where(F.col("distance") <= close).select("a", "b")))

    # Bands that still hold several components: other members lead in turn.
    for turn in range(ROUNDS):
        left = cut_lineage(_mixed(shared, roots))
        if left.isEmpty():
            break
        chosen = left.groupBy("band").agg(F.min(F.struct(F.xxhash64("node", "band", F.lit(turn)).alias("h"), "node", "root")).alias("_l"))
        tried = left.join(chosen, "band").where(F.col("root") != F.col("_l.root"))
        new = tried.select(F.least("node", "_l.node").alias("a"), F.greatest("node", "_l.node").alias("b")).distinct()
        found = _distances(new, content).where(F.col("distance") <= close).select("a", "b")
        roots = cut_lineage(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found)))
    left = cut_lineage(_mixed(shared, roots))
    if not left.isEmpty():
        rest = _remaining(left, nodes, content, similarity)
        found = _distances(rest, content).where(F.col("distance") <= close).select("a", "b")
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))

    labelled = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    rooted = cut_lineage(filled.select("doc_id", "text_hash", "node").join(labelled, "node"))
    classes = rooted.groupBy("root").agg(
        F.min("doc_id").alias("class_id"),
        F.count(F.lit(1)).alias("class_size"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("_keep"),
    )
    keeper = F.col("doc_id").eqNullSafe(F.col("_keep.doc_id")) & (F.col("text_hash") == F.col("_keep.text_hash"))
    single = drawn.where("n_cells = 0").select("doc_id", "text_hash", "node", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("keeper"))
    return rooted.join(classes, "root").select("doc_id", "text_hash", "node", "class_id", "class_size", keeper.alias("keeper")).unionByName(single)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without near-duplicates, with all their columns: one row of each class.

    Which row: that of the least id (null last); of rows equal in id and text any one.  Texts
    without words all stay.
    """
    found = near_duplicates(docs, **options)
    gone = found.where(~F.col("keeper")).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct()
    own = F.xxhash64(docs["text"])
    stay = docs.join(gone, docs["doc_id"].eqNullSafe(gone["_d"]) & (own == gone["_h"]), "left_anti")
    twins = found.where("keeper AND class_size > 1").groupBy("doc_id", "text_hash").count().where("count > 1")
    twins = cut_lineage(twins.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")))
    if twins.isEmpty():
        return stay
    same = stay["doc_id"].eqNullSafe(twins["_d"]) & (F.xxhash64(stay["text"]) == twins["_h"])
    return stay.join(twins, same, "left_anti").unionByName(stay.join(twins, same, "left_semi").dropDuplicates(["doc_id", "text"]))
