"""Thresholds per gene from one sorted table of values.

Values are sorted by range over (gene, value) once.  Each range is cut into blocks, and a block is known by
its first and last value, its count, its sum and the smallest step inside it.  Sums below any value are then
a prefix of whole blocks and a part of one block, so the iteration runs over block summaries, and only the
few blocks it passes through are read as values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.skew import keyed_join
from gridloom.session import cut_lineage

# Histogram bins and Li iterations.
YEN_BINS = 256
LI_MAX_ITERATIONS = 250
#: Values of a block.
BLOCK_ROWS = 4096


def sorted_values(scores: DataFrame, gene: str, value: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(gene, _part, _block, _v, _w, _step)``, written: distinct values with their counts, in blocks of sorted ranges.

    ``_step`` is the distance from the value before it in the same block.  Null values and null genes are left out.
    """
    kept = scores.where(F.col(value).isNotNull() & F.col(gene).isNotNull()).select(gene, F.col(value).cast("double").alias("_v"))
    merged = kept.groupBy(gene, "_v").agg(F.count(F.lit(1)).cast("double").alias("_w"))
    ranged = merged.repartitionByRange(F.col(gene), F.col("_v")).sortWithinPartitions(gene, "_v")
    ranged = ranged.withColumn("_part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count, block, last = None, 0, -1, 0.0
        size = block_rows
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            genes = batch.column(0).dictionary_encode()
            # Genes are runs; codes of a batch are compared by value with the run before.
            code = np.asarray(genes.indices.fill_null(-1))
            starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            v = np.asarray(batch.column(1))
            blocks, steps = np.zeros(n, np.int64), np.full(n, np.nan)
            for a, b in zip(starts, [*starts[1:], n]):
                name = batch.column(0)[int(a)].as_py()
                if block < 0 or name != now:
                    now, count, block = name, 0, block + 1
                    fresh = True
                else:
                    fresh = False
                place = count + np.arange(b - a)
                blocks[a:b] = block + place // size
                before = np.concatenate([[np.nan if fresh else last], v[a : b - 1]])
                steps[a:b] = np.where(place % size == 0, np.nan, v[a:b] - before)
                block, count, last = int(blocks[b - 1]), int(place[-1] % size) + 1, v[b - 1]
                if count == size:
                    block, count = block + 1, 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), pa.array(blocks), batch.column(1), batch.column(2), pa.array(steps, from_pandas=True)],
                [gene, "_part", "_block", "_v", "_w", "_step"],
            )

    kind = scores.schema[gene].dataType.simpleString()
    return cut_lineage(ranged.mapInArrow(run, f"`{gene}` {kind}, _part int, _block long, _v double, _w double, _step double"))


def block_summaries(values: DataFrame, gene: str) -> DataFrame:
    """``(gene, _part, _block, _first, _last, _n, _s, _k, _gap)``; ``_s`` is the sum of the distances from ``_first``.

    ``_gap`` is the smallest step up to the block's last value, the one from the block before included.
    """
    spread = values.groupBy(gene, "_part", "_block").agg(
        F.min("_v").alias("_first"), F.max("_v").alias("_last"), F.sum("_w").alias("_n"), F.sum(F.col("_w") * F.col("_v")).alias("_sv"),
        F.count(F.lit(1)).alias("_k"), F.min("_step").alias("_gap"),
    )
    jump = F.col("_first") - F.lag("_last").over(Window.partitionBy(gene).orderBy("_first"))
    return spread.withColumn("_gap", F.least("_gap", jump)).withColumn("_s", F.col("_sv") - F.col("_n") * F.col("_first")).drop("_sv")


class _Gene:
    """Block summaries of one gene in order, and the values of some of its blocks."""

    def __init__(self, blocks: pd.DataFrame, values: pd.DataFrame | None):
        blocks = blocks.sort_values("_first")
        self.low = float(blocks["_first"].iloc[0])
        self.first, self.last = (blocks[c].to_numpy(float) - self.low for c in ("_first", "_last"))
        self.n = blocks["_n"].to_numpy(float)
        self.s = blocks["_s"].to_numpy(float) + self.n * self.first
        self.names = list(zip(blocks["_part"].tolist(), blocks["_block"].tolist()))
        self.upto_n, self.upto_s = (np.concatenate([[0.0], np.cumsum(x)]) for x in (self.n, self.s))
        gaps = blocks["_gap"].to_numpy(float)
        self.gap = float(np.nanmin(gaps)) if not np.isnan(gaps).all() else None
        self.inside: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        if values is not None:
            for name, part in values.groupby(["_part", "_block"], sort=False):
                part = part.sort_values("_v")
                v, w = part["_v"].to_numpy(float) - self.low, part["_w"].to_numpy(float)
                self.inside[tuple(map(int, name))] = (v, np.concatenate([[0.0], np.cumsum(w)]), np.concatenate([[0.0], np.cumsum(w * v)]))

    def below(self, t: float, guess: bool = False) -> tuple[float, float] | int:
        """Count and sum of the values at or below ``t``, or the number of the block that must be read first."""
        b = int(np.searchsorted(self.last, t, "right"))
        if b == len(self.last) or self.first[b] > t:
            return self.upto_n[b], self.upto_s[b]
        have = self.inside.get(self.names[b])
        if have is not None:
            at = int(np.searchsorted(have[0], t, "right"))
            return self.upto_n[b] + have[1][at], self.upto_s[b] + have[2][at]
        if not guess:
            return b
        share = (t - self.first[b]) / max(self.last[b] - self.first[b], 1e-300)
        return self.upto_n[b] + share * self.n[b], self.upto_s[b] + share * share * self.s[b]

    def following(self, t: float, guess: bool = False):
        """The next threshold (None: the iteration cannot move), or the number of a block to read."""
        got = self.below(t, guess)
        if isinstance(got, int):
            return got
        n, s = got
        back, fore = s / max(n, 1e-300), (self.upto_s[-1] - s) / max(self.upto_n[-1] - n, 1.0)
        if back <= 0 or fore <= 0 or back == fore:
            return None
        return (back - fore) / (np.log(back) - np.log(fore))


def _li(gene: _Gene, t: float | None, step: int, max_iter: int) -> tuple[float, int, bool, bool, list[tuple[int, int]]]:
    """Go on until the iteration ends or needs values: (t, step, done, converged, blocks to read)."""
    if gene.gap is None:
        return gene.low, step, True, True, []
    t = gene.upto_s[-1] / gene.upto_n[-1] if t is None else t
    while True:
        moved = gene.following(t)
        if isinstance(moved, int):
            break
        step += 1
        if moved is None:
            return t + gene.low, step, True, True, []
        near = abs(moved - t) <= gene.gap / 2
        t = moved
        if near or step > max_iter:
            return t + gene.low, step, True, step <= max_iter, []
    # The blocks that the iteration will pass through, as far as summaries can tell, and their neighbours.
    need, at, ahead = set(), t, step
    for _ in range(max_iter):
        b = int(np.searchsorted(gene.last, at, "right"))
        need.update(range(max(0, b - 1), min(len(gene.last), b + 2)))
        after = gene.following(at, guess=True)
        ahead += 1
        if after is None or abs(after - at) <= gene.gap / 2 or ahead > max_iter:
            break
        at = after
    return t, step, False, False, [gene.names[b] for b in sorted(need)]


def li_of(values: DataFrame, blocks: DataFrame, gene: str, max_iter: int = LI_MAX_ITERATIONS) -> DataFrame:
    """``(gene, li, converged)`` from ``sorted_values`` and ``block_summaries``.

    All genes move together; a round ends where a gene needs values that were not read yet.  Most take two.
    """
    kind = blocks.schema[gene].dataType.simpleString()
    out = f"`{gene}` {kind}, _t double, _step int, _done boolean, converged boolean, _need array<struct<p: int, b: long>>"

    def move(found: pd.DataFrame, read: pd.DataFrame | None, t: float | None, step: int) -> pd.DataFrame:
        t, step, done, converged, need = _li(_Gene(found, read), t, step, max_iter)
        return pd.DataFrame({gene: [found[gene].iloc[0]], "_t": [t], "_step": [step], "_done": [done], "converged": [converged], "_need": [[{"p": p, "b": b} for p, b in need]]})

    state = cut_lineage(blocks.groupBy(gene).applyInPandas(lambda found: move(found, None, None, 1), out))
    finished = []
    while True:
        finished.append(state.where("_done"))
        rest = state.where(~F.col("_done"))
        if rest.isEmpty():
            break
        asked = rest.select(gene, F.explode("_need").alias("x")).select(gene, F.col("x.p").alias("_part"), F.col("x.b").alias("_block"))
        read = keyed_join(values.select(gene, "_part", "_block", "_v", "_w"), asked, [gene, "_part", "_block"])
        mine = blocks.join(rest.select(gene, "_t", "_step"), gene)

        def go_on(found: pd.DataFrame, read: pd.DataFrame) -> pd.DataFrame:
            if not len(found):
                return pd.DataFrame({gene: [], "_t": [], "_step": [], "_done": [], "converged": [], "_need": []})
            return move(found, read, float(found["_t"].iloc[0]), int(found["_step"].iloc[0]))

        state = cut_lineage(mine.groupBy(gene).cogroup(read.groupBy(gene)).applyInPandas(go_on, out))
    whole = finished[0]
    for part in finished[1:]:
        whole = whole.unionByName(part)
    return whole.select(gene, F.when(F.col("converged"), F.col("_t")).otherwise(F.lit(float("nan"))).alias("li"), "converged")


def yen_of(values: DataFrame, blocks: DataFrame, gene: str, bins: int = YEN_BINS) -> DataFrame:
    """Yen, Chang & Chang (1995) per gene: ``(gene, yen)``.

    Equal-width bins over each gene's range; the threshold is the centre of the first
    bin with the largest criterion.  Only bin counts (at most ``bins`` per gene) are
    ordered; a gene with a single value is its own threshold.
    """
    ranges = blocks.groupBy(gene).agg(F.min("_first").alias("_lo"), F.max("_last").alias("_hi"))
    width = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    position = F.floor((F.col("_v") - F.col("_lo")) / width * F.lit(bins)).cast("int")
    binned = keyed_join(values.select(gene, "_v", "_w"), ranges, [gene]).withColumn("_bin", F.least(F.coalesce(position, F.lit(0)), F.lit(bins - 1)))
    counts = binned.groupBy(gene, "_lo", "_hi", "_bin").agg(F.sum("_w").alias("_c"))
    ordered = Window.partitionBy(gene).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(gene)
    c = F.col("_c")
    steps = counts.select(
        gene,
        "_lo",
        "_hi",
        "_bin",
        F.sum(c).over(ordered).alias("_below"),
        F.sum(c * c).over(ordered).alias("_sq"),
        F.sum(c).over(whole).alias("_all"),
        F.sum(c * c).over(whole).alias("_sq_all"),
    )
    split = F.col("_below") * (F.col("_all") - F.col("_below"))
    criterion = F.log(split * split / F.nullif(F.col("_sq") * (F.col("_sq_all") - F.col("_sq")), F.lit(0.0)))
    scored = steps.withColumn("_crit", F.round(F.when(F.col("_below") < F.col("_all"), criterion), 9))
    best = scored.groupBy(gene, "_lo", "_hi").agg(F.max(F.struct("_crit", (-F.col("_bin")).alias("m"))).alias("_b"))
    centre = F.col("_lo") + (F.lit(0.5) - F.col("_b.m")) * (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    return best.select(gene, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(centre).alias("yen"))


def _sorted(scores: DataFrame, gene: str, value: str, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    values = sorted_values(scores, gene, value, block_rows)
    return values, cut_lineage(block_summaries(values, gene))


def yen_thresholds(scores: DataFrame, *, gene: str = "gene_encoding", value: str = "similarity", bins: int = YEN_BINS) -> DataFrame:
    """``(gene, yen)``; see ``yen_of``."""
    return yen_of(*_sorted(scores, gene, value), gene, bins)


def li_thresholds(scores: DataFrame, *, gene: str = "gene_encoding", value: str = "similarity", max_iter: int = LI_MAX_ITERATIONS,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Li & Tam (1998) minimum cross-entropy per gene: ``(gene, li, converged)``.

    From the mean on, the next threshold comes from the means of the values at or below the
    current one and of those above, until it moves by no more than half the smallest gap between
    values, or ``max_iter`` steps are over.
    """
    return li_of(*_sorted(scores, gene, value, block_rows), gene, max_iter)


def gene_thresholds(scores: DataFrame, *, gene: str = "gene_encoding", value: str = "similarity") -> DataFrame:
    """``(gene, similarity_threshold, converged)``: the smaller of Yen and Li, from one sorted table.

    A gene whose iteration does not converge gets the median of the other thresholds.
    """
    values, blocks = _sorted(scores, gene, value)
    both = yen_of(values, blocks, gene).join(li_of(values, blocks, gene), gene)
    return backfill_thresholds(both.select(gene, F.least("yen", "li").alias("similarity_threshold"), "converged"))


def backfill_thresholds(thresholds: DataFrame) -> DataFrame:
    """Fill thresholds that did not converge with the median of those that did (one row per gene)."""
    fallback = thresholds.where("converged").agg(F.percentile("similarity_threshold", F.lit(0.5))).scalar()
    return thresholds.withColumn(
        "similarity_threshold", F.when(F.col("converged"), F.col("similarity_threshold")).otherwise(fallback)
    )
