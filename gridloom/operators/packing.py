"""Packing tiles into batches of bounded size.

Tiles are few per point but still grow with the data, so packing runs per group of
neighbouring tile ids.  Up to ``group_size`` tiles it is the plain algorithm; beyond
that every group opens its own bins, which never exceed the capacity either.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.numbering import prefix_offsets

ALGORITHMS = ("best_fit", "first_fit", "harmonic")


def _accepted(sizes, capacity, skip_too_big):
    fits = [(float(v), i) for i, v in enumerate(sizes) if 0 < v <= capacity]
    if len(fits) != len(sizes) and not skip_too_big:
        raise ValueError("a size is zero or exceeds the capacity")
    return fits


def best_fit_decreasing(sizes, capacity, skip_too_big=False) -> list[list[int]]:
    """Largest first, each into the fullest bin that still takes it."""
    todo = sorted(_accepted(sizes, capacity, skip_too_big), key=lambda p: -p[0])
    bins: list[list[int]] = []
    free: list[tuple[float, int]] = []  # (room left, bin), ordered
    for size, item in todo:
        at = bisect_left(free, (size, -1))
        if at == len(free):
            bins.append([item])
            insort(free, (capacity - size, len(bins) - 1))
        else:
            room, b = free.pop(at)
            bins[b].append(item)
            insort(free, (room - size, b))
    return bins


def harmonic_k(sizes, capacity, k=6, skip_too_big=False) -> list[list[int]]:
    """Online: class j holds sizes in (1/(j+1), 1/j] and closes a bin at j items; small ones first-fit."""
    if k < 2:
        raise ValueError(f"k must be at least 2, not {k}")
    bins: list[list[int]] = []
    open_bin: dict[int, list[int]] = {}
    small: list[list] = []  # [room left, bin]
    for size, item in _accepted(sizes, capacity, skip_too_big):
        share = size / capacity
        j = int(1.0 // share)
        if share <= 1.0 / k:
            slot = next((s for s in small if s[0] >= size), None)
            if slot is None:
                bins.append([])
                slot = [float(capacity), len(bins) - 1]
                small.append(slot)
            bins[slot[1]].append(item)
            slot[0] -= size
            continue
        if j not in open_bin:
            bins.append([])
            open_bin[j] = bins[-1]
        open_bin[j].append(item)
        if len(open_bin[j]) == j:
            del open_bin[j]
    return bins


def first_fit(sizes, capacity, skip_too_big=False, n_buckets=1, seed=None) -> list[list[int]]:
    """First-fit after a descending sort (``n_buckets`` None or >= 2) or a full shuffle (1).

    Two or more buckets leave the descending order as it is.
    """
    todo = sorted(_accepted(sizes, capacity, skip_too_big), key=lambda p: -p[0])
    if n_buckets == 1 and len(todo) > 1:
        random.Random(seed).shuffle(todo)
    # Tree of maxima over the bins' free room: finds the first bin that fits in log time.
    width = 1
    while width < max(len(todo), 1):
        width *= 2
    tree = [0.0] * (2 * width)
    bins: list[list[int]] = []

    def put(b: int, room: float) -> None:
        node = width + b
        tree[node] = room
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])

    for size, item in todo:
        if tree[1] >= size:
            node = 1
            while node < width:
                node = 2 * node if tree[2 * node] >= size else 2 * node + 1
            b = node - width
            bins[b].append(item)
            put(b, tree[node] - size)
        else:
            bins.append([item])
            put(len(bins) - 1, float(capacity) - size)
    return bins


def tile_weights(*stores: DataFrame, tile: str = "tile_id") -> DataFrame:
    """Weight of a tile: its rows over all given node or edge tables."""
    counts = [s.groupBy(tile).agg(F.count(F.lit(1)).alias("weight")) for s in stores]
    merged = counts[0]
    for more in counts[1:]:
        merged = merged.unionByName(more)
    return merged.groupBy(tile).agg(F.sum("weight").alias("weight"))


def pack_tiles(
    weights: DataFrame,
    capacity: float,
    algorithm: str = "best_fit",
    *,
    skip_too_big: bool = False,
    seed: int = 0,
    epoch: int = 0,
    group_size: int = 100_000,
) -> DataFrame:
    """``(tile_id, weight, batch_id)``; ``batch_id`` is ``"<group>-<bin>"``.

    A tile of weight 0 or above the capacity fails the job unless ``skip_too_big``.
    ``first_fit`` re-shuffles with ``seed`` and ``epoch``.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"algorithm must be one of {', '.join(ALGORITHMS)}")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tile_id").reset_index(drop=True)
        sizes, group = pdf["weight"].tolist(), int(pdf["group"].iloc[0])
        if algorithm == "best_fit":
            bins = best_fit_decreasing(sizes, capacity, skip_too_big)
        elif algorithm == "harmonic":
            bins = harmonic_k(sizes, capacity, skip_too_big=skip_too_big)
        else:
            bins = first_fit(sizes, capacity, skip_too_big, seed=hash((seed, epoch, group)))
        batch = {i: f"{group}-{b}" for b, items in enumerate(bins) for i in items}
        pdf["batch_id"] = pdf.index.map(batch)
        return pdf.loc[pdf["batch_id"].notna(), ["tile_id", "weight", "batch_id"]]

    ranked = prefix_offsets(weights.withColumn("_one", F.lit(1)), "tile_id", "_one", "_rank")
    grouped = ranked.withColumn("group", F.floor(F.col("_rank") / F.lit(group_size)).cast("long"))
    return (
        grouped.select("tile_id", F.col("weight").cast("double"), "group")
        .groupBy("group")
        .applyInPandas(pack, "tile_id long, weight double, batch_id string")
    )
