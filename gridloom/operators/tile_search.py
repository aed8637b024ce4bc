"""Nearest neighbours tile by tile, with a certificate for each query.

Tiles are quadtree leaves over candidates and query places together, so none is crowded.  A tile gets its own
candidates, and those within a quarter of its side around it (the halo), but only from leaves that are not
much smaller than itself.  So a candidate is copied a few times at most, and a tile's search stays small.  A
query is certain if its ``k``-th distance does not pass what its tile is known to hold completely; the
others, near a border with much finer leaves or in empty country, are left to a second search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.skew import keyed_join
from gridloom.operators.tiling import QuadtreeShape, quadtree_leaves, quadtree_shape
from gridloom.session import cut_lineage

#: Candidates and query places of a tile, levels of the tree (a tile at the last one may hold more, and is left
#: to the second search beyond ``CROWDED``), and levels that a halo's leaf may be finer than its tile.
TILE, DEPTH, CROWDED, FINER = 512, 20, 8192, 2
#: Halo in sides of the tile, and queries that are compared in one go.
HALO, BLOCK = 0.25, 256


def _key(level: np.ndarray | int, kx: np.ndarray, ky: np.ndarray) -> np.ndarray:
    return level * (1 << 40) + kx * (1 << 20) + ky


def _around(shape: QuadtreeShape, at: int, low_x, low_y, high_x, high_y) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, kx, ky) of the cells of one level within the halo of boxes; a box spans two cells a side at most."""
    side_x, side_y = shape.cell_x / 2.0 ** (at + 1), shape.cell_y / 2.0 ** (at + 1)
    # A hair more than the halo, so that rounding loses no candidate.
    wx, wy = HALO * side_x * (1 + 1e-9), HALO * side_y * (1 + 1e-9)
    ends = [
        np.clip(np.floor((v - o) / s).astype(np.int64), 0, (1 << (at + 1)) - 1)
        for v, o, s in ((low_x - wx, shape.x_min, side_x), (high_x + wx, shape.x_min, side_x), (low_y - wy, shape.y_min, side_y), (high_y + wy, shape.y_min, side_y))
    ]
    rows, xs, ys = [], [], []
    everyone = np.arange(len(low_x))
    for i, j in ((0, 2), (0, 3), (1, 2), (1, 3)):
        fresh = np.ones(len(low_x), bool)
        if i == 1:
            fresh &= ends[1] != ends[0]
        if j == 3:
            fresh &= ends[3] != ends[2]
        rows.append(everyone[fresh])
        xs.append(ends[i][fresh])
        ys.append(ends[j][fresh])
    return np.concatenate(rows), np.concatenate(xs), np.concatenate(ys)


def _elsewhere(level: np.ndarray, kx: np.ndarray, ky: np.ndarray, at: int, row: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
    """Cells that are not the row's own leaf, nor inside it, nor around it."""
    up, down = np.maximum(at - level[row], 0), np.maximum(level[row] - at, 0)
    return (cx >> up != kx[row] >> down) | (cy >> up != ky[row] >> down)


class TileIndex:
    """Leaves over all points of a search, with the halo width of each; sent to the tasks by level."""

    def __init__(self, points: DataFrame, tile: int):
        self.shape = quadtree_shape(points, depth_cap=DEPTH)
        leaves = cut_lineage(quadtree_leaves(points, tile, self.shape).select("tile_id", "level", "kx", "ky", "n"))
        self.leaves = cut_lineage(self._with_halo(leaves))

    def _with_halo(self, leaves: DataFrame) -> DataFrame:
        """Add ``fine``: leaves too small to give candidates lie in the halo, so there is none."""
        shape = self.shape
        levels = sorted(r[0] for r in leaves.select("level").distinct().collect())  # DEPTH at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                level, kx, ky = (np.asarray(batch.column(i), np.int64) for i in range(3))
                side_x, side_y = shape.cell_x / 2.0 ** (level + 1), shape.cell_y / 2.0 ** (level + 1)
                x, y = shape.x_min + kx * side_x, shape.y_min + ky * side_y
                for at in levels:
                    small = np.flatnonzero(level > at + FINER)
                    if len(small):
                        row, cx, cy = _around(shape, at, x[small], y[small], (x + side_x)[small], (y + side_y)[small])
                        ok = _elsewhere(level[small], kx[small], ky[small], at, row, cx, cy)
                        yield pa.RecordBatch.from_arrays([pa.array(np.unique(_key(at, cx[ok], cy[ok])))], ["tile_id"])

        near = leaves.select("level", "kx", "ky").mapInArrow(run, "tile_id long").distinct().withColumn("fine", F.lit(True))
        return leaves.join(near, "tile_id", "left").withColumn("fine", F.coalesce("fine", F.lit(False)))

    def labelled(self, points: DataFrame, x: str, y: str) -> DataFrame:
        """Add ``level, kx, ky`` of each point's leaf, by an equi-join on the leaf's key."""
        shape = self.shape
        levels = self.leaves.select(F.collect_set("level")).scalar()
        last = shape.last_level
        top = (1 << (last + 1)) - 1

        def place(v: str, origin: float, side: float):
            raw = F.floor((F.col(v) - F.lit(origin)) / F.lit(side / 2.0 ** (last + 1))).cast("long")
            return F.least(F.greatest(raw, F.lit(0).cast("long")), F.lit(top).cast("long"))

        keyed = points.withColumn("level", F.explode(levels))
        shift = F.lit(last) - F.col("level")
        keyed = keyed.withColumn("kx", F.call_function("shiftright", place(x, shape.x_min, shape.cell_x), shift)).withColumn(
            "ky", F.call_function("shiftright", place(y, shape.y_min, shape.cell_y), shift)
        )
        return keyed_join(keyed, self.leaves, ["level", "kx", "ky"])

    def copies(self, labelled: DataFrame) -> DataFrame:
        """``(tile_id, dst, cx, cy)``: each candidate in its own leaf, and in the halos that it lies in."""
        shape = self.shape
        levels = sorted(r[0] for r in self.leaves.select("level").distinct().collect())
        kind = labelled.schema["dst"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = (np.asarray(batch.column(i), float) for i in (1, 2))
                level, kx, ky = (np.asarray(batch.column(i), np.int64) for i in (3, 4, 5))
                rows, tiles = [np.arange(len(x))], [_key(level, kx, ky)]
                for at in levels:
                    near = np.flatnonzero(level <= at + FINER)
                    row, cx, cy = _around(shape, at, x[near], y[near], x[near], y[near])
                    ok = _elsewhere(level[near], kx[near], ky[near], at, row, cx, cy)
                    rows.append(near[row[ok]])
                    tiles.append(_key(at, cx[ok], cy[ok]))
                row = np.concatenate(rows)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tiles)), batch.column(0).take(take), pa.array(x[row]), pa.array(y[row])], ["tile_id", "dst", "cx", "cy"]
                )

        return labelled.select("dst", "cx", "cy", "level", "kx", "ky").mapInArrow(run, f"tile_id long, dst {kind}, cx double, cy double")


def tile_search(candidates: DataFrame, places: DataFrame, k: int, radius: float | None = None, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Neighbours ``(qx, qy, dst, cx, cy)`` of the certain places, ``k`` or all there are within ``radius``, and the other places.

    ``candidates`` is ``(dst, cx, cy)``, ``places`` distinct ``(qx, qy)``.
    """
    every = candidates.select(F.col("cx").alias("x"), F.col("cy").alias("y")).unionByName(places.select(F.col("qx").alias("x"), F.col("qy").alias("y")))
    index = TileIndex(every, tile)
    shape = index.shape
    kind = candidates.schema["dst"].dataType.simpleString()
    asked = index.labelled(places, "qx", "qy").select("tile_id", "qx", "qy", "level", "kx", "ky", "fine", "n")
    calm, crowded = asked.where(F.col("n") <= CROWDED), asked.where(F.col("n") > CROWDED)
    held = keyed_join(index.copies(index.labelled(candidates, "cx", "cy")), index.leaves.where(F.col("n") <= CROWDED).select("tile_id"), ["tile_id"])

    def search(queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        columns = {"qx": [], "qy": [], "dst": [], "cx": [], "cy": []}
        if not len(queries):
            return pd.DataFrame(columns)
        qx, qy = queries["qx"].to_numpy(), queries["qy"].to_numpy()
        level, kx, ky = (int(queries[c].iloc[0]) for c in ("level", "kx", "ky"))
        side_x, side_y = shape.cell_x / 2.0 ** (level + 1), shape.cell_y / 2.0 ** (level + 1)
        left, low = shape.x_min + kx * side_x, shape.y_min + ky * side_y
        edge = np.minimum(np.minimum(qx - left, left + side_x - qx), np.minimum(qy - low, low + side_y - qy))
        cover = np.maximum(edge, 0.0) + (0.0 if queries["fine"].iloc[0] else HALO * min(side_x, side_y))
        # Rounding of tile borders.
        cover *= 1 - 1e-9
        cx, cy, dst = found["cx"].to_numpy(), found["cy"].to_numpy(), found["dst"].to_numpy()
        rank = np.argsort(np.argsort(dst, kind="stable"), kind="stable")
        out = []
        for a in range(0, len(qx), BLOCK):
            b = min(a + BLOCK, len(qx))
            dx, dy = qx[a:b, None] - cx, qy[a:b, None] - cy
            d2 = dx * dx + dy * dy
            n = d2.shape[1]
            kth = np.partition(d2, k - 1, axis=1)[:, k - 1] if n >= k else np.full(b - a, np.inf)
            reach = np.minimum(kth, radius * radius) if radius is not None else kth
            sure = np.sqrt(reach) <= cover[a:b]
            row, col = np.nonzero((d2 <= kth[:, None]) & sure[:, None])
            if radius is not None:
                inside = d2[row, col] <= radius * radius
                row, col = row[inside], col[inside]
            order = np.lexsort((rank[col], d2[row, col], row))
            row, col = row[order], col[order]
            first = np.searchsorted(row, np.arange(b - a))
            keep = np.arange(len(row)) - first[row] < k
            row, col = row[keep], col[keep]
            out.append(pd.DataFrame({"qx": qx[a:b][row], "qy": qy[a:b][row], "dst": dst[col], "cx": cx[col], "cy": cy[col]}))
            lost = np.flatnonzero(~sure)
            if len(lost):
                none = np.full(len(lost), np.nan)
                out.append(pd.DataFrame({"qx": qx[a:b][lost], "qy": qy[a:b][lost], "dst": [None] * len(lost), "cx": none, "cy": none}))
        return pd.concat(out, ignore_index=True)

    result = calm.groupBy("tile_id").cogroup(held.groupBy("tile_id")).applyInPandas(search, f"qx double, qy double, dst {kind}, cx double, cy double")
    result = cut_lineage(result)
    rest = result.where("dst IS NULL").select("qx", "qy").unionByName(crowded.select("qx", "qy"))
    return result.where("dst IS NOT NULL"), rest
