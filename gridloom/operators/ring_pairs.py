"""Pairs of rings tested as flat arrays: blocks of one side against blocks of the other.

The formulas are those of ``functions.geometry``, operation by operation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from gridloom.operators.blocks import PAIRS_AT_ONCE, listed, lists, ragged, slices

#: A place this near to a ring is on it.
NEAR = 1e-9


class Rings:
    """Rings of a column pair of lists (x and y), flattened."""

    def __init__(self, xs: pa.Array, ys: pa.Array):
        offs, x = lists(xs)
        self.start, self.size = offs[:-1], np.diff(offs)
        self.x, self.y = np.asarray(x, float), np.asarray(lists(ys)[1], float)
        ahead = np.arange(1, len(self.x) + 1)
        full = self.size > 0
        ahead[(self.start + self.size)[full] - 1] = self.start[full]
        self.x2, self.y2 = self.x[ahead], self.y[ahead]

    def edges(self, at: np.ndarray):
        return self.x[at], self.y[at], self.x2[at], self.y2[at]


def _against(rings: Rings, ring: np.ndarray, x: np.ndarray, y: np.ndarray):
    """Of places and a ring each: (parity, places and edges as flat arrays, first edge of a place)."""
    size = rings.size[ring]
    ends = np.cumsum(size)
    first = ends - size
    x1, y1, x2, y2 = rings.edges(np.repeat(rings.start[ring] - first, size) + np.arange(ends[-1]))
    px, py = np.repeat(x, size), np.repeat(y, size)
    dy = y2 - y1
    with np.errstate(divide="ignore", invalid="ignore"):
        crosses = ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / dy + x1)
    odd = np.add.reduceat(crosses, first, dtype=np.int64) % 2 == 1
    return odd, (px, py, x1, y1, x2, y2), first


def _inside(rings: Rings, ring: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _against(rings, ring, x, y)[0] if len(ring) else np.zeros(0, bool)


def _covered(rings: Rings, ring: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inside a ring, on it, or within rounding of it."""
    if len(ring) == 0:
        return np.zeros(0, bool)
    ok = _inside(rings, ring, x, y)
    rest = np.flatnonzero(~ok)
    if len(rest):
        _, (px, py, x1, y1, x2, y2), first = _against(rings, ring[rest], x[rest], y[rest])
        dx, dy = x2 - x1, y2 - y1
        rim = (
            (dx * (py - y1) - dy * (px - x1) == 0)
            & (px >= np.minimum(x1, x2)) & (px <= np.maximum(x1, x2)) & (py >= np.minimum(y1, y2)) & (py <= np.maximum(y1, y2))
        )
        length2 = dx * dx + dy * dy
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.clip(np.where(length2 > 0, ((px - x1) * dx + (py - y1) * dy) / length2, 0.0), 0.0, 1.0)
        ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
        gap = np.sqrt(np.minimum.reduceat(ex * ex + ey * ey, first))
        ok[rest] = np.logical_or.reduceat(rim, first) | (gap < NEAR)
    return ok


def covers(outer: Rings, o: np.ndarray, inner: Rings, i: np.ndarray) -> np.ndarray:
    """No point of ring ``i`` lies outside ring ``o``, pair by pair.

    Each inner edge is cut where it meets the outer ring; between two neighbouring cuts an edge cannot change
    sides, so testing the piece midpoints, after the vertices, is exact up to rounding.
    """
    hit = np.zeros(len(o), bool)
    for a, b in slices(inner.size[i] * outer.size[o], PAIRS_AT_ONCE):
        hit[a:b] = _covers(outer, o[a:b], inner, i[a:b])
    return hit


def _covers(outer: Rings, o: np.ndarray, inner: Rings, i: np.ndarray) -> np.ndarray:
    hit = np.zeros(len(o), bool)
    # The first vertices part most pairs.
    left = np.flatnonzero(_covered(outer, o, inner.x[inner.start[i]], inner.y[inner.start[i]]))
    if len(left) == 0:
        return hit
    pair, within = ragged(inner.size[i[left]])
    pair = left[pair]
    edge = inner.start[i[pair]] + within
    fine = np.ones(len(o), bool)
    np.logical_and.at(fine, pair, _covered(outer, o[pair], inner.x[edge], inner.y[edge]))
    keep = fine[pair]
    pair, edge = pair[keep], edge[keep]
    if len(pair) == 0:
        return hit
    at, k = ragged(outer.size[o[pair]])
    fx1, fy1, fx2, fy2 = outer.edges(outer.start[o[pair]][at] + k)
    ex1, ey1, ex2, ey2 = (v[at] for v in inner.edges(edge))
    dx, dy, fx, fy = ex2 - ex1, ey2 - ey1, fx2 - fx1, fy2 - fy1
    den, length2 = dx * fy - dy * fx, dx * dx + dy * dy
    with np.errstate(divide="ignore", invalid="ignore"):
        t = ((fx1 - ex1) * fy - (fy1 - ey1) * fx) / den
        along = np.flatnonzero((den == 0.0) & (length2 > 0))
        along1 = ((fx1 - ex1) * dx + (fy1 - ey1) * dy)[along] / length2[along]
        along2 = ((fx2 - ex1) * dx + (fy2 - ey1) * dy)[along] / length2[along]
        t = np.concatenate([np.where(den == 0.0, np.nan, t), along1, along2])
        owner = np.concatenate([at, at[along], at[along]])
        cut = np.flatnonzero((t > 0.0) & (t < 1.0))
    n = len(pair)
    stop = np.concatenate([np.zeros(n), np.ones(n), t[cut]])
    owner = np.concatenate([np.arange(n), np.arange(n), owner[cut]])
    order = np.lexsort((stop, owner))
    stop, owner = stop[order], owner[order]
    piece = np.flatnonzero((owner[1:] == owner[:-1]) & (stop[1:] > stop[:-1]))
    s, owner = (stop[piece] + stop[piece + 1]) / 2.0, owner[piece]
    ex1, ey1, ex2, ey2 = (v[owner] for v in inner.edges(edge))
    whole = _covered(outer, o[pair[owner]], ex1 + s * (ex2 - ex1), ey1 + s * (ey2 - ey1))
    np.logical_and.at(fine, pair[owner], whole)
    hit[pair] = fine[pair]
    return hit


def meet(a: Rings, i: np.ndarray, b: Rings, j: np.ndarray) -> np.ndarray:
    """Edges cross or touch, or one ring lies inside the other, pair by pair."""
    hit = np.zeros(len(i), bool)
    for p, q in slices(a.size[i] * b.size[j], PAIRS_AT_ONCE):
        hit[p:q] = _meet(a, i[p:q], b, j[p:q])
    return hit


def _meet(a: Rings, i: np.ndarray, b: Rings, j: np.ndarray) -> np.ndarray:
    hit = _inside(b, j, a.x[a.start[i]], a.y[a.start[i]])
    rest = np.flatnonzero(~hit)
    hit[rest] = _inside(a, i[rest], b.x[b.start[j[rest]]], b.y[b.start[j[rest]]])
    rest = rest[~hit[rest]]
    if len(rest) == 0:
        return hit
    size = b.size[j[rest]]
    pair, within = ragged(a.size[i[rest]] * size)
    first = np.flatnonzero(within == 0)
    ax1, ay1, ax2, ay2 = a.edges(a.start[i[rest]][pair] + within // size[pair])
    bx1, by1, bx2, by2 = b.edges(b.start[j[rest]][pair] + within % size[pair])

    def turn(x1, y1, x2, y2, x, y):
        return np.sign((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1))

    cross = (np.maximum(ax1, ax2) >= np.minimum(bx1, bx2)) & (np.maximum(bx1, bx2) >= np.minimum(ax1, ax2))
    cross &= (np.maximum(ay1, ay2) >= np.minimum(by1, by2)) & (np.maximum(by1, by2) >= np.minimum(ay1, ay2))
    cross &= turn(ax1, ay1, ax2, ay2, bx1, by1) * turn(ax1, ay1, ax2, ay2, bx2, by2) <= 0
    cross &= turn(bx1, by1, bx2, by2, ax1, ay1) * turn(bx1, by1, bx2, by2, ax2, ay2) <= 0
    hit[rest] = np.logical_or.reduceat(cross, first)
    return hit


def ring_pairs(predicate: str, q_box: tuple[str, ...], i_box: tuple[str, ...]):
    """Arrow function over pairs of blocks: each query id with the list of its matches in the block.

    A pair of boxes is tested in one cell only, the one that holds the lower-left corner of their overlap.
    """
    slack = 2 * NEAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            q_offs, q_ids = lists(batch.column("_q_ids"))
            i_offs, i_ids = lists(batch.column("_i_ids"))
            q_rings, i_rings = (Rings(lists(batch.column(f"_{s}_xs"))[1], lists(batch.column(f"_{s}_ys"))[1]) for s in "qi")
            qx0, qy0, qx1, qy1 = (np.asarray(lists(batch.column(c))[1], float) for c in q_box)
            ix0, iy0, ix1, iy1 = (np.asarray(lists(batch.column(c))[1], float) for c in i_box)
            side = 2.0 ** np.asarray(batch.column("_level"), float)
            gx, gy = np.asarray(batch.column("_gx")), np.asarray(batch.column("_gy"))
            # One query of a row against the row's whole other block is the unit of work.
            row = np.repeat(np.arange(batch.num_rows), np.diff(q_offs))
            count = np.diff(i_offs)[row]
            for a, b in slices(count, PAIRS_AT_ONCE):
                owner, within = ragged(count[a:b])
                q = owner + a
                i = i_offs[row[q]] + within
                ax0, ay0, ax1, ay1 = (np.repeat(v[a:b], count[a:b]) for v in (qx0, qy0, qx1, qy1))
                bx0, by0, bx1, by1 = ix0[i], iy0[i], ix1[i], iy1[i]
                keep = (ax0 <= bx1) & (bx0 <= ax1) & (ay0 <= by1) & (by0 <= ay1)
                if predicate == "contains":
                    keep &= (ax0 >= bx0 - slack) & (ax1 <= bx1 + slack) & (ay0 >= by0 - slack) & (ay1 <= by1 + slack)
                keep = np.flatnonzero(keep)
                q, i = q[keep], i[keep]
                at = row[q]
                own = (np.floor(np.maximum(qx0[q], ix0[i]) / side[at]) == gx[at]) & (np.floor(np.maximum(qy0[q], iy0[i]) / side[at]) == gy[at])
                q, i = q[own], i[own]
                if len(q) == 0:
                    continue
                hit = covers(i_rings, i, q_rings, q) if predicate == "contains" else meet(q_rings, q, i_rings, i)
                q, i = q[hit], i[hit]
                if len(q):
                    yield listed([q_ids], q, i_ids, i)

    return run
