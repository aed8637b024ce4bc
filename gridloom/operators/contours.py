"""Contours of many labels and simplified rings, as flat arrays.

The same results as ``planar.label_contour`` and ``planar.simplify`` give for one label and one ring; here a
batch of them goes on one step at a time, so a step costs one array operation and not one for each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from gridloom.functions.planar import STEPS
from gridloom.operators.blocks import ragged, slices

#: Cells of the boxes of the labels, and vertices of the rings, that are taken in one go.
CELLS_AT_ONCE, VERTICES_AT_ONCE = 1 << 21, 1 << 17


def _turns() -> np.ndarray:
    """Next step by the neighbours that are set (bits) and the step back to where one came from; 8 for none."""
    table = np.full((256, 8), 8, np.int64)
    for set_, came in np.ndindex(256, 8):
        table[set_, came] = next((d for d in ((came + k) % 8 for k in range(1, 9)) if set_ >> d & 1), 8)
    return table


_TURN = _turns()
_DR, _DC = (np.array(v, np.int64) for v in zip(*STEPS))


def rim_pixels(owner: np.ndarray, rows: np.ndarray, words: np.ndarray, bits: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, row and column of the pixels with a missing 4-neighbour, which are all that a border needs.

    ``bits`` has the pixels of 64 columns of a row, ``words`` their number; in order of owner, row, word.
    """
    bits = bits.view(np.uint64)
    count = np.bincount(owner, minlength=n)
    begin = np.cumsum(count) - count
    low_r, high_r = np.minimum.reduceat(rows, begin), np.maximum.reduceat(rows, begin)
    low_w, high_w = np.minimum.reduceat(words, begin), np.maximum.reduceat(words, begin)
    width = high_w - low_w + 3
    cells = width * (high_r - low_r + 3)
    wide = width[owner]
    key = (np.cumsum(cells) - cells)[owner] + (rows - low_r[owner] + 1) * wide + words - low_w[owner] + 1

    def at(wanted: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        return np.where(key[place] == wanted, bits[place], np.uint64(0))

    one, last = np.uint64(1), np.uint64(63)
    inner = (bits << one | at(key - 1) >> last) & (bits >> one | at(key + 1) << last) & at(key - wide) & at(key + wide)
    rim = bits & ~inner
    some = np.flatnonzero(rim)
    set_ = np.unpackbits(rim[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, bit = np.nonzero(set_)
    word = some[word]
    return owner[word], rows[word], words[word] * 64 + bit


def label_contours(owner: np.ndarray, rows: np.ndarray, cols: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pixels of labels ``0..n-1``: the label of each contour vertex, and the vertices' ``x`` and ``y``.

    Pixels are distinct and in order of owner, row, column.  A label's contour is the border with most turning
    points, the first of them in pixel order; labels with none of three points have no vertices.
    """
    count = np.bincount(owner, minlength=n)
    begin = np.cumsum(count) - count
    low_r, high_r = np.minimum.reduceat(rows, begin), np.maximum.reduceat(rows, begin)
    low_c, high_c = np.minimum.reduceat(cols, begin), np.maximum.reduceat(cols, begin)
    width = high_c - low_c + 3
    cells = width * (high_r - low_r + 3)
    out = []
    for a, b in slices(cells, CELLS_AT_ONCE):
        part = slice(begin[a], begin[b] if b < n else len(owner))
        own = owner[part]
        base = np.cumsum(cells[a:b]) - cells[a:b]
        key = base[own - a] + (rows[part] - low_r[own] + 1) * width[own] + cols[part] - low_c[own] + 1
        label, at = _borders(own, key, width, int(cells[a:b].sum()))
        r, c = np.divmod(at - base[label - a], width[label])
        out.append((label, c - 1 + low_c[label], r - 1 + low_r[label]))
    return tuple(np.concatenate(v) for v in zip(*out))


def _borders(own: np.ndarray, key: np.ndarray, width: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Label and cell of the vertices; ``key`` is each pixel's cell in boxes with an empty rim, laid end to end."""
    grid = np.zeros(cells, np.uint8)
    grid[key] = 1
    wide = width[own]
    around = np.zeros(len(key), np.int64)
    for d in range(8):
        around |= grid[key + _DR[d] * wide + _DC[d]].astype(np.int64) << d
    first = _first_pixels(key, wide)
    neighbours = np.zeros(cells, np.uint8)
    neighbours[key] = around
    # Every component is walked round from its first pixel in row order; nothing lies above or left of it.
    start, label = key[first], own[first]
    leave = _TURN[around[first], 4]
    walker = np.flatnonzero(leave < 8)
    at, step = start[walker], leave[walker]
    walkers, spots = [walker], [at]
    while len(walker):
        at = at + _DR[step] * width[label[walker]] + _DC[step]
        ahead = _TURN[neighbours[at], (step + 4) % 8]
        on = (at != start[walker]) | (ahead != leave[walker])
        walker, at, step, ahead = walker[on], at[on], step[on], ahead[on]
        turned = ahead != step
        walkers.append(walker[turned])
        spots.append(at[turned])
        step = ahead
    walkers, spots = np.concatenate(walkers), np.concatenate(spots)
    order = np.argsort(walkers, kind="stable")
    walkers, spots = walkers[order], spots[order]
    size = np.bincount(walkers, minlength=len(start))
    best = np.lexsort((np.arange(len(start)), -size, label))
    best = best[np.diff(label[best], prepend=-1) != 0]
    chosen = np.zeros(len(start), bool)
    chosen[best[size[best] >= 3]] = True
    keep = chosen[walkers]
    return label[walkers[keep]], spots[keep]


def _first_pixels(key: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Positions of the first pixel of each 8-connected component: runs in a row, joined to those of the next row."""
    new = np.diff(key, prepend=-2) != 1
    begin = np.flatnonzero(new)
    low, high, step = key[begin], key[np.append(begin[1:], len(key)) - 1], wide[begin]
    since, until = np.searchsorted(high, low + step - 1), np.searchsorted(low, high + step + 1, side="right")
    upper, nth = ragged(until - since)
    lower = since[upper] + nth
    root = np.arange(len(begin))
    while True:
        a, b = root[upper], root[lower]
        apart = a != b
        if not apart.any():
            return begin[root == np.arange(len(begin))]
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root = root[root]


def simplify_rings(counts: np.ndarray, x: np.ndarray, y: np.ndarray, tolerance: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Vertex counts and vertices of the rings simplified after Douglas & Peucker, in pieces of whole rings."""
    begin = np.cumsum(counts) - counts
    for a, b in slices(counts, VERTICES_AT_ONCE):
        part = slice(begin[a], begin[b] if b < len(counts) else len(x))
        px, py = x[part], y[part]
        keep = _kept(counts[a:b], px, py, tolerance[a:b])
        yield np.add.reduceat(keep.astype(np.int64), begin[a:b] - begin[a]), px[keep], py[keep]


def _kept(counts: np.ndarray, x: np.ndarray, y: np.ndarray, tolerance: np.ndarray) -> np.ndarray:
    """Which vertices stay; rings of less than four, or with less than three left, stay whole but for a closing vertex."""
    ends = np.cumsum(counts)
    begin = ends - counts
    closed = (counts > 1) & (x[begin] == x[ends - 1]) & (y[begin] == y[ends - 1])
    whole = np.ones(len(x), bool)
    whole[ends[closed] - 1] = False
    keep = np.zeros(len(x), bool)
    keep[begin] = True
    # A segment runs from one vertex to another of the same ring; the last one ends at the first vertex.
    ring = np.flatnonzero((counts - closed >= 4) & (tolerance > 0))
    start, size = begin[ring], (counts - closed)[ring]
    since, stop = np.zeros_like(start), size
    while len(ring):
        ax, ay = x[start + since], y[start + since]
        last = start + np.where(stop == size, 0, stop)
        dx, dy = x[last] - ax, y[last] - ay
        seg, nth = ragged(stop - since - 1)
        at = start[seg] + since[seg] + 1 + nth
        l2 = dx * dx + dy * dy
        along = (x[at] - ax[seg]) * dx[seg] + (y[at] - ay[seg]) * dy[seg]
        t = np.clip(np.divide(along, l2[seg], out=np.zeros(len(at)), where=l2[seg] > 0), 0, 1)
        ex, ey = x[at] - (ax[seg] + t * dx[seg]), y[at] - (ay[seg] + t * dy[seg])
        gap = np.sqrt(ex * ex + ey * ey)
        inner = stop - since - 1
        farthest = np.maximum.reduceat(gap, np.cumsum(inner) - inner)
        hit = np.flatnonzero(gap == farthest[seg])
        hit = hit[np.diff(seg[hit], prepend=-1) != 0]
        cut = farthest > tolerance[ring]
        keep[at[hit[cut]]] = True
        mid = (at[hit] - start)[cut]
        ring, start, size = (np.concatenate([v[cut], v[cut]]) for v in (ring, start, size))
        since, stop = np.concatenate([since[cut], mid]), np.concatenate([mid, stop[cut]])
        more = stop - since >= 2
        ring, start, size, since, stop = (v[more] for v in (ring, start, size, since, stop))
    short = np.add.reduceat(keep.astype(np.int64), begin) < 3
    few = np.repeat(short | (counts - closed < 4) | ~(tolerance > 0), counts)
    return np.where(few, whole, keep)
