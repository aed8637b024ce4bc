"""Reverse-mode gradients of the encoder and its losses for one tile.

A tape records, for each result, how to send its gradient back; ``Tape.back`` runs it in
reverse.  Only what the encoder needs is here: dense layers, gathers, GELU and SiLU, graph
attention as one step, unit length, and the three losses.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from gridloom.operators.encoder import LEAKY_SLOPE, EncoderWeights

TINY = 1e-12


class Tape:
    """Values are indices into ``values``; ``grads`` has their gradients after ``back``."""

    def __init__(self) -> None:
        self.values: list[np.ndarray] = []
        self.grads: list[np.ndarray | None] = []
        self.steps: list[tuple[int, Callable[[np.ndarray], None]]] = []

    def leaf(self, value: np.ndarray) -> int:
        self.values.append(np.asarray(value, dtype=float))
        self.grads.append(None)
        return len(self.values) - 1

    def result(self, value: np.ndarray, send: Callable[[np.ndarray], None]) -> int:
        at = self.leaf(value)
        self.steps.append((at, send))
        return at

    def give(self, at: int, gradient: np.ndarray) -> None:
        self.grads[at] = gradient if self.grads[at] is None else self.grads[at] + gradient

    def back(self, start: dict[int, np.ndarray]) -> None:
        for at, gradient in start.items():
            self.give(at, gradient)
        for at, send in reversed(self.steps):
            if self.grads[at] is not None:
                send(self.grads[at])

    # --- dense ------------------------------------------------------------------

    def dense(self, x: int, w: int, b: int) -> int:
        X, W = self.values[x], self.values[w]

        def send(g):
            self.give(x, g @ W.T)
            self.give(w, X.T @ g)
            self.give(b, g.sum(0))

        return self.result(X @ W + self.values[b], send)

    def rows(self, x: int, index: np.ndarray) -> int:
        X = self.values[x]

        def send(g):
            self.give(x, scatter(g, index, len(X)))

        return self.result(X[index], send)

    def beside(self, *parts: int) -> int:
        edges = np.cumsum([self.values[p].shape[1] for p in parts])

        def send(g):
            for p, piece in zip(parts, np.split(g, edges[:-1], axis=1)):
                self.give(p, piece)

        return self.result(np.concatenate([self.values[p] for p in parts], axis=1), send)

    def gelu(self, x: int) -> int:
        X = self.values[x]
        phi = 0.5 * (1.0 + erf(X / math.sqrt(2.0)))
        slope = phi + X * np.exp(-0.5 * X * X) / math.sqrt(2.0 * math.pi)
        return self.result(X * phi, lambda g: self.give(x, g * slope))

    def silu(self, x: int) -> int:
        X = self.values[x]
        s = 1.0 / (1.0 + np.exp(-np.clip(X, -500, 500)))
        return self.result(X * s, lambda g: self.give(x, g * (s + X * s * (1.0 - s))))

    def unit(self, x: int) -> int:
        X = self.values[x]
        n = np.maximum(np.sqrt((X * X).sum(1, keepdims=True)), TINY)
        Y = X / n
        return self.result(Y, lambda g: self.give(x, (g - Y * (g * Y).sum(1, keepdims=True)) / n))

    # --- attention --------------------------------------------------------------

    def attention(self, left: int, right: int, att: int, bias: int, src: np.ndarray, dst: np.ndarray, n_heads: int) -> int:
        """Soft-max over the edges of each destination of ``att . leaky(left[src] + right[dst])``; sums of ``left[src]``."""
        L, R, A = self.values[left], self.values[right], self.values[att]
        n, width = len(R), L.shape[1]
        channels = width // n_heads
        mixed = (L[src] + R[dst]).reshape(-1, n_heads, channels)
        slope = np.where(mixed >= 0, 1.0, LEAKY_SLOPE)
        leaky = mixed * slope
        score = (leaky * A).sum(2)
        top = np.full((n, n_heads), -np.inf)
        np.maximum.at(top, dst, score)
        share = np.exp(score - top[dst])
        share /= scatter(share, dst, n)[dst]
        value = L[src].reshape(-1, n_heads, channels)
        out = scatter((share[:, :, None] * value).reshape(-1, width), dst, n) + self.values[bias]

        def send(g):
            to_edge = g[dst].reshape(-1, n_heads, channels)
            d_share = (to_edge * value).sum(2)
            d_score = share * (d_share - scatter(share * d_share, dst, n)[dst])
            d_mixed = (d_score[:, :, None] * A * slope).reshape(-1, width)
            self.give(left, scatter((share[:, :, None] * to_edge).reshape(-1, width) + d_mixed, src, len(L)))
            self.give(right, scatter(d_mixed, dst, n))
            self.give(att, (d_score[:, :, None] * leaky).sum(0))
            self.give(bias, g.sum(0))

        return self.result(out, send)


def scatter(values: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by index."""
    out = np.zeros((n, *values.shape[1:]))
    if len(index):
        order = np.argsort(index, kind="stable")
        at, first = np.unique(index[order], return_index=True)
        out[at] = np.add.reduceat(values[order], first, axis=0)
    return out


def erf(x: np.ndarray) -> np.ndarray:
    """As in ``encoder.gelu``: error at most 1.5e-7."""
    z = np.abs(x)
    t = 1.0 / (1.0 + 0.3275911 * z)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return np.sign(x) * (1.0 - poly * np.exp(-z * z))


# --- weights as one vector ------------------------------------------------------


def named(weights: EncoderWeights) -> dict[str, np.ndarray]:
    """Every trainable array under a name; the arrays themselves, not copies."""
    out = {"gene": weights.gene, "cell.w": weights.cell[0], "cell.b": weights.cell[1]}
    if weights.use_positions:
        for i, (w, b) in enumerate(weights.position):
            out |= {f"position.{i}.w": w, f"position.{i}.b": b}
    for i, layer in enumerate(weights.layers):
        for kind, arrays in layer.items():
            out |= {f"layer.{i}.{kind}.{name}": a for name, a in arrays.items()}
    for kind, (w, b) in weights.last.items():
        out |= {f"last.{kind}.w": w, f"last.{kind}.b": b}
    return out


def codes(xy: np.ndarray, size: int) -> np.ndarray:
    """Sinusoidal codes of both coordinates, min-max scaled over the tile: ``(n, 2, size)``."""
    if not len(xy):
        return np.zeros((0, 2, size))
    low, high = xy.min(0), xy.max(0)
    scaled = (xy - low) / (high - low + 1e-8)
    half = size // 2
    angle = scaled[:, :, None] * np.exp(-math.log(10_000.0) * np.arange(half) / half)
    return np.concatenate([np.cos(angle), np.sin(angle)], axis=2)


def forward(tape: Tape, leaf: dict[str, int], weights: EncoderWeights, tile: dict) -> dict[str, int]:
    """Embeddings of the points (``tx``) and cells (``bd``) of a tile: gene codes or features, coordinates, edges."""
    h = {"tx": tape.rows(leaf["gene"], tile["tx_gene"]), "bd": tape.dense(tape.leaf(tile["bd_features"]), leaf["cell.w"], leaf["cell.b"])}
    if weights.use_positions:
        for kind in h:
            both = codes(tile[f"{kind}_xy"], weights.position[0][0].shape[0])
            axes = []
            for axis in (0, 1):
                x = tape.silu(tape.dense(tape.leaf(both[:, axis]), leaf["position.0.w"], leaf["position.0.b"]))
                axes.append(tape.dense(x, leaf["position.1.w"], leaf["position.1.b"]))
            h[kind] = tape.beside(h[kind], *axes)
    h = {kind: tape.gelu(x) for kind, x in h.items()}
    for i in range(len(weights.layers)):
        fresh = {}
        for name, a, b, edges in (("tx-tx", "tx", "tx", tile["near"]), ("tx-belongs-bd", "tx", "bd", tile["belongs"])):
            p = f"layer.{i}.{name}."
            left = tape.dense(h[a], leaf[p + "left"], leaf[p + "left_bias"])
            right = tape.dense(h[b], leaf[p + "right"], leaf[p + "right_bias"])
            fresh[b] = tape.gelu(tape.attention(left, right, leaf[p + "attention"], leaf[p + "bias"], edges[0], edges[1], weights.n_heads))
        h = fresh
    out = {kind: tape.dense(x, leaf[f"last.{kind}.w"], leaf[f"last.{kind}.b"]) for kind, x in h.items()}
    return {kind: tape.unit(x) for kind, x in out.items()} if weights.normalize else out


# --- losses ---------------------------------------------------------------------


def draw_clusters(label: np.ndarray, similarity: np.ndarray, u: np.ndarray, negative: bool) -> np.ndarray:
    """A cluster for each anchor: weights are the similarities (its own counts 1) or their negatives, floored at 1e-8."""
    present = np.unique(label)
    sim = similarity[np.ix_(present, present)].copy()
    np.fill_diagonal(sim, 1.0)
    weight = np.maximum(-sim if negative else sim, 1e-8)
    upper = np.cumsum(weight, axis=1) / weight.sum(1, keepdims=True)
    upper[:, -1] = 1.0
    row = upper[np.searchsorted(present, label)]
    return present[(row < u[:, None]).sum(1)]


def draw_members(label: np.ndarray, cluster: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A uniform member of the drawn cluster of each anchor."""
    order = np.argsort(label, kind="stable")
    first = np.searchsorted(label[order], cluster, "left")
    size = np.searchsorted(label[order], cluster, "right") - first
    return order[first + np.minimum((u * size).astype(int), size - 1)]


def _distance(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gap = p - q
    d = np.sqrt((gap * gap).sum(1))
    return d, gap / np.maximum(d, TINY)[:, None]


def triplet_terms(a: np.ndarray, p: np.ndarray, n: np.ndarray, margin: float):
    """Sum of ``max(0, |a-p| - |a-n| + margin)`` and its gradients."""
    dp, up = _distance(a, p)
    dn, un = _distance(a, n)
    term = dp - dn + margin
    on = (term > 0)[:, None]
    return np.maximum(term, 0).sum(), on * (up - un), on * -up, on * un


def metric_terms(a: np.ndarray, p: np.ndarray, n: np.ndarray, sp: np.ndarray, sn: np.ndarray):
    """Sum of squared errors of cosines against similarities, and its gradients."""
    total, ga, others = 0.0, np.zeros_like(a), []
    na = np.maximum(np.sqrt((a * a).sum(1)), TINY)[:, None]
    for b, s in ((p, sp), (n, sn)):
        nb = np.maximum(np.sqrt((b * b).sum(1)), TINY)[:, None]
        cos = (a * b).sum(1, keepdims=True) / (na * nb)
        error = cos - s[:, None]
        total += float((error * error).sum())
        ga += 2 * error * (b / (na * nb) - cos * a / (na * na))
        others.append(2 * error * (a / (na * nb) - cos * b / (nb * nb)))
    return total, ga, others[0], others[1]


def bce_terms(a: np.ndarray, p: np.ndarray, n: np.ndarray):
    """Sum over edges of half of both logistic losses on dot products, and its gradients."""
    zp, zn = (a * p).sum(1), (a * n).sum(1)
    total = 0.5 * (np.logaddexp(0, -zp) + np.logaddexp(0, zn)).sum()
    wp, wn = (-0.5 / (1 + np.exp(np.clip(zp, -500, 500))))[:, None], (0.5 / (1 + np.exp(np.clip(-zn, -500, 500))))[:, None]
    return total, wp * p + wn * n, wp * a, wn * a


def tile_losses(weights: EncoderWeights, tile: dict, similarity: dict[str, np.ndarray], shares: np.ndarray, counts: np.ndarray, *, kind: str,
                margins: tuple[float, float], seed: int, gradient: bool = True):
    """Sums of the three losses over a tile's anchors, and the gradient of ``shares . (sums / counts)``.

    ``shares`` weigh point, cell and segmentation loss; ``counts`` are the anchors of the whole batch.
    Anchors are the masked points and cells with a cluster, and the point-cell edges; positives and
    negatives are drawn inside the tile, from ``seed``.
    """
    tape = Tape()
    arrays = named(weights)
    leaf = {name: tape.leaf(a) for name, a in arrays.items()}
    out = forward(tape, leaf, weights, tile)
    rng = np.random.default_rng(seed)
    sums, start = np.zeros(3), {k: np.zeros_like(tape.values[x]) for k, x in out.items()}
    scale = np.where(counts > 0, shares / np.maximum(counts, 1), 0.0)
    for which, node in enumerate(("tx", "bd")):
        at = np.flatnonzero(tile[f"{node}_mask"] & (tile[f"{node}_cluster"] >= 0))
        if not len(at):
            continue
        label, sim, e = tile[f"{node}_cluster"][at], similarity[node], tape.values[out[node]]
        picked = []
        for negative in (False, True):
            cluster = draw_clusters(label, sim, rng.random(len(at)), negative)
            picked.append(at[draw_members(label, cluster, rng.random(len(at)))])
        p, n = picked
        if node == "tx":
            total, *grads = triplet_terms(e[at], e[p], e[n], margins[0])
        else:
            near = sim.copy()
            np.fill_diagonal(near, 1.0)
            near = np.maximum(near, 1e-8)
            lab = tile["bd_cluster"]
            total, *grads = metric_terms(e[at], e[p], e[n], near[label, lab[p]], near[label, lab[n]])
        sums[which] = total
        for index, g in zip((at, p, n), grads):
            start[node] += scatter(g * scale[which], index, len(e))
    src, dst = tile["belongs"]
    n_bd = len(tile["bd_cluster"])
    if n_bd > 1 and len(src):
        far = (dst + rng.integers(1, n_bd, len(dst))) % n_bd
        a, b = tape.values[out["tx"]], tape.values[out["bd"]]
        if kind == "triplet":
            sums[2], *grads = triplet_terms(a[src], b[dst], b[far], margins[1])
        else:
            sums[2], *grads = bce_terms(a[src], b[dst], b[far])
        start["tx"] += scatter(grads[0] * scale[2], src, len(a))
        start["bd"] += scatter(grads[1] * scale[2], dst, len(b)) + scatter(grads[2] * scale[2], far, len(b))
    if not gradient:
        return sums, None
    tape.back({out[k]: g for k, g in start.items()})
    return sums, {name: tape.grads[x] if tape.grads[x] is not None else np.zeros_like(arrays[name]) for name, x in leaf.items()}
