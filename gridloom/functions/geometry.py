"""Planar geometry as column expressions.

A ring is ``ARRAY<STRUCT<x, y>>``, open or closed, in either orientation.  Only
exterior rings exist in the data model.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def xy(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def edges(ring: Column) -> Column:
    """Consecutive vertex pairs, wrapping round; a closed ring adds one null-length edge."""
    shifted = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(
        ring,
        shifted,
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
    )


def open_ring(ring: Column) -> Column:
    """Drop the repeated last vertex of a closed ring."""
    n = F.size(ring)
    closed = (n > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1))
    return F.when(closed, F.slice(ring, F.lit(1), n - 1)).otherwise(ring)


def close_ring(ring: Column) -> Column:
    ring = open_ring(ring)
    return F.concat(ring, F.slice(ring, 1, 1))


def signed_area(ring: Column) -> Column:
    return F.aggregate(
        edges(ring), F.lit(0.0), lambda acc, e: acc + (e["x1"] * e["y2"] - e["x2"] * e["y1"])
    ) / F.lit(2.0)


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def centroid(ring: Column) -> Column:
    """Area centroid ``STRUCT<x, y>``; null for a ring without area."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"))

    def step(acc, e):
        w = e["x1"] * e["y2"] - e["x2"] * e["y1"]
        return F.struct(
            (acc["a"] + w).alias("a"),
            (acc["cx"] + (e["x1"] + e["x2"]) * w).alias("cx"),
            (acc["cy"] + (e["y1"] + e["y2"]) * w).alias("cy"),
        )

    def finish(acc):
        scale = F.nullif(acc["a"], F.lit(0.0)) * F.lit(3.0)
        return F.struct((acc["cx"] / scale).alias("x"), (acc["cy"] / scale).alias("y"))

    return F.aggregate(edges(ring), zero, step, finish)


def envelope(ring: Column) -> Column:
    """Axis-aligned box ``STRUCT<x_min, y_min, x_max, y_max>``."""
    xs = F.transform(ring, lambda p: p["x"])
    ys = F.transform(ring, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("x_min"),
        F.array_min(ys).alias("y_min"),
        F.array_max(xs).alias("x_max"),
        F.array_max(ys).alias("y_max"),
    )


def on_boundary(ring_edges: Column, x: Column, y: Column) -> Column:
    """True when the point lies on one of the edges, ends included."""

    def hit(e):
        cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        return (
            (cross == 0.0)
            & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
            & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        )

    return F.exists(ring_edges, hit)


def even_odd(ring_edges: Column, x: Column, y: Column) -> Column:
    """Ray-casting parity; the value on the boundary itself is not meaningful."""

    def crosses(e):
        at = (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
        return F.coalesce(((e["y1"] > y) != (e["y2"] > y)) & (x < at), F.lit(False))

    count = F.aggregate(ring_edges, F.lit(0), lambda acc, e: acc + F.when(crosses(e), 1).otherwise(0))
    return count % 2 == 1


def contains_point(ring_edges: Column, x: Column, y: Column) -> Column:
    """Strict interior."""
    return even_odd(ring_edges, x, y) & ~on_boundary(ring_edges, x, y)


def intersects_point(ring_edges: Column, x: Column, y: Column) -> Column:
    """Interior or boundary."""
    return even_odd(ring_edges, x, y) | on_boundary(ring_edges, x, y)


def distance_to_ring(ring_edges: Column, x: Column, y: Column) -> Column:
    """Distance from a point to the ring line (0 only on the boundary)."""

    def squared(e):
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        length2 = F.nullif(dx * dx + dy * dy, F.lit(0.0))
        t = F.coalesce(((x - e["x1"]) * dx + (y - e["y1"]) * dy) / length2, F.lit(0.0))
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        px, py = x - (e["x1"] + t * dx), y - (e["y1"] + t * dy)
        return px * px + py * py

    return F.sqrt(F.array_min(F.transform(ring_edges, squared)))


def segments_cross(a: Column, b: Column) -> Column:
    """Closed segments share at least one point."""

    def turn(ax, ay, bx, by, cx, cy):
        return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))

    d1 = turn(a["x1"], a["y1"], a["x2"], a["y2"], b["x1"], b["y1"])
    d2 = turn(a["x1"], a["y1"], a["x2"], a["y2"], b["x2"], b["y2"])
    d3 = turn(b["x1"], b["y1"], b["x2"], b["y2"], a["x1"], a["y1"])
    d4 = turn(b["x1"], b["y1"], b["x2"], b["y2"], a["x2"], a["y2"])
    boxes = (
        (F.greatest(a["x1"], a["x2"]) >= F.least(b["x1"], b["x2"]))
        & (F.greatest(b["x1"], b["x2"]) >= F.least(a["x1"], a["x2"]))
        & (F.greatest(a["y1"], a["y2"]) >= F.least(b["y1"], b["y2"]))
        & (F.greatest(b["y1"], b["y2"]) >= F.least(a["y1"], a["y2"]))
    )
    return boxes & (d1 * d2 <= 0) & (d3 * d4 <= 0)


def translate_scale(ring: Column, sx, sy, tx, ty) -> Column:
    """Affine map ``(x * sx + tx, y * sy + ty)``."""
    sx, sy, tx, ty = (v if isinstance(v, Column) else F.lit(float(v)) for v in (sx, sy, tx, ty))
    return F.transform(ring, lambda p: xy(p["x"] * sx + tx, p["y"] * sy + ty))


def sort_ring_ccw(ring: Column) -> Column:
    """Order the vertices by angle round their mean (the closing vertex counts twice)."""
    closed = close_ring(ring)
    n = F.size(closed).cast("double")
    cx = F.aggregate(closed, F.lit(0.0), lambda acc, p: acc + p["x"]) / n
    cy = F.aggregate(closed, F.lit(0.0), lambda acc, p: acc + p["y"]) / n
    keyed = F.transform(
        F.array(F.struct(closed.alias("r"), cx.alias("cx"), cy.alias("cy"))),
        lambda s: F.transform(
            s["r"],
            lambda p, i: F.struct(
                F.atan2(p["y"] - s["cy"], p["x"] - s["cx"]).alias("angle"), i.alias("i"), p.alias("p")
            ),
        ),
    )[0]
    return F.transform(F.array_sort(keyed), lambda k: k["p"])


def chaikin(ring: Column, iterations: int = 1) -> Column:
    """Chaikin (1974) corner cutting: each vertex becomes two, at 1/4 and 3/4 of its edge."""
    ring = open_ring(ring)
    for _ in range(iterations):
        ring = F.flatten(
            F.transform(
                edges(ring),
                lambda e: F.array(
                    xy(e["x1"] * 0.75 + e["x2"] * 0.25, e["y1"] * 0.75 + e["y2"] * 0.25),
                    xy(e["x1"] * 0.25 + e["x2"] * 0.75, e["y1"] * 0.25 + e["y2"] * 0.75),
                ),
            )
        )
    return ring


def owns_region(ring: Column, inset: tuple, outset: tuple) -> Column:
    """Whether a region owns a polygon: all vertices in the centre, or reaching over
    the left edge but not the bottom one, or over the top edge but not the right one.

    ``inset`` / ``outset`` are ``(x_min, y_min, x_max, y_max)``.
    """
    x2, y2, x3, y3 = (float(v) for v in inset)
    x1, y1, x4, y4 = (float(v) for v in outset)

    def some(xa, ya, xb, yb):
        return F.exists(ring, lambda p: p["x"].between(xa, xb) & p["y"].between(ya, yb))

    whole = F.forall(ring, lambda p: p["x"].between(x2, x3) & p["y"].between(y2, y3))
    centre = some(x2, y2, x3, y3)
    top, left = some(x1, y1, x4, y2), some(x1, y1, x2, y4)
    right, bottom = some(x3, y1, x4, y4), some(x1, y3, x4, y4)
    return whole | (centre & left & ~bottom) | (centre & top & ~right)
