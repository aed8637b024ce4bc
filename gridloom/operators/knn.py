"""Exact planar k-nearest-neighbour joins.

Neighbour order is (distance, id), so the result is a function of the data alone.
Three things keep the join from meeting all pairs of a crowded place:

* only the ``k`` smallest ids at one location can ever be among the first ``k``
  neighbours of anything, so at most ``k`` candidates per location are kept;
* places are searched tile by tile with a halo (``tile_search``), which settles all
  but the few whose neighbours may lie beyond it;
* for those, a search window is refined cell by cell (counts only) until the cells
  that can contain a neighbour are few.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.grid import cell
from gridloom.operators.skew import keyed_join
from gridloom.operators.tile_search import TILE, tile_search
from gridloom.session import cut_lineage

# Candidates one search window may hold before it is refined.
MAX_WINDOW = 4096
# Halvings of the first cell side before cells are taken as they are.
MAX_DEPTH = 40


def _candidates(points: DataFrame, k: int, ident: str, x: str, y: str) -> DataFrame:
    """``(dst, cx, cy)``: the ``k`` smallest ids of every location."""
    at_place = Window.partitionBy("cx", "cy").orderBy("dst")
    return (
        points.select(F.col(ident).alias("dst"), F.col(x).cast("double").alias("cx"), F.col(y).cast("double").alias("cy"))
        .where(F.col("cx").isNotNull() & F.col("cy").isNotNull())
        .withColumn("_r", F.row_number().over(at_place))
        .where(F.col("_r") <= k)
        .drop("_r")
    )


def _distance2() -> Column:
    dx, dy = F.col("qx") - F.col("cx"), F.col("qy") - F.col("cy")
    return dx * dx + dy * dy


def _top_k(pairs: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("d2", "dst")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _finish(ranked: DataFrame) -> DataFrame:
    return ranked.select("src", "dst", F.sqrt("d2").alias("distance"), F.col("rank").cast("int").alias("rank"))


def knn_within(
    points: DataFrame,
    k: int,
    radius: float,
    *,
    queries: DataFrame | None = None,
    ident: str = "row_index",
    query_ident: str | None = None,
    x: str = "x",
    y: str = "y",
    closed: bool = False,
    max_window: int = MAX_WINDOW,
    tile: int = TILE,
) -> DataFrame:
    """Up to ``k`` nearest points within ``radius``: ``(src, dst, distance, rank)``.

    A query that is itself one of the points is its own first neighbour and uses one
    of the ``k`` places.  The radius is exclusive unless ``closed``.
    """
    if k < 1 or radius <= 0:
        raise ValueError("k and radius must be positive")
    candidates = _candidates(points, k, ident, x, y)
    source = points if queries is None else queries
    asked = source.select(
        F.col(query_ident or ident).alias("src"), F.col(x).cast("double").alias("qx"), F.col(y).cast("double").alias("qy")
    )
    limit2 = radius * radius
    near = F.col("d2") <= limit2 if closed else F.col("d2") < limit2
    places = asked.where(F.col("qx").isNotNull() & F.col("qy").isNotNull()).select("qx", "qy").distinct()
    found, rest = _by_tiles(candidates, places, k, radius, tile)
    if rest is not None:
        # A hair wider than the radius, so rounding can never push a neighbour two cells away.
        side = radius * (1.0 + 1e-9)
        around = F.sequence(F.lit(-1), F.lit(1))
        start = rest.withColumn("kx", F.explode(F.transform(around, lambda o: cell(F.col("qx"), side) + o))).withColumn(
            "ky", F.explode(F.transform(around, lambda o: cell(F.col("qy"), side) + o))
        )
        found = found.unionByName(_refined(start, candidates, k, side, max_window).select(*found.columns))
    return _finish(keyed_join(asked, _top_k(found.where(near), ["qx", "qy"], k), ["qx", "qy"]))


def _by_tiles(candidates: DataFrame, places: DataFrame, k: int, radius: float | None, tile: int) -> tuple[DataFrame, DataFrame | None]:
    """Neighbours ``(qx, qy, dst, cx, cy, d2)`` of the certain places, and the places left, if there are any."""
    candidates, places = cut_lineage(candidates), cut_lineage(places)
    if candidates.isEmpty() or places.isEmpty():
        schema = T.StructType([*places.schema.fields, *candidates.schema.fields])
        return candidates.sparkSession.createDataFrame([], schema).withColumn("d2", _distance2()), None
    found, rest = tile_search(candidates, places, k, radius, tile)
    rest = cut_lineage(rest)
    return found.withColumn("d2", _distance2()), None if rest.isEmpty() else rest


def knn(
    points: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    ident: str = "row_index",
    query_ident: str = "cell_id",
    x: str = "x",
    y: str = "y",
    max_window: int = MAX_WINDOW,
    tile: int = TILE,
) -> DataFrame:
    """The ``k`` nearest points of every query, at any distance."""
    if k < 1:
        raise ValueError("k must be positive")
    candidates = _candidates(points, k, ident, x, y)
    asked = queries.select(
        F.col(query_ident).alias("src"), F.col(x).cast("double").alias("qx"), F.col(y).cast("double").alias("qy")
    )
    places = asked.where(F.col("qx").isNotNull() & F.col("qy").isNotNull()).select("qx", "qy").distinct()
    found, rest = _by_tiles(candidates, places, k, None, tile)
    if rest is not None:
        reach = candidates.agg(F.max(F.greatest(F.abs("cx"), F.abs("cy")))).first()[0]
        side = 2.0 ** math.ceil(math.log2(max(reach, 2.0**-20)) + 1e-9 + 1)
        roots = F.array(F.lit(-1).cast("long"), F.lit(0).cast("long"))
        start = rest.withColumn("kx", F.explode(roots)).withColumn("ky", F.explode(roots))
        found = found.unionByName(_refined(start, candidates, k, side, max_window).select(*found.columns))
    return _finish(keyed_join(asked, _top_k(found, ["qx", "qy"], k), ["qx", "qy"]))


def uniform_candidates(points: DataFrame, cells: DataFrame, k: int, *, cell: str = "cell_encoding") -> DataFrame:
    """Candidate edges ``(src, dst)`` from each of the ``k`` points nearest to a cell's centre to the cell."""
    hits = knn(points, cells.select(cell, "x", "y"), k, query_ident=cell)
    return hits.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _refined(start: DataFrame, candidates: DataFrame, k: int, side: float, max_window: int) -> DataFrame:
    """Pairs ``(qx, qy, dst, cx, cy, d2)`` that include every true neighbour.

    Each round holds, per query place, the cells that may still contain one of its
    first ``k`` neighbours: a cell survives when its nearest point could be closer
    than the distance within which ``k`` candidates are already known to lie.  A
    place whose cells hold few enough candidates is settled; the others split their
    cells in four.
    """
    place = Window.partitionBy("qx", "qy")
    settled: list[DataFrame] = []
    live, depth = start, 0
    while True:
        here = side / 2.0**depth
        counts = candidates.groupBy(
            cell(F.col("cx"), here).alias("kx"), cell(F.col("cy"), here).alias("ky")
        ).agg(F.count(F.lit(1)).alias("n"))
        scored = live.join(counts, ["kx", "ky"])

        def gap(q: str, key: str) -> tuple[Column, Column]:
            low = F.col(key) * F.lit(here)
            high = low + F.lit(here)
            nearest = F.greatest(low - F.col(q), F.col(q) - high, F.lit(0.0))
            farthest = F.greatest(F.abs(F.col(q) - low), F.abs(F.col(q) - high))
            return nearest, farthest

        (nx, fx), (ny, fy) = gap("qx", "kx"), gap("qy", "ky")
        # Slack for rounding of cell edges; it only keeps a few more cells.
        scored = scored.withColumn("near2", (nx * nx + ny * ny) * (1 - 1e-9)).withColumn("far2", (fx * fx + fy * fy) * (1 + 1e-9))
        known = F.sum("n").over(place.orderBy("far2").rangeBetween(Window.unboundedPreceding, 0))
        scored = scored.withColumn("_reach", F.when(known >= k, F.col("far2")))
        scored = scored.withColumn("_bound", F.min("_reach").over(place))
        kept = scored.where(F.col("_bound").isNull() | (F.col("near2") <= F.col("_bound")))
        kept = kept.withColumn("_total", F.sum("n").over(place)).select("qx", "qy", "kx", "ky", "_total")
        kept = cut_lineage(kept)
        last = depth >= MAX_DEPTH
        done = kept if last else kept.where(F.col("_total") <= max_window)
        at_depth = candidates.withColumn("kx", cell(F.col("cx"), here)).withColumn("ky", cell(F.col("cy"), here))
        settled.append(done.drop("_total").join(at_depth, ["kx", "ky"]).drop("kx", "ky"))
        live = kept.where(F.col("_total") > max_window)
        if last or live.isEmpty():
            break
        halves = F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))
        live = (
            live.withColumn("_a", F.explode(halves))
            .withColumn("_b", F.explode(halves))
            .select("qx", "qy", (F.col("kx") * 2 + F.col("_a")).alias("kx"), (F.col("ky") * 2 + F.col("_b")).alias("ky"))
        )
        depth += 1
    pairs = settled[0]
    for more in settled[1:]:
        pairs = pairs.unionByName(more)
    return pairs.withColumn("d2", _distance2())


def neighbour_lists(edges: DataFrame) -> DataFrame:
    """Edge list -> one row per source with its neighbours in rank order (at most ``k``)."""
    return edges.groupBy("src").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "dst"))), lambda s: s["dst"]).alias("neighbours")
    )


def neighbour_edges(lists: DataFrame, padding=None) -> DataFrame:
    """Neighbour lists -> ``(src, dst, rank)``; entries equal to ``padding`` are dropped."""
    exploded = lists.select("src", F.posexplode("neighbours").alias("pos", "dst"))
    if padding is not None:
        exploded = exploded.where(F.col("dst") != padding)
    return exploded.select("src", "dst", (F.col("pos") + 1).alias("rank"))
