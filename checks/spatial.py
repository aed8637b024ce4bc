"""Spatial joins, nearest neighbours, tilings and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import EVENTS, POINTS, POLYGONS, query, r, with_
from gridloom.functions import geometry as G
from gridloom.operators import graph as GR
from gridloom.operators import tiling as TL
from gridloom.operators.buffered_counts import buffered_counts, expression_matrix, point_regions
from gridloom.operators.knn import knn, knn_within, neighbour_edges, neighbour_lists, uniform_candidates
from gridloom.operators.numbering import encode
from gridloom.operators.packing import pack_tiles, tile_weights
from gridloom.operators.skew import sized
from gridloom.operators.spatial_join import (
    assign_points_to_polygons,
    points_in_polygons,
    polygons_in_polygons,
    prediction_candidates,
)
from gridloom.session import cut_lineage

# --- points and polygons --------------------------------------------------------

_PIP = """cand AS (SELECT p.row_index, p.x, p.y, p.feature_name, p.qv, b.cell_id FROM points p JOIN boxes b
  ON p.x BETWEEN b.bx0 AND b.bx1 AND p.y BETWEEN b.by0 AND b.by1),
hit AS (SELECT row_index, cell_id, feature_name, sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    THEN 1 ELSE 0 END) % 2 = 1 AS odd,
  bool_or((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) = 0 AND x BETWEEN least(x1, x2) AND greatest(x1, x2)
    AND y BETWEEN least(y1, y2) AND greatest(y1, y2)) AS rim
  FROM cand JOIN edges USING (cell_id) GROUP BY ALL)"""


@query(
    "j_pip_contains",
    with_(POINTS, POLYGONS, _PIP) + "SELECT row_index AS index_query, cell_id AS index_match FROM hit WHERE odd AND NOT rim",
)
def j_pip_contains(t):
    return points_in_polygons(t.points, t.polygons, "contains")


@query(
    "j_pip_intersects",
    with_(POINTS, POLYGONS, _PIP) + "SELECT row_index AS index_query, cell_id AS index_match FROM hit WHERE odd OR rim",
)
def j_pip_intersects(t):
    return points_in_polygons(t.points, t.polygons, "intersects")


@query(
    "j_spatial_left",
    with_(POINTS, POLYGONS, _PIP)
    + """SELECT p.row_index, h.cell_id AS boundaries_id FROM points p
      LEFT JOIN (SELECT * FROM hit WHERE odd OR rim) h USING (row_index)""",
)
def j_spatial_left(t):
    return assign_points_to_polygons(t.points.select("row_index", "x", "y"), t.polygons).select("row_index", "boundaries_id")


_GAP = """grown AS (SELECT cell_id, {d} AS d FROM areas),
near AS (SELECT p.row_index, p.x, p.y, p.feature_name, b.cell_id, g.d FROM points p JOIN boxes b ON TRUE JOIN grown g ON g.cell_id = b.cell_id
  WHERE {q} p.x BETWEEN b.bx0 - g.d AND b.bx1 + g.d AND p.y BETWEEN b.by0 - g.d AND b.by1 + g.d),
tt AS (SELECT row_index, cell_id, feature_name, d, x, y, x1, y1, x2, y2, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1))
  / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) AS u FROM near JOIN edges USING (cell_id)),
reach AS (SELECT row_index, cell_id, feature_name, sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    THEN 1 ELSE 0 END) % 2 = 1 OR sqrt(min((x - x1 - u * (x2 - x1)) ** 2 + (y - y1 - u * (y2 - y1)) ** 2)) < d AS inside
  FROM tt GROUP BY row_index, cell_id, feature_name, d)"""


@query(
    "j_candidates",
    with_(POINTS, POLYGONS, _GAP.format(d="0.25 * sqrt(area / pi())", q=""))
    + "SELECT row_index AS src, cell_id AS dst FROM reach WHERE inside",
)
def j_candidates(t):
    return prediction_candidates(t.points, t.polygons, 0.25, polygon_id="cell_id")


@query(
    "a_polygon_counts",
    with_(POINTS, POLYGONS, _PIP) + "SELECT cell_id, feature_name, count(*) AS n FROM hit WHERE odd AND NOT rim GROUP BY ALL",
)
def a_polygon_counts(t):
    return expression_matrix(t.points, t.polygons)


@query(
    "a_buffered_counts",
    with_(POINTS, POLYGONS, _GAP.format(d="CAST(3 AS DOUBLE)", q="p.qv > 20 AND"))
    + "SELECT cell_id, feature_name, count(*) AS n FROM reach WHERE inside GROUP BY ALL",
)
def a_buffered_counts(t):
    return buffered_counts(t.points, t.polygons, 3.0)


_OWN = """flags AS (SELECT cell_id, count(*) AS total,
  count(*) FILTER (x BETWEEN 300 AND 700 AND y BETWEEN 1600 AND 2800) AS centre,
  count(*) FILTER (x BETWEEN 200 AND 800 AND y BETWEEN 1500 AND 1600) AS top,
  count(*) FILTER (x BETWEEN 200 AND 300 AND y BETWEEN 1500 AND 2900) AS lft,
  count(*) FILTER (x BETWEEN 700 AND 800 AND y BETWEEN 1500 AND 2900) AS rgt,
  count(*) FILTER (x BETWEEN 200 AND 800 AND y BETWEEN 2800 AND 2900) AS bottom FROM verts GROUP BY 1),
own AS (SELECT cell_id FROM flags WHERE centre = total OR (centre > 0 AND lft > 0 AND bottom = 0)
  OR (centre > 0 AND top > 0 AND rgt = 0))"""


@query("g_owned_polygons", with_(POLYGONS, _OWN) + "SELECT cell_id FROM own")
def g_owned_polygons(t):
    kept = G.owns_region(F.col("ring"), (300, 1600, 700, 2800), (200, 1500, 800, 2900))
    return t.polygons.where(kept).select("cell_id")


@query(
    "a_region_counts",
    with_(POINTS, POLYGONS, _OWN, _GAP.format(d="CAST(3 AS DOUBLE)", q="p.qv > 20 AND p.x > 200 AND p.x < 800 AND p.y > 1500 AND p.y < 2900 AND"))
    + """SELECT cell_id, feature_name, count(*) AS n FROM reach WHERE inside AND cell_id IN (SELECT cell_id FROM own) GROUP BY ALL""",
)
def a_region_counts(t):
    return buffered_counts(t.points, t.polygons, 3.0, bounds=(300, 1600, 700, 2800), overlap=100.0)


# Convex against convex: two shapes meet when no edge normal of either separates them.
# Convex pieces: a hexagon is one, an arrow is cut in two from its notch to its tip; ``hull`` is the arrow
# with its notch filled.  Two convex pieces are apart where an edge of one of them separates their spans.
_PIECES = """bit(kind, piece, i, v) AS (VALUES (0, 0, 0, 0), (0, 0, 1, 1), (0, 0, 2, 2), (0, 0, 3, 3), (0, 0, 4, 4), (0, 0, 5, 5),
  (1, 0, 0, 0), (1, 0, 1, 1), (1, 0, 2, 3), (1, 1, 0, 1), (1, 1, 1, 2), (1, 1, 2, 3), (1, 2, 0, 0), (1, 2, 1, 3), (1, 2, 2, 2)),
pv AS (SELECT cell_id, piece, b.i, x, y, count(*) OVER (PARTITION BY cell_id, piece) AS m FROM verts v JOIN bit b ON b.kind = cell_id % 2 AND b.v = v.i),
pe AS (SELECT a.cell_id, a.piece, a.i, a.y - b.y AS nx, b.x - a.x AS ny FROM pv a JOIN pv b ON a.cell_id = b.cell_id AND a.piece = b.piece AND b.i = (a.i + 1) % a.m),
bp AS (SELECT a.cell_id AS a, b.cell_id AS b FROM boxes a JOIN boxes b ON a.bx0 <= b.bx1 AND b.bx0 <= a.bx1 AND a.by0 <= b.by1 AND b.by0 <= a.by1),
pp AS (SELECT bp.*, p.piece AS ap, q.piece AS bq FROM bp JOIN (SELECT DISTINCT cell_id, piece FROM pv) p ON p.cell_id = a JOIN (SELECT DISTINCT cell_id, piece FROM pv) q ON q.cell_id = b),
axes AS (SELECT pp.*, 0 AS side, i, nx, ny FROM pp JOIN pe ON pe.cell_id = a AND pe.piece = ap UNION ALL
  SELECT pp.*, 1, i, nx, ny FROM pp JOIN pe ON pe.cell_id = b AND pe.piece = bq),
spans AS (SELECT x.a, x.b, ap, bq, side, x.i,
  (SELECT min(nx * v.x + ny * v.y) FROM pv v WHERE v.cell_id = x.a AND v.piece = ap) AS a0, (SELECT max(nx * v.x + ny * v.y) FROM pv v WHERE v.cell_id = x.a AND v.piece = ap) AS a1,
  (SELECT min(nx * v.x + ny * v.y) FROM pv v WHERE v.cell_id = x.b AND v.piece = bq) AS b0, (SELECT max(nx * v.x + ny * v.y) FROM pv v WHERE v.cell_id = x.b AND v.piece = bq) AS b1
  FROM axes x)"""


@query(
    "j_polygons_intersect",
    with_(POLYGONS, _PIECES)
    + """, met AS (SELECT a, b FROM spans WHERE ap < 2 AND bq < 2 GROUP BY a, b, ap, bq HAVING bool_and(a0 <= b1 AND b0 <= a1))
      SELECT DISTINCT a AS index_query, b AS index_match FROM met""",
)
def j_polygons_intersect(t):
    return polygons_in_polygons(t.polygons, t.polygons, "intersects")


# Piece 2 of an arrow is its notch: what is covered lies in the hull and meets no inner point of the notch.
@query(
    "j_polygons_contain",
    with_(POLYGONS, _PIECES)
    + """, rim AS (SELECT cell_id, x1, y1, x2, y2 FROM edges WHERE cell_id % 2 = 0 UNION ALL
        SELECT a.cell_id, a.x, a.y, b.x, b.y FROM verts a JOIN verts b ON a.cell_id = b.cell_id AND b.i = (a.i + 1) % 3 WHERE a.cell_id % 2 = 1 AND a.i < 3),
      inside AS (SELECT bp.a, bp.b FROM bp JOIN verts v ON v.cell_id = bp.a JOIN rim r ON r.cell_id = bp.b GROUP BY 1, 2
        HAVING bool_and((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) >= 0)),
      apart AS (SELECT a, b, ap FROM spans WHERE ap < 2 AND bq = 2 GROUP BY a, b, ap HAVING bool_or(a1 <= b0 OR b1 <= a0)),
      whole AS (SELECT a, b, count(*) AS n FROM apart GROUP BY 1, 2)
      SELECT i.a AS index_query, i.b AS index_match FROM inside i LEFT JOIN whole w ON w.a = i.a AND w.b = i.b
      WHERE i.b % 2 = 0 OR w.n = CASE WHEN i.a % 2 = 0 THEN 1 ELSE 2 END""",
)
def j_polygons_contain(t):
    return polygons_in_polygons(t.polygons, t.polygons, "contains")


# --- nearest neighbours ---------------------------------------------------------

_KNN = """knn AS (SELECT * FROM (SELECT q.row_index AS src, p.row_index AS dst, sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) AS distance,
  row_number() OVER (PARTITION BY q.row_index ORDER BY (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y), p.row_index) AS rank
  FROM ev q JOIN ev p ON p.x BETWEEN q.x - 5 AND q.x + 5 AND p.y BETWEEN q.y - 5 AND q.y + 5
  WHERE (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) < 25) WHERE rank <= 5)"""


@query("j_knn_radius", with_(EVENTS, _KNN) + "SELECT src, dst, round(distance, 6) + 0 AS distance, rank FROM knn")
def j_knn_radius(t):
    return knn_within(t.event_points, 5, 5.0).withColumn("distance", r("distance"))


@query(
    "w_neighbour_lists",
    with_(EVENTS, _KNN)
    + """SELECT src, count(*) AS k, CAST(min(dst) FILTER (rank = 1) AS BIGINT) AS nearest, CAST(sum(dst * rank) AS BIGINT) AS code FROM knn GROUP BY 1""",
)
def w_neighbour_lists(t):
    back = neighbour_edges(neighbour_lists(knn_within(t.event_points, 5, 5.0)))
    return back.groupBy("src").agg(
        F.count(F.lit(1)).alias("k"),
        F.min(F.when(F.col("rank") == 1, F.col("dst"))).alias("nearest"),
        F.sum(F.col("dst") * F.col("rank")).alias("code"),
    )


@query(
    "j_knn_unbounded",
    with_(EVENTS, POLYGONS)
    + """SELECT * EXCLUDE (d) FROM (SELECT b.cell_id AS src, row_index AS dst, row_number() OVER (PARTITION BY b.cell_id ORDER BY d, row_index) AS rank, d
        FROM (SELECT b.cell_id, e.row_index, (b.cx - e.x) * (b.cx - e.x) + (b.cy - e.y) * (b.cy - e.y) AS d FROM placed b, ev e) b) WHERE rank <= 3""",
)
def j_knn_unbounded(t):
    return knn(t.event_points, _centres(t), 3).select("src", "dst", "rank")


def _centres(t):
    key = F.col("s_suppkey")
    return t.supplier.select(
        key.alias("cell_id"),
        (F.lit(30) + F.pmod(key * 37, F.lit(100)) * 10).cast("double").alias("x"),
        (F.lit(1100) + F.pmod(key * 53, F.lit(100)) * 25).cast("double").alias("y"),
    )


@query(
    "j_uniform_candidates",
    with_(EVENTS, POLYGONS)
    + """SELECT row_index AS src, cell_id AS dst FROM (SELECT b.cell_id, e.row_index, row_number() OVER (PARTITION BY b.cell_id
        ORDER BY (b.cx - e.x) * (b.cx - e.x) + (b.cy - e.y) * (b.cy - e.y), e.row_index) AS rank FROM placed b, ev e) WHERE rank <= 5""",
)
def j_uniform_candidates(t):
    return uniform_candidates(t.event_points, _centres(t), 5, cell="cell_id")


# --- tilings --------------------------------------------------------------------

_EXTENT = "ext AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM ev)"
_SQUARE = """nn AS (SELECT *, CAST(ceil((x1 - x0) / 60) AS BIGINT) AS nx, CAST(ceil((y1 - y0) / 60) AS BIGINT) AS ny FROM ext),
tiles AS (SELECT i * ny + j AS tile_id, x0 + i * 60 AS x_min, y0 + j * 60 AS y_min, least(x0 + i * 60 + 60, x1) AS x_max,
  least(y0 + j * 60 + 60, y1) AS y_max FROM nn, range(nx) a(i), range(ny) b(j))"""


def _r4(df):
    for c in TL.TILE_BOUNDS:
        df = df.withColumn(c, r(c, 4))
    return df


@query(
    "q_square_tiles",
    with_(EVENTS, _EXTENT, _SQUARE)
    + """SELECT CAST(tile_id AS BIGINT) AS tile_id, round(x_min, 4) + 0 AS x_min, round(y_min, 4) + 0 AS y_min,
      round(x_max, 4) + 0 AS x_max, round(y_max, 4) + 0 AS y_max FROM tiles""",
)
def q_square_tiles(t):
    return _r4(TL.square_tiles(t.event_points, 60.0))


@query(
    "j_tile_label",
    with_(EVENTS, _EXTENT, _SQUARE)
    + """SELECT row_index, coalesce(min(tile_id), -1) AS tile_id FROM ev LEFT JOIN tiles
      ON x BETWEEN x_min AND x_max AND y BETWEEN y_min AND y_max GROUP BY 1""",
)
def j_tile_label(t):
    points = t.event_points.select("row_index", "x", "y")
    return TL.label_points(points, TL.square_tiles(points, 60.0)).select("row_index", "tile_id")


@query(
    "q_tile_mask",
    with_(EVENTS, _EXTENT, _SQUARE)
    + """, m AS (SELECT min(least(x_max - x_min, y_max - y_min)) AS s FROM tiles),
      mm AS (SELECT max(20 / 2 ** k) AS m FROM m, range(60) a(k) WHERE 2 * (20 / 2 ** k) < s)
      SELECT row_index, coalesce(bool_or(x > x_min + m AND x < x_max - m AND y > y_min + m AND y < y_max - m), FALSE) AS in_core
      FROM ev, mm, tiles WHERE x BETWEEN x_min AND x_max AND y BETWEEN y_min AND y_max GROUP BY 1""",
)
def q_tile_mask(t):
    points = t.event_points.select("row_index", "x", "y")
    return TL.mask_points(points, TL.square_tiles(points, 60.0), 20.0).select("row_index", "in_core")


@query(
    "p_tile_fit",
    with_(EVENTS, _EXTENT, _SQUARE)
    + """, m AS (SELECT min(least(x_max - x_min, y_max - y_min)) AS s FROM tiles),
      mm AS (SELECT max(20 / 2 ** k) AS m FROM m, range(60) a(k) WHERE 2 * (20 / 2 ** k) < s)
      SELECT row_index, CAST(min(tile_id) AS BIGINT) AS tile_id, bool_or(x > x_min + m AND x < x_max - m AND y > y_min + m AND y < y_max - m) AS in_core
      FROM ev, mm, tiles WHERE x BETWEEN x_min AND x_max AND y BETWEEN y_min AND y_max GROUP BY 1""",
)
def p_tile_fit(t):
    points = t.event_points.select("row_index", "x", "y")
    return TL.tile_fit_nodes(points, TL.square_tiles(points, 60.0), 20.0).select("row_index", "tile_id", "in_core")


@query(
    "p_tile_predict",
    with_(EVENTS, _EXTENT, _SQUARE)
    + """SELECT CAST(tile_id AS BIGINT) AS tile_id, row_index, x BETWEEN x_min AND x_max AND y BETWEEN y_min AND y_max AS is_core FROM ev JOIN tiles
      ON x >= x_min - 8 AND x < x_max + 8 AND y >= y_min - 8 AND y < y_max + 8""",
)
def p_tile_predict(t):
    points = t.event_points.select("row_index", "x", "y")
    return TL.tile_predict_nodes(points, TL.square_tiles(points, 60.0), 8.0)


_TREE = """sh AS (SELECT x0 - 50 AS x0, y0 - 50 AS y0, x1 + 50 AS x1, y1 + 50 AS y1 FROM ext),
s1 AS (SELECT *, greatest(x1 - x0, y1 - y0) AS span FROM sh),
s2 AS (SELECT *, 2.0::DOUBLE ** ceil(log2(span)) AS top, least(CAST(floor(log2(span)) AS INT) + 1, 15) AS depth FROM s1),
lv AS (SELECT unnest(range(depth)) AS level, * FROM s2),
keyed AS (SELECT row_index, level, depth, top, x0, y0, x1, y1, CAST(floor((x - x0) / (top / 2 ** depth)) AS BIGINT) >> CAST(depth - 1 - level AS INT) AS kx,
  CAST(floor((y - y0) / (top / 2 ** depth)) AS BIGINT) >> CAST(depth - 1 - level AS INT) AS ky FROM ev, lv),
nodes AS (SELECT level, depth, top, x0, y0, x1, y1, kx, ky, count(*) AS n FROM keyed GROUP BY ALL),
leaves AS (SELECT c.* FROM nodes c LEFT JOIN nodes p ON p.level = c.level - 1 AND p.kx = c.kx >> 1 AND p.ky = c.ky >> 1
  WHERE (c.n <= 200 OR c.level = c.depth - 1) AND (c.level = 0 OR p.n > 200))"""


@query("q_quadtree_nodes", with_(EVENTS, _EXTENT, _TREE) + "SELECT CAST(level AS INT) AS level, kx, ky, n FROM nodes")
def q_quadtree_nodes(t):
    points = t.event_points
    return TL.quadtree_nodes(points, TL.quadtree_shape(points))


@query(
    "q_quadtree_leaves",
    with_(EVENTS, _EXTENT, _TREE)
    + """SELECT CAST(level AS BIGINT) * 1099511627776 + kx * 1048576 + ky AS tile_id, CAST(level AS INT) AS level, kx, ky, n,
      round(x0 + kx * (top / 2 ** (level + 1)), 4) + 0 AS x_min, round(y0 + ky * (top / 2 ** (level + 1)), 4) + 0 AS y_min,
      round(least(x0 + kx * (top / 2 ** (level + 1)) + top / 2 ** (level + 1), x1), 4) + 0 AS x_max,
      round(least(y0 + ky * (top / 2 ** (level + 1)) + top / 2 ** (level + 1), y1), 4) + 0 AS y_max FROM leaves""",
)
def q_quadtree_leaves(t):
    points = t.event_points
    return _r4(TL.quadtree_leaves(points, 200, TL.quadtree_shape(points)))


@query(
    "q_quadtree_label",
    with_(EVENTS, _EXTENT, _TREE)
    + """SELECT k.row_index, CAST(k.level AS BIGINT) * 1099511627776 + k.kx * 1048576 + k.ky AS tile_id
      FROM keyed k JOIN leaves l ON k.level = l.level AND k.kx = l.kx AND k.ky = l.ky""",
)
def q_quadtree_label(t):
    points = t.event_points.select("row_index", "x", "y")
    shape = TL.quadtree_shape(points)
    return TL.quadtree_label(points, TL.quadtree_leaves(points, 200, shape), shape).select("row_index", "tile_id")


@query(
    "q_point_regions",
    with_(EVENTS, _EXTENT)
    + """, q AS (SELECT x0 - 1 AS x0, y0 - 1 AS y0, x1 + 1 AS x1, y1 + 1 AS y1 FROM ext),
      k AS (SELECT level, x0, y0, (x1 - x0) AS w, (y1 - y0) AS h, CAST(floor((x - x0) / ((x1 - x0) / 1024)) AS BIGINT) >> CAST(9 - level AS INT) AS kx,
        CAST(floor((y - y0) / ((y1 - y0) / 1024)) AS BIGINT) >> CAST(9 - level AS INT) AS ky
        FROM ev, q, range(10) a(level) WHERE x > x0 AND x < x1 AND y > y0 AND y < y1),
      nd AS (SELECT level, w, h, x0, y0, kx, ky, count(*) AS n FROM k GROUP BY ALL),
      lf AS (SELECT c.* FROM nd c LEFT JOIN nd p ON p.level = c.level - 1 AND p.kx = c.kx >> 1 AND p.ky = c.ky >> 1
        WHERE (c.n <= 100 OR c.level = 9) AND (c.level = 0 OR p.n > 100))
      SELECT n, round(x0 + kx * (w / 2 ** (level + 1)), 4) + 0 AS x_min, round(y0 + ky * (h / 2 ** (level + 1)), 4) + 0 AS y_min FROM lf""",
)
def q_point_regions(t):
    points = t.event_points
    x0, y0, x1, y1 = TL.extent(points)
    leaves = point_regions(points, (x0 - 1, y0 - 1, x1 + 1, y1 + 1), 100)
    return leaves.select("n", r("x_min", 4).alias("x_min"), r("y_min", 4).alias("y_min"))


@query(
    "q_morton_decode",
    """SELECT event_id, CAST(sum(((event_id >> (2 * b)) & 1) << b) AS BIGINT) AS x, CAST(sum(((event_id >> (2 * b + 1)) & 1) << b) AS BIGINT) AS y
       FROM (SELECT event_id, CAST(b AS INT) AS b FROM events, range(31) a(b)) GROUP BY 1""",
)
def q_morton_decode(t):
    d = TL.morton_decode(F.col("event_id"))
    return t.events.select("event_id", d["x"].alias("x"), d["y"].alias("y"))


# --- graphs ---------------------------------------------------------------------


def _labels(t):
    points = t.event_points.select("row_index", "x", "y")
    shape = TL.quadtree_shape(points)
    labelled = TL.quadtree_label(points, TL.quadtree_leaves(points, 200, shape), shape)
    return labelled.select(F.col("row_index").alias("id"), "tile_id")


_LABELLED = """lab AS (SELECT k.row_index AS id, CAST(k.level AS BIGINT) * 1099511627776 + k.kx * 1048576 + k.ky AS tile_id
  FROM keyed k JOIN leaves l ON k.level = l.level AND k.kx = l.kx AND k.ky = l.ky)"""


@query(
    "p_partition_edges",
    with_(EVENTS, _EXTENT, _TREE, _LABELLED, _KNN)
    + "SELECT a.tile_id, src, dst FROM knn JOIN lab a ON a.id = src JOIN lab b ON b.id = dst WHERE a.tile_id = b.tile_id",
)
def p_partition_edges(t):
    edges = knn_within(t.event_points, 5, 5.0).select("src", "dst")
    labels = _labels(t)
    return GR.partition_edges(edges, labels, labels)


@query(
    "p_local_edges",
    with_(EVENTS, _EXTENT, _TREE, _LABELLED, _KNN)
    + """, loc AS (SELECT tile_id, id, row_number() OVER (PARTITION BY tile_id ORDER BY id) - 1 AS l FROM lab)
      SELECT a.tile_id, a.l AS local_src, b.l AS local_dst FROM knn JOIN loc a ON a.id = src JOIN loc b ON b.id = dst WHERE a.tile_id = b.tile_id""",
)
def p_local_edges(t):
    edges = knn_within(t.event_points, 5, 5.0).select("src", "dst")
    # Labels and local ids are read at both ends of the edges.
    labels = cut_lineage(_labels(t))
    local = cut_lineage(GR.local_ids(labels, "id"))
    inside = GR.partition_edges(edges, labels, labels)
    return GR.localise_edges(inside, local, local).select("tile_id", "local_src", "local_dst")


@query(
    "w_permutation",
    with_(EVENTS, _EXTENT, _TREE, _LABELLED)
    + "SELECT id, CAST(row_number() OVER (ORDER BY tile_id, id) - 1 AS BIGINT) AS new_id FROM lab",
)
def w_permutation(t):
    labels = _labels(t)
    return GR.permutation(labels, TL.tile_sizes(labels), "id").select("id", "new_id")


@query(
    "j_induced_edges",
    with_(EVENTS, _EXTENT, _SQUARE, _KNN)
    + """, ctx AS (SELECT CAST(tile_id AS BIGINT) AS tile_id, row_index FROM ev JOIN tiles
        ON x >= x_min - 8 AND x < x_max + 8 AND y >= y_min - 8 AND y < y_max + 8)
      SELECT a.tile_id, src, dst FROM knn JOIN ctx a ON a.row_index = src JOIN ctx b ON b.row_index = dst AND a.tile_id = b.tile_id""",
)
def j_induced_edges(t):
    points = t.event_points.select("row_index", "x", "y")
    context = TL.tile_predict_nodes(points, TL.square_tiles(points, 60.0), 8.0)
    context = context.select("tile_id", F.col("row_index").alias("id"))
    return GR.induced_edges(knn_within(points, 5, 5.0).select("src", "dst"), context, context)


@query(
    "p_check_partition",
    with_(EVENTS, _EXTENT, _TREE, _LABELLED) + "SELECT tile_id, count(*) AS n FROM lab GROUP BY 1",
)
def p_check_partition(t):
    """Sizes of partitions that passed the check: every node labelled once, no label without a node."""
    labels = cut_lineage(_labels(t))
    GR.check_partition(t.event_points.select(F.col("row_index").alias("id")), labels)
    return labels.groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p_node_attribute",
    with_(EVENTS, _EXTENT, _TREE, _LABELLED)
    + """SELECT lab.id, tile_id, value FROM lab LEFT JOIN (SELECT event_id AS id, value FROM events WHERE event_type <> 'click') USING (id)""",
)
def p_node_attribute(t):
    """An attribute table that lacks some nodes, joined to partitioned nodes."""
    values = t.events.where("event_type <> 'click'").select(F.col("event_id").alias("id"), "value")
    return GR.add_node_attribute(_labels(t), values)


@query(
    "j_training_polygons",
    with_(POLYGONS)
    + """SELECT cell_id, CAST(row_number() OVER (ORDER BY cell_id) - 1 AS INT) AS cell_encoding, CAST(cell_id % 3 AS INT) AS cell_cluster,
      CASE WHEN cell_id % 2 = 0 THEN 6 ELSE 4 END AS vertices FROM placed""",
)
def j_training_polygons(t):
    cells = encode(t.polygons, "cell_id", "cell_encoding").withColumn("cluster", F.pmod("cell_id", F.lit(3)))
    return GR.training_polygons(t.polygons, cells).select("cell_id", "cell_encoding", "cell_cluster", F.size("ring").alias("vertices"))


@query(
    "p_fetch_partition",
    "SELECT user_id AS tile_id, event_id FROM events WHERE user_id = (SELECT max(user_id) FROM events)",
)
def p_fetch_partition(t):
    nodes = t.events.select(F.col("user_id").alias("tile_id"), "event_id")
    n = nodes.agg(F.max("tile_id")).first()[0] + 1
    return GR.fetch_partition(nodes, -1, n)


@query(
    "p_tile_weights",
    """SELECT k AS tile_id, CAST(sum(n) AS BIGINT) AS weight FROM (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1
       UNION ALL SELECT s_suppkey, count(*) FROM supplier GROUP BY 1) GROUP BY 1""",
)
def p_tile_weights(t):
    return tile_weights(
        t.lineitem.select(F.col("l_suppkey").alias("tile_id")), t.supplier.select(F.col("s_suppkey").alias("tile_id"))
    )


_PACKED = "SELECT o_custkey AS tile_id, CAST(count(*) AS DOUBLE) AS weight, TRUE AS within FROM orders GROUP BY 1"


def _packed(t, algorithm, **kwargs):
    """Packed tiles with a flag that their batch respects the capacity."""
    weights = tile_weights(t.orders.select(F.col("o_custkey").alias("tile_id")))
    packed = pack_tiles(weights, 200.0, algorithm, **kwargs)
    load = packed.groupBy("batch_id").agg((F.sum("weight") <= 200).alias("within"))
    return packed.join(load, "batch_id").select("tile_id", "weight", "within")


@query("p_pack_best_fit", _PACKED)
def p_pack_best_fit(t):
    return _packed(t, "best_fit")


@query("p_pack_first_fit", _PACKED)
def p_pack_first_fit(t):
    # The same seed and epoch pack the same way, so both evaluations agree.
    return _packed(t, "first_fit", seed=1)


@query("p_pack_harmonic", _PACKED)
def p_pack_harmonic(t):
    return _packed(t, "harmonic")


@query(
    "p_negative_edges",
    "SELECT 0 AS positives, 0 AS repeats, 0 AS outside, count(DISTINCT (l_partkey, l_suppkey)) AS edges FROM lineitem",
)
def p_negative_edges(t):
    """Drawn non-edges: none is an edge, none repeats, all ids exist."""
    pairs = t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    edges = cut_lineage(sized(pairs, pairs.count(), "src", "dst").distinct())
    drawn = GR.negative_edges(edges, 3.0)
    # As many tasks as the draws have, so that these stay where they are.
    known = sized(edges, 4 * edges.count(), "src", "dst").withColumn("_edge", F.lit(1))
    top = edges.agg(F.max("dst")).scalar()
    n_edges = edges.agg(F.count(F.lit(1))).scalar()
    return drawn.join(known, ["src", "dst"], "left").agg(
        F.count("_edge").alias("positives"),
        (F.count(F.lit(1)) - F.countDistinct("src", "dst")).alias("repeats"),
        F.count_if((F.col("dst") < 0) | (F.col("dst") > top)).alias("outside"),
        F.max(n_edges).alias("edges"),
    )


@query(
    "p_typed_edges",
    """SELECT 'tx-tx' AS edge_type, l_orderkey AS src, l_partkey AS dst FROM lineitem UNION ALL
       SELECT 'tx-belongs-bd', l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' UNION ALL
       SELECT 'tx-neighbors-bd', l_partkey, l_suppkey FROM lineitem""",
)
def p_typed_edges(t):
    line = t.lineitem
    pair = [F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")]
    return GR.typed_edges(
        line.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")),
        line.where("l_returnflag = 'R'").select(*pair),
        line.select(*pair),
    )
