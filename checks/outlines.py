"""Ring functions, shape metrics and outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import POINTS, POLYGONS, query, r, with_
from gridloom.functions import geometry as G
from gridloom.operators import outlines as O
from gridloom.operators.tiling import label_polygons, square_tiles


@query(
    "g_area_centroid_box",
    with_(POLYGONS)
    + """SELECT cell_id, round(area, 6) + 0 AS area, round(sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)), 4) + 0 AS cx,
      round(sum((y1 + y2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)), 4) + 0 AS cy, bx0 AS x_min, by1 AS y_max
      FROM edges JOIN areas USING (cell_id) JOIN boxes USING (cell_id) GROUP BY cell_id, area, bx0, by1""",
)
def g_area_centroid_box(t):
    ring = F.col("ring")
    c, b = G.centroid(ring), G.envelope(ring)
    return t.polygons.select(
        "cell_id",
        r(G.area(ring)).alias("area"),
        r(c["x"], 4).alias("cx"),
        r(c["y"], 4).alias("cy"),
        b["x_min"].alias("x_min"),
        b["y_max"].alias("y_max"),
    )


@query("g_ring_vertices", with_(POLYGONS) + "SELECT cell_id, CAST(i AS INT) AS seq, x, y FROM verts")
def g_ring_vertices(t):
    return O.ring_vertices(t.polygons)


@query(
    "g_rings_from_vertices",
    with_(POLYGONS)
    + """SELECT cell_id, count(*) AS n, max(x) FILTER (i = 0) AS first_x, round(abs(sum(x1 * y2 - x2 * y1)) / 2, 6) + 0 AS area
      FROM verts JOIN edges USING (cell_id, i) GROUP BY 1""",
)
def g_rings_from_vertices(t):
    rows = O.ring_vertices(t.polygons)
    rings = O.rings_from_vertices(rows, ident="cell_id", x="x", y="y", order="seq")
    ring = F.col("ring")
    return rings.select(
        "cell_id", F.size(ring).cast("long").alias("n"), ring[0]["x"].alias("first_x"), r(G.area(ring)).alias("area")
    )


@query(
    "g_affine",
    with_(POLYGONS) + "SELECT cell_id, CAST(i AS INT) AS seq, round(x + 7.5, 6) + 0 AS x, round(0 - y + 100, 6) + 0 AS y FROM verts",
)
def g_affine(t):
    moved = t.polygons.withColumn("ring", G.translate_scale(F.col("ring"), 1.0, -1.0, 7.5, 100.0))
    return O.ring_vertices(moved).select("cell_id", "seq", r("x").alias("x"), r("y").alias("y"))


@query(
    "g_chaikin",
    with_(POLYGONS)
    + """SELECT cell_id, CAST(2 * i + k AS INT) AS seq, round(CASE k WHEN 0 THEN x1 * 0.75 + x2 * 0.25 ELSE x1 * 0.25 + x2 * 0.75 END, 6) + 0 AS x,
      round(CASE k WHEN 0 THEN y1 * 0.75 + y2 * 0.25 ELSE y1 * 0.25 + y2 * 0.75 END, 6) + 0 AS y FROM edges, range(2) a(k)""",
)
def g_chaikin(t):
    smooth = t.polygons.withColumn("ring", G.chaikin(F.col("ring"), 1))
    return O.ring_vertices(smooth).select("cell_id", "seq", r("x").alias("x"), r("y").alias("y"))


@query(
    "g_sort_ccw",
    with_(POLYGONS)
    + """, c AS (SELECT cell_id, (sum(x) + max(x) FILTER (i = 0)) / (count(*) + 1) AS mx, (sum(y) + max(y) FILTER (i = 0)) / (count(*) + 1) AS my
        FROM verts GROUP BY 1),
      closed AS (SELECT cell_id, i, x, y FROM verts UNION ALL SELECT cell_id, m, x, y FROM verts WHERE i = 0)
      SELECT cell_id, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY atan2(y - my, x - mx), i) - 1 AS INT) AS seq, x, y
      FROM closed JOIN c USING (cell_id)""",
)
def g_sort_ccw(t):
    turned = t.polygons.withColumn("ring", G.sort_ring_ccw(F.col("ring")))
    return O.ring_vertices(turned)


# By hand, for unit radius: the arrow's hull is a triangle of area 2 in a circle of radius
# 1.25; the hexagon has area 2.625 in a circle of squared radius 1.015625.
@query(
    "g_shape_metrics",
    with_(POLYGONS)
    + """SELECT cell_id, round(area, 6) + 0 AS area, CASE cell_id % 2 WHEN 0 THEN 1.0::DOUBLE ELSE round(2 / 1.5::DOUBLE, 6) END AS convexity,
      1.0::DOUBLE AS elongation, CASE cell_id % 2 WHEN 0 THEN round(2.625::DOUBLE / 1.015625, 6) ELSE round(1.5::DOUBLE / 1.5625, 6) END AS circularity
      FROM areas""",
)
def g_shape_metrics(t):
    m = O.shape_metrics(t.polygons)
    return m.select("cell_id", *[r(c).alias(c) for c in O.SHAPE_COLUMNS])


@query(
    "m_morphology_embedding",
    with_(POLYGONS)
    + """SELECT cell_id, CAST(dim AS INT) AS dim, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 4) + 0 AS value FROM (
      SELECT cell_id, unnest([0, 1, 2, 3]) AS dim, unnest([area, CASE cell_id % 2 WHEN 0 THEN 1.0::DOUBLE ELSE 2 / 1.5::DOUBLE END, 1.0::DOUBLE,
        CASE cell_id % 2 WHEN 0 THEN 2.625::DOUBLE / 1.015625 ELSE 1.5::DOUBLE / 1.5625 END]) AS value FROM areas)""",
)
def m_morphology_embedding(t):
    found = O.morphology_embedding(t.polygons).select("cell_id", F.posexplode("embedding").alias("dim", "value"))
    return found.withColumn("value", r("value", 4))


@query("g_valid_rings", with_(POLYGONS) + "SELECT cell_id, TRUE AS valid FROM placed")
def g_valid_rings(t):
    return t.polygons.select("cell_id", O.is_valid(F.col("ring")).alias("valid"))


@query(
    "g_repair_rings",
    with_(POLYGONS)
    + "SELECT cell_id, TRUE AS valid, CASE cell_id % 2 WHEN 0 THEN round(area, 4) ELSE -1 END AS area FROM areas",
)
def g_repair_rings(t):
    """Hexagons with two vertices swapped cross themselves; re-sorting restores them."""
    ring = F.col("ring")
    crossed = F.concat(F.slice(ring, 1, 1), F.slice(ring, 3, 1), F.slice(ring, 2, 1), F.slice(ring, F.lit(4), F.size(ring)))
    fixed = O.repair_polygons(t.polygons.withColumn("ring", crossed))
    area = F.when(F.pmod("cell_id", F.lit(2)) == 0, r(G.area(ring), 4)).otherwise(F.lit(-1.0))
    return fixed.select("cell_id", O.is_valid(ring).alias("valid"), area.alias("area"))


@query(
    "g_nested_rings",
    with_(POLYGONS) + "SELECT cell_id % 7 AS tile_id, count(DISTINCT cell_id) AS rings, count(*) AS vertices FROM verts GROUP BY 1",
)
def g_nested_rings(t):
    nested = O.nested_coordinates(t.polygons.withColumn("tile_id", F.pmod("cell_id", F.lit(7))), group="tile_id")
    return nested.select(
        "tile_id", F.size("coordinates").cast("long").alias("rings"), F.size(F.flatten("coordinates")).cast("long").alias("vertices")
    )


@query(
    "q_label_polygons",
    with_(POLYGONS)
    + """, ext AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM verts),
      nn AS (SELECT *, CAST(ceil((x1 - x0) / 300) AS BIGINT) AS nx, CAST(ceil((y1 - y0) / 300) AS BIGINT) AS ny FROM ext),
      tiles AS (SELECT i * ny + j AS tile_id, x0 + i * 300 AS tx0, y0 + j * 300 AS ty0, least(x0 + i * 300 + 300, x1) AS tx1,
        least(y0 + j * 300 + 300, y1) AS ty1 FROM nn, range(nx) a(i), range(ny) b(j)),
      bit(kind, piece, i, v) AS (VALUES (0, 0, 0, 0), (0, 0, 1, 1), (0, 0, 2, 2), (0, 0, 3, 3), (0, 0, 4, 4), (0, 0, 5, 5),
        (1, 0, 0, 0), (1, 0, 1, 1), (1, 0, 2, 3), (1, 1, 0, 1), (1, 1, 1, 2), (1, 1, 2, 3)),
      pv AS (SELECT cell_id, piece, b.i, x, y, count(*) OVER (PARTITION BY cell_id, piece) AS m FROM verts v JOIN bit b ON b.kind = cell_id % 2 AND b.v = v.i),
      axes AS (SELECT a.cell_id, a.piece, a.i, a.y - b.y AS nx, b.x - a.x AS ny FROM pv a JOIN pv b ON a.cell_id = b.cell_id AND a.piece = b.piece AND b.i = (a.i + 1) % a.m),
      corner AS (SELECT tile_id, unnest([tx0, tx1, tx1, tx0]) AS x, unnest([ty0, ty0, ty1, ty1]) AS y FROM tiles),
      sp AS (SELECT a.cell_id, a.piece, a.i, a.nx, a.ny, min(nx * x + ny * y) AS a0, max(nx * x + ny * y) AS a1 FROM axes a JOIN pv v USING (cell_id, piece) GROUP BY ALL),
      tp AS (SELECT cell_id, piece, tile_id, i, sp.a0, sp.a1, min(nx * x + ny * y) AS b0, max(nx * x + ny * y) AS b1 FROM sp, corner GROUP BY ALL),
      pb AS (SELECT cell_id, piece, min(x) AS bx0, max(x) AS bx1, min(y) AS by0, max(y) AS by1 FROM pv GROUP BY 1, 2),
      ok AS (SELECT cell_id, piece, tile_id FROM tp GROUP BY ALL HAVING bool_and(a0 <= b1 AND b0 <= a1))
      SELECT cell_id, CAST(min(tile_id) AS BIGINT) AS tile_id FROM ok JOIN pb USING (cell_id, piece) JOIN tiles USING (tile_id)
      WHERE bx0 <= tx1 AND tx0 <= bx1 AND by0 <= ty1 AND ty0 <= by1 GROUP BY 1""",
)
def q_label_polygons(t):
    tiles = square_tiles(O.ring_vertices(t.polygons), 300.0)
    return label_polygons(t.polygons, tiles).select("cell_id", "tile_id")


@query(
    "e_boundaries_hull",
    with_(POINTS)
    + """SELECT cell_id, count(*) AS n_transcripts, min(x) AS x_min, min(y) AS y_min, max(x) AS x_max, max(y) AS y_max
      FROM points WHERE cell_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT (x, y)) >= 3""",
)
def e_boundaries_hull(t):
    b = G.envelope(F.col("ring"))
    hulls = O.cell_boundaries(t.points, method="convex_hull")
    return hulls.select("cell_id", "n_transcripts", *[b[c].alias(c) for c in ("x_min", "y_min", "x_max", "y_max")])


@query(
    "e_boundaries_delaunay",
    with_(POINTS)
    + """SELECT cell_id, count(*) AS n_transcripts, TRUE AS inside_box, TRUE AS has_area
      FROM points WHERE cell_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT (x, y)) >= 3""",
)
def e_boundaries_delaunay(t):
    """Concave outlines, rounded once; each lies in the box of its points."""
    shapes = O.cell_boundaries(t.points, method="delaunay", smoothing=1)
    boxes = t.points.groupBy("cell_id").agg(
        F.min("x").alias("bx0"), F.min("y").alias("by0"), F.max("x").alias("bx1"), F.max("y").alias("by1")
    )
    b = G.envelope(F.col("ring"))
    inside = (
        (b["x_min"] >= F.col("bx0")) & (b["y_min"] >= F.col("by0")) & (b["x_max"] <= F.col("bx1")) & (b["y_max"] <= F.col("by1"))
    )
    return shapes.join(boxes, "cell_id").select(
        "cell_id", "n_transcripts", inside.alias("inside_box"), (G.area(F.col("ring")) > 0).alias("has_area")
    )


# A disc of squared radius 10 has row widths 2, 4, 6, 6, 6, 4, 2 between pixel centres: area 28.
@query(
    "g_raster_polygons",
    """SELECT 'c_1_' || (c_nationkey + 1) || '_' || (o_orderkey + 1) AS cell_id,
       round((o_orderkey + 1) * 8 + c_nationkey * 500 / 0.12028::DOUBLE, 3) + 0 AS x_min,
       round(1000 / 0.12028::DOUBLE, 3) + 0 AS y_max, 28::DOUBLE AS area
       FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 4 <> 0""",
)
def g_raster_polygons(t):
    """Orders as labelled discs of pixels, one field per nation of the customer."""
    key = F.col("o_orderkey")
    label = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        (F.col("c_nationkey") + 1).alias("fov"), (key + 1).cast("int").alias("label"), F.pmod(key, F.lit(4)).alias("kind")
    )
    pixels = (
        label.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(6))))
        .withColumn("dc", F.explode(F.sequence(F.lit(0), F.lit(6))))
        .where((F.col("row") - 3) * (F.col("row") - 3) + (F.col("dc") - 3) * (F.col("dc") - 3) <= 10)
        .select("fov", "row", (F.col("label") * 8 + F.col("dc")).alias("col"), "label", F.col("kind").cast("int").alias("comp"))
    )
    fields = t.nation.select(
        (F.col("n_nationkey") + 1).alias("FOV"), (F.col("n_nationkey") * 0.5).alias("X_mm"), F.lit(1.0).alias("Y_mm")
    )
    box = G.envelope(F.col("ring"))
    return O.raster_polygons(pixels, fields, "cell").select(
        "cell_id", r(box["x_min"], 3).alias("x_min"), r(box["y_max"], 3).alias("y_max"), r(G.area(F.col("ring")), 3).alias("area")
    )
