import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.functions import planar as P
from gridloom.operators import outlines as O
from tests.conftest import rows

grid_points = st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=40, unique=True)


@settings(max_examples=60, deadline=None)
@given(grid_points)
def test_triangulation_covers_hull_and_is_delaunay(raw):
    pts = np.array(raw, dtype=float)
    tris, hull = P.delaunay(pts), P.convex_hull(pts)
    if len(hull) < 3:
        assert len(tris) == 0
        return
    assert sum(P.ring_area(pts[t]) for t in tris) == pytest.approx(P.ring_area(hull))
    for t in tris:
        a, b, c = (tuple(pts[i]) for i in t)
        assert all(P._in_circle(a, b, c, tuple(p)) <= 0 for i, p in enumerate(pts) if i not in t)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(64, 400))
def test_hull_contains_all_points(seed, n):
    pts = np.random.default_rng(seed).normal(size=(n, 2)).round(2)
    hull = P.convex_hull(pts)
    for a, b in zip(hull, np.roll(hull, -1, axis=0)):
        assert ((b[0] - a[0]) * (pts[:, 1] - a[1]) - (b[1] - a[1]) * (pts[:, 0] - a[0]) >= -1e-9).all()
    assert P.ring_area(hull) > 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000))
def test_enclosing_circle_and_rectangle(seed):
    pts = np.random.default_rng(seed).normal(size=(30, 2))
    hull = P.convex_hull(pts)
    radius = P.min_circle_radius(hull)
    widest = max(np.linalg.norm(a - b) for a in hull for b in hull)
    assert widest / 2 - 1e-9 <= radius <= widest / math.sqrt(3) + 1e-9
    span = np.ptp(pts, axis=0)
    assert P.ring_area(hull) - 1e-9 <= P.min_rectangle_area(hull) <= span[0] * span[1] + 1e-9


def test_shape_metrics_of_known_shapes():
    square = np.array([[0, 0], [2, 0], [2, 2], [0, 2]], dtype=float)
    assert P.shape_metrics(square) == pytest.approx((4.0, 1.0, 1.0, 2.0))
    turned = np.array([[1, 0], [0, 1], [-1, 0], [0, -1]], dtype=float)
    assert P.shape_metrics(turned) == pytest.approx((2.0, 1.0, 0.5, 2.0))
    n = 400
    a = np.linspace(0, 2 * np.pi, n, endpoint=False)
    circle = P.shape_metrics(np.stack([np.cos(a), np.sin(a)], axis=1))
    assert circle[3] == pytest.approx(math.pi, abs=1e-3)


@pytest.mark.parametrize("method", ["delaunay", "convex_hull"])
def test_degenerate_outlines(method):
    for pts in ([(0, 0)], [(0, 0), (1, 1)], [(0, 0), (1, 1), (2, 2)]):
        assert P.cell_outline(np.array(pts, dtype=float), method) is None
    tri = P.cell_outline(np.array([(0, 0), (1, 0), (0, 1)], dtype=float), method)
    assert abs(P.ring_area(tri)) == pytest.approx(0.5)
    with pytest.raises(ValueError):
        P.cell_outline(np.zeros((3, 2)), "alpha")


def test_outline_is_concave_and_connectivity_tightens():
    rng = np.random.default_rng(0)
    pts = rng.random((600, 2)) * 10
    pts = pts[(pts[:, 0] < 3) | (pts[:, 1] < 3)]
    hull = P.ring_area(P.convex_hull(pts))
    loose = P.ring_area(P.cell_outline(pts, connectivity=2.0))
    tight = P.ring_area(P.cell_outline(pts, connectivity=0.5))
    assert tight < loose <= hull
    assert P.is_valid(P.cell_outline(pts, connectivity=2.0))


def test_two_far_clusters_keep_the_larger_part():
    rng = np.random.default_rng(1)
    pts = np.vstack([rng.random((80, 2)), rng.random((20, 2)) * 0.5 + 100])
    area = P.ring_area(P.cell_outline(pts))
    assert area < 5.0


def test_repeated_points_shorten_the_scale():
    pts = np.array([(0, 0), (1, 0), (0, 1), (1, 1), (9, 9)], dtype=float)
    plain = P.nearest_distance_max(pts, P.delaunay(pts))
    doubled = P.nearest_distance_max(pts, P.delaunay(pts), np.array([False, False, False, False, True]))
    assert plain == pytest.approx(math.hypot(8, 8)) and doubled == 1.0


def test_validity_and_repair():
    bow = np.array([[0, 0], [4, 4], [4, 0], [0, 4]], dtype=float)
    assert not P.is_valid(bow)
    assert abs(P.ring_area(P.repair(bow))) == pytest.approx(16.0)
    assert P.is_valid(np.array([[0, 0], [4, 0], [4, 4], [0, 4]], dtype=float))
    assert not P.is_valid(np.array([[0, 0], [4, 0], [2, 0], [2, 3]], dtype=float))
    assert abs(P.ring_area(P.largest_loop(np.array([[0, 0], [2, 2], [2, 0], [0, 2.0]])))) == pytest.approx(1.0)


def test_simplify_keeps_shape():
    ring = np.array([[0, 0], [1, 0.01], [2, 0], [2, 2], [0, 2]], dtype=float)
    assert len(P.simplify(ring, 0.1)) == 4
    assert len(P.simplify(ring, 0.001)) == 5


def test_contour_of_a_block_with_a_hole():
    mask = np.ones((5, 6), dtype=bool)
    mask[2, 2] = False
    r, c = np.nonzero(mask)
    ring = P.label_contour(r + 10, c + 20)
    assert sorted(map(tuple, ring)) == [(20.0, 10.0), (20.0, 14.0), (25.0, 10.0), (25.0, 14.0)]
    assert P.label_contour(np.array([1]), np.array([1])) is None
    assert P.label_contour(np.array([1, 1]), np.array([1, 2])) is None


def test_parity_helper_against_expressions(spark):
    rng = np.random.default_rng(5)
    ring = np.array([(0, 0), (6, 0), (6, 6), (3, 2), (0, 6)], dtype=float)
    probe = rng.integers(-1, 8, (80, 2)).astype(float)
    n = len(probe)
    odd, rim, gap = P.points_against_rings(
        probe[:, 0], probe[:, 1], np.zeros(n, dtype=int), np.full(n, len(ring)), ring[:, 0], ring[:, 1], True
    )
    df = spark.createDataFrame(
        [(i, float(a), float(b), [tuple(map(float, v)) for v in ring]) for i, (a, b) in enumerate(probe)],
        "i long, x double, y double, ring array<struct<x:double,y:double>>",
    )
    e = G.edges(F.col("ring"))
    out = df.select(
        "i",
        G.contains_point(e, F.col("x"), F.col("y")),
        G.intersects_point(e, F.col("x"), F.col("y")),
        F.round(G.distance_to_ring(e, F.col("x"), F.col("y")), 9),
    )
    for i, strict, loose, d in out.collect():
        assert strict == bool(odd[i] and not rim[i])
        assert loose == bool(odd[i] or rim[i])
        assert d == pytest.approx(gap[i], abs=1e-8)


def test_cell_boundaries(spark):
    rng = np.random.default_rng(6)
    data = [("a", float(x), float(y)) for x, y in rng.random((200, 2))]
    data += [("b", 0.0, 0.0), ("b", 1.0, 1.0), ("b", 1.0, 1.0), (None, 5.0, 5.0)]
    df = spark.createDataFrame(data, "cell_id string, x double, y double")
    for method in ("convex_hull", "delaunay"):
        out = O.cell_boundaries(df, method=method, smoothing=1).collect()
        assert [(r["cell_id"], r["n_transcripts"]) for r in out] == [("a", 200)]


def test_hull_in_parts_equals_hull(spark, monkeypatch):
    monkeypatch.setattr(O, "HULL_PART", 16)
    xy = np.random.default_rng(7).normal(size=(300, 2))
    df = spark.createDataFrame([("a", float(x), float(y)) for x, y in xy], "cell_id string, x double, y double")
    ring = O.cell_boundaries(df, method="convex_hull").first()["ring"]
    want = P.convex_hull(xy)
    assert sorted((p["x"], p["y"]) for p in ring) == sorted(map(tuple, want))


def test_too_many_points_is_an_error_not_a_cut(spark):
    xy = np.random.default_rng(8).normal(size=(30, 2))
    df = spark.createDataFrame([("a", float(x), float(y)) for x, y in xy], "cell_id string, x double, y double")
    with pytest.raises(Exception, match="too many distinct points"):
        O.cell_boundaries(df, method="delaunay", max_points=20).collect()


def test_raster_polygons(spark):
    px = [(1, r, c, 7, 1 if 2 <= r <= 4 and 2 <= c <= 4 else 3) for r in range(7) for c in range(9)]
    pixels = spark.createDataFrame(px, "fov int, row int, col int, label int, comp int")
    fields = spark.createDataFrame([(1, 0.0, 0.0)], "FOV int, X_mm double, Y_mm double")
    cell = O.raster_polygons(pixels, fields, "cell").first()
    assert cell["cell_id"] == "c_1_1_7"
    assert sorted((p["x"], p["y"]) for p in cell["ring"]) == [(0.0, -6.0), (0.0, 0.0), (8.0, -6.0), (8.0, 0.0)]
    nucleus = O.raster_polygons(pixels, fields, "nucleus").first()
    assert len(nucleus["ring"]) == 4
    with pytest.raises(ValueError):
        O.raster_polygons(pixels, fields, "membrane")


def test_labels_are_traced_once_and_in_batches(spark, monkeypatch):
    from gridloom.operators import contours as C

    rng = np.random.default_rng(3)
    px, want = [], {}
    for label in range(1, 120):
        h, w = rng.integers(1, 9), rng.integers(1, 9) * (20 if label % 10 == 0 else 1)
        mask = rng.random((h, w)) < rng.choice([0.4, 0.8, 1.0])
        mask[0, 0] = True
        r, c = np.nonzero(mask)
        full = np.pad(mask, 1)
        rim = ~(full[1:-1, :-2] & full[1:-1, 2:] & full[:-2, 1:-1] & full[2:, 1:-1])[r, c]
        fov, r, c = label % 3, r + 5, c + label * 7 - 100
        px += [(fov, int(a), int(b), label, 2) for a, b in zip(r, c)]
        ring = P.label_contour(r[rim], c[rim])
        if ring is not None:
            want[fov, label] = ring
    tolerance = {f: np.mean([np.sqrt(abs(P.ring_area(v))) for (g, _), v in want.items() if g == f]) / O.SIMPLIFY_DIVISOR for f in range(3)}
    pixels = spark.createDataFrame([*px, *px[:50]], "fov int, row int, col int, label int, comp int").repartition(4)
    fields = spark.createDataFrame([(f, 0.0, 0.0) for f in range(3)], "FOV int, X_mm double, Y_mm double")
    found = O.raster_polygons(pixels, fields, "cell")
    got = {r["cell_id"]: [(p["x"], p["y"]) for p in r["ring"]] for r in found.collect()}
    assert got == {f"c_1_{f}_{i}": [(x, -y) for x, y in P.simplify(v, tolerance[f])] for (f, i), v in want.items()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "ArrowEvalPython" not in plan

    words = {}
    for fov, r, c, label, _ in px:
        words[fov, label, r, c >> 6] = words.get((fov, label, r, c >> 6), 0) | 1 << (c & 63)
    table = pa.table([*zip(*sorted(words))], names=["fov", "label", "row", "word"])
    table = table.append_column("bits", pa.array(np.array([words[k] for k in sorted(words)], np.uint64).view(np.int64)))
    whole = pa.Table.from_batches(O._trace(iter(table.combine_chunks().to_batches()))).to_pylist()
    assert {(r["fov"], r["label"]) for r in whole} == set(want)
    monkeypatch.setattr(O, "WORDS_AT_ONCE", 16)
    monkeypatch.setattr(C, "CELLS_AT_ONCE", 64)
    assert pa.Table.from_batches(O._trace(iter(table.to_batches(max_chunksize=5)))).to_pylist() == whole


def test_boundary_keys(spark):
    ring = "array(struct(0D AS x, 0D AS y)) AS ring"
    cells = spark.sql(f"SELECT stack(2, 'a', 'b') AS cell_id").selectExpr("cell_id", ring)
    nuclei = spark.sql("SELECT 'a' AS cell_id").selectExpr("cell_id", ring)
    got = rows(O.boundary_union(cells, nuclei), "key", "contains_nucleus")
    assert got == [("a_0", True), ("a_1", True), ("b_1", False)]
