import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.operators import graph as GR
from gridloom.operators import tiling as TL
from gridloom.operators.knn import knn, knn_within
from gridloom.operators.spatial_join import points_in_polygons, polygons_in_polygons
from tests.conftest import rows

POLY = "cell_id long, ring array<struct<x:double,y:double>>"


def points_df(spark, xy):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "row_index long, x double, y double")


def polygon_df(spark, *rings):
    return spark.createDataFrame([(i, [(float(a), float(b)) for a, b in r]) for i, r in enumerate(rings)], POLY)


def brute_knn(xy, queries, k, limit=np.inf, closed=False):
    out = {}
    for q, (x, y) in enumerate(queries):
        d = (xy[:, 0] - x) ** 2 + (xy[:, 1] - y) ** 2
        ok = d <= limit**2 if closed else d < limit**2
        order = np.lexsort((np.arange(len(xy)), d))
        out[q] = [int(i) for i in order if ok[i]][:k]
    return out


def as_lists(edges):
    out = {}
    for r in edges.collect():
        out.setdefault(r["src"], []).append((r["rank"], r["dst"]))
    return {k: [d for _, d in sorted(v)] for k, v in out.items()}


SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4)]
ELL = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)]
PROBES = [(2, 2), (5, 2), (0, 2), (4, 2), (2, 0), (2, 4), (0, 0), (4, 4), (4, 0), (0, 4), (0.5, 3), (3, 3)]


@pytest.mark.parametrize("ring", [SQUARE, SQUARE[::-1], [*SQUARE, SQUARE[0]], SQUARE[2:] + SQUARE[:2]])
def test_square_predicates(spark, ring):
    pts, poly = points_df(spark, PROBES), polygon_df(spark, ring)
    inside = {r[0] for r in rows(points_in_polygons(pts, poly, "contains"))}
    touching = {r[0] for r in rows(points_in_polygons(pts, poly, "intersects"))}
    assert inside == {0, 10, 11}
    assert touching == {0, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11}


def test_concave_and_column_expressions_agree(spark):
    pts, poly = points_df(spark, PROBES), polygon_df(spark, ELL)
    got = {r[0] for r in rows(points_in_polygons(pts, poly, "contains"))}
    assert got == {10}
    e = G.edges(F.col("ring"))
    crossed = pts.crossJoin(poly).where(G.contains_point(e, F.col("x"), F.col("y")))
    assert {r["row_index"] for r in crossed.collect()} == got


def test_buffer_reaches_outside(spark):
    pts, poly = points_df(spark, [(5, 2), (5.5, 2), (4.9, 4.9), (4.6, 4.6)]), polygon_df(spark, SQUARE)
    got = {r[0] for r in rows(points_in_polygons(pts, poly, "contains", buffer=F.lit(1.0)))}
    assert got == {3}
    assert {r[0] for r in rows(points_in_polygons(pts, poly, "intersects", buffer=F.lit(1.0)))} == {0, 3}


def test_bad_predicate(spark):
    with pytest.raises(TypeError):
        points_in_polygons(points_df(spark, [(0, 0)]), polygon_df(spark, SQUARE), "touches")


def test_hot_cell_is_split_without_changing_pairs(spark):
    rng = np.random.default_rng(1)
    xy = np.vstack([rng.random((300, 2)) * 100, np.full((400, 2), 7.25)])
    rings = [[(x, y), (x + s, y), (x + s, y + s), (x, y + s)] for x, y, s in rng.random((40, 3)) * [90, 90, 30]]
    rings.append([(-500, -500), (900, -500), (900, 900), (-500, 900)])
    pts, poly = points_df(spark, xy), polygon_df(spark, *rings)
    plain = rows(points_in_polygons(pts, poly, "contains"))
    # The same rows when the boxes are not broadcast and the exchanges are Spark's own.
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plain == rows(points_in_polygons(pts, poly, "contains"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    want = sorted(
        (i, j)
        for i, (x, y) in enumerate(xy)
        for j, r in enumerate(rings)
        if r[0][0] < x < r[2][0] and r[0][1] < y < r[2][1]
    )
    assert sorted(plain) == want


def test_polygon_pairs_of_very_different_sizes(spark):
    big = [(0, 0), (1000, 0), (1000, 1000), (0, 1000)]
    small = [(10, 10), (11, 10), (11, 11), (10, 11)]
    edge = [(999, 5), (1001, 5), (1001, 6), (999, 6)]
    far = [(2000, 0), (2001, 0), (2001, 1), (2000, 1)]
    q, i = polygon_df(spark, big, small, edge, far), polygon_df(spark, big, small)
    assert rows(polygons_in_polygons(q, i, "intersects")) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]
    assert rows(polygons_in_polygons(q, i, "contains")) == [(0, 0), (1, 0), (1, 1)]


def test_polygon_pairs_of_a_crowded_place_are_formed_in_blocks(spark):
    sides = np.concatenate([np.arange(1, 401), [400, 399]])
    rings = [[(-s, -s), (s, -s), (s, s), (-s, s)] for s in sides]
    rings.append([(-500, -500), (500, -500), (500, 500), (0, -499), (-500, 500)])
    polygons = polygon_df(spark, *rings)
    pairs = {p: polygons_in_polygons(polygons, polygons, p) for p in ("contains", "intersects")}
    inside = {(a, b) for a in range(402) for b in range(402) if sides[a] <= sides[b]} | {(402, 402)}
    assert sorted(tuple(r) for r in pairs["contains"].collect()) == sorted(inside)
    # The last ring's notch holds the squares whose sides stay under (499 - s) / 2.
    met = 402 * 402 + 1 + 2 * int((2 * sides > 499 - sides).sum())
    assert pairs["intersects"].count() == met == pairs["intersects"].distinct().count()
    # No ring rides on a pair: rings meet as lists, and pairs come out of an array operation.
    assert all("MapInArrow" in p._jdf.queryExecution().executedPlan().toString() for p in pairs.values())


@pytest.mark.parametrize("window", [4096, 8])
@pytest.mark.parametrize("closed", [False, True])
def test_knn_radius_matches_brute_force(spark, window, closed):
    rng = np.random.default_rng(2)
    xy = np.vstack([rng.random((150, 2)) * 20, np.full((40, 2), 3.0), rng.random((60, 2)) * 0.01 + 10, [[100.0, 100.0], [105.0, 100.0]]])
    pts = points_df(spark, xy)
    got = as_lists(knn_within(pts, 4, 5.0, closed=closed, max_window=window))
    assert got == brute_knn(xy, xy, 4, 5.0, closed)
    assert got[len(xy) - 2] == ([len(xy) - 2, len(xy) - 1] if closed else [len(xy) - 2])


@pytest.mark.parametrize("window", [4096, 6])
def test_knn_unbounded_matches_brute_force(spark, window):
    rng = np.random.default_rng(3)
    xy = np.vstack([rng.random((120, 2)) * 50 - 25, np.full((30, 2), -3.5)])
    centres = rng.random((15, 2)) * 200 - 100
    queries = points_df(spark, centres).withColumnRenamed("row_index", "cell_id")
    assert as_lists(knn(points_df(spark, xy), queries, 3, max_window=window)) == brute_knn(xy, centres, 3)


def test_knn_with_fewer_points_than_k(spark):
    xy = np.array([[0.0, 0.0], [1.0, 0.0]])
    queries = points_df(spark, [(5, 5)]).withColumnRenamed("row_index", "cell_id")
    assert as_lists(knn(points_df(spark, xy), queries, 9)) == {0: [1, 0]}


def test_tile_edges_and_outside(spark):
    pts = points_df(spark, [(0, 0), (10, 5), (20, 20), (10, 10), (25, 25)])
    tiles = TL.square_tiles(points_df(spark, [(0, 0), (20, 20)]), 10.0)
    labels = dict(rows(TL.label_points(pts, tiles), "row_index", "tile_id"))
    assert labels == {0: 0, 1: 0, 2: 3, 3: 0, 4: -1}
    core = TL.tile_predict_nodes(pts, tiles, 2.0).where("is_core")
    per_point = {r["row_index"]: r["n"] for r in core.groupBy("row_index").agg(F.count("*").alias("n")).collect()}
    assert per_point == {0: 1, 1: 2, 2: 1, 3: 4}


def test_margin_is_halved_until_tiles_survive(spark):
    tiles = TL.square_tiles(points_df(spark, [(0, 0), (13, 10)]), 10.0)
    assert TL.effective_margin(tiles, 4.0) == 1.0
    with pytest.raises(ValueError):
        TL.effective_margin(tiles, -1.0)


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_quadtree_partitions_points(spark, size):
    rng = np.random.default_rng(4)
    xy = np.vstack([rng.normal(size=(300, 2)) * 40, np.full((20, 2), 1.0)])
    pts = points_df(spark, xy)
    shape = TL.quadtree_shape(pts)
    leaves = TL.quadtree_leaves(pts, size, shape)
    assert TL.tree_is_valid(leaves, len(xy))
    labelled = TL.quadtree_label(pts, leaves, shape)
    assert labelled.count() == len(xy)
    counted = labelled.groupBy("tile_id").count().join(leaves, "tile_id")
    assert counted.where("count <> n").count() == 0
    inside = labelled.join(leaves, "tile_id").where("x >= x_min AND x <= x_max AND y >= y_min AND y <= y_max")
    assert inside.count() == len(xy)


def test_square_tiles_reject_bad_input(spark):
    with pytest.raises(ValueError):
        TL.square_tiles(points_df(spark, [(0, 0)]), 0.0)
    with pytest.raises(ValueError):
        TL.square_tiles(spark.createDataFrame([], "x double, y double"), 1.0)


def test_partition_helpers(spark):
    nodes = spark.createDataFrame([(0,), (1,), (2,)], "id long")
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "id long, tile_id long")
    GR.check_partition(nodes, labels)
    assert GR.check_same_partitions({"a": labels, "b": labels}) == 2
    with pytest.raises(ValueError):
        GR.check_partition(nodes, labels.limit(2))
    with pytest.raises(ValueError):
        GR.check_same_partitions({"a": labels, "b": labels.where("tile_id = 0")})
    with pytest.raises(IndexError):
        GR.fetch_partition(labels, 2, 2)
    assert GR.fetch_partition(labels, -1, 2).count() == 1
    values = spark.createDataFrame([(0, 5)], "id long, v long")
    assert rows(GR.add_node_attribute(labels, values), "id", "v") == [(0, 5), (1, None), (2, None)]


def test_negative_edges_avoid_positives(spark):
    edges = spark.createDataFrame([(i, i % 5) for i in range(50)], "src long, dst long")
    drawn = GR.negative_edges(edges, 2.5)
    assert drawn.join(edges, ["src", "dst"]).count() == 0
    assert 60 < drawn.count() <= 150
    assert rows(drawn) == rows(GR.negative_edges(edges, 2.5))
    assert drawn.agg(F.max("dst")).first()[0] < 5


def test_negative_edges_take_tasks_by_their_rows(spark, monkeypatch):
    from gridloom.operators import skew

    edges = spark.createDataFrame([(i, i % 5) for i in range(50)] + [(None, 3)], "src long, dst long")
    plain = rows(GR.negative_edges(edges, 2.5))
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 10)
    drawn = GR.negative_edges(edges, 2.5)
    assert rows(drawn) == plain
    assert drawn.rdd.getNumPartitions() == 18
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_local_edges_label_the_points_once(spark):
    from checks import REGISTRY

    found = REGISTRY["p_local_edges"].run(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    # The labels' levels are exploded where they are made, not again at each end of the edges.
    assert "Generate" not in plan


def random_rings(rng, n):
    out = []
    for i in range(n):
        m = int(rng.integers(3, 40))
        angle = np.sort(rng.random(m)) * 2 * np.pi
        radius = rng.uniform(0.2, 1, m) * 10 ** rng.uniform(-1, 2)
        cx, cy = rng.uniform(-50, 50, 2)
        ring = np.stack([cx + radius * np.cos(angle), cy + radius * np.sin(angle)], 1)
        out.append(np.round(ring * 4) / 4 if i % 3 == 0 else ring)
    return out


@pytest.mark.parametrize("predicate", ["contains", "intersects"])
@pytest.mark.parametrize("grown", [False, True])
def test_clipped_cells_give_what_whole_rings_give(spark, predicate, grown):
    from gridloom.functions.planar import points_against_rings

    rng = np.random.default_rng(12)
    rings = random_rings(rng, 60)
    xy = np.concatenate([rng.uniform(-80, 80, (1500, 2)), np.concatenate([r[:4] for r in rings]), np.concatenate([(r[:3] + r[1:4][: len(r[:3])]) / 2 for r in rings if len(r) > 3])])
    reach = np.where(np.arange(60) % 4 == 0, 0.0, rng.uniform(0, 5, 60)) if grown else np.zeros(60)
    schema = POLY + ", grow double"
    polygons = spark.createDataFrame([(i, [tuple(map(float, p)) for p in r], float(b)) for i, (r, b) in enumerate(zip(rings, reach))], schema)
    pairs = points_in_polygons(points_df(spark, xy), polygons, predicate, buffer=F.col("grow") if grown else None)
    want = set()
    for j, (ring, b) in enumerate(zip(rings, reach)):
        n = len(xy)
        odd, rim, gap = points_against_rings(xy[:, 0], xy[:, 1], np.zeros(n, int), np.full(n, len(ring)), ring[:, 0], ring[:, 1], True)
        hit = odd & ~rim if predicate == "contains" else odd | rim
        if b > 0:
            hit |= gap < b if predicate == "contains" else gap <= b
        want |= {(int(i), j) for i in np.flatnonzero(hit)}
    assert {tuple(r) for r in pairs.collect()} == want and pairs.count() == len(want)


def test_crowded_cells_are_counted_and_listed_in_blocks(spark):
    from gridloom.operators.spatial_join import assign_points_to_polygons, count_points_in_polygons

    rng = np.random.default_rng(6)
    xy = np.concatenate([rng.uniform(-3, 9, (6000, 2)), [[100.0, 100.0], [0.0, 0.0]]])
    rings = [[(c, c), (c + s, c), (c + s, c + s), (c, c + s)] for c, s in zip(rng.integers(-2, 3, 40), rng.integers(1, 7, 40))]
    kind = [None if i % 7 == 0 else f"g{i % 5}" for i in range(len(xy))]
    pts = spark.createDataFrame([(i, float(a), float(b), k) for i, ((a, b), k) in enumerate(zip(xy, kind))], "row_index long, x double, y double, kind string")
    want = [(i, j) for i, (a, b) in enumerate(xy) for j, r in enumerate(rings) if r[0][0] < a < r[2][0] and r[0][1] < b < r[2][1]]
    counts = {}
    for i, j in want:
        counts[j, kind[i]] = counts.get((j, kind[i]), 0) + 1
    polygons = polygon_df(spark, *rings)
    found = count_points_in_polygons(pts, polygons, "kind")
    assert {(r[0], r[1]): r[2] for r in found.collect()} == counts
    placed = [tuple(r) for r in assign_points_to_polygons(pts.select("row_index", "x", "y"), polygons).select("row_index", "boundaries_id").collect()]
    closed = [(i, j) for i, (a, b) in enumerate(xy) for j, r in enumerate(rings) if r[0][0] <= a <= r[2][0] and r[0][1] <= b <= r[2][1]]
    free = set(range(len(xy))) - {i for i, _ in closed}
    assert sorted(placed, key=str) == sorted([*closed, *((i, None) for i in free)], key=str)


def test_inside_cells_carry_no_edges(spark):
    from gridloom.operators.clipped import clip

    ring = [(float(np.cos(a) * 100), float(np.sin(a) * 100)) for a in np.linspace(0, 2 * np.pi, 200, endpoint=False)]
    one = spark.createDataFrame([(1, 0.0, [x for x, _ in ring], [y for _, y in ring], -100.0, -100.0, 100.0, 100.0)],
                                "index_match long, _buffer double, _xs array<double>, _ys array<double>, a double, b double, c double, d double")
    cells = clip(one, ("a", "b", "c", "d")).collect()
    free = [c for c in cells if c["_x1"] is None]
    assert free and all(c["_odd"] for c in free)
    assert max(len(c["_x1"]) for c in cells if c["_x1"] is not None) < 80


@pytest.mark.parametrize("tile", [8, 64])
@pytest.mark.parametrize("radius", [None, 1.5, 40.0])
def test_tiles_and_second_search_match_brute_force(spark, tile, radius):
    rng = np.random.default_rng(4)
    xy = np.concatenate([rng.normal(0, 0.05, (300, 2)), rng.normal((7, 3), 2, (200, 2)), rng.uniform(-90, 90, (60, 2)), np.tile([[3.0, 3.0]], (30, 1)), [[400.0, -400.0]]])
    asked = np.concatenate([xy[::7], rng.uniform(-100, 100, (40, 2)), [[3.0, 3.0]] * 3, [[-1000.0, 2.0]]])
    pts = points_df(spark, xy).repartition(3)
    queries = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(asked)] + [(9999, None, 1.0)], "cell_id long, x double, y double")
    if radius is None:
        got = as_lists(knn(pts, queries, 4, tile=tile))
    else:
        got = as_lists(knn_within(pts, 4, radius, queries=queries, query_ident="cell_id", tile=tile))
    want = {k: v for k, v in brute_knn(xy, asked, 4, np.inf if radius is None else radius).items() if v}
    assert got == want


def test_row_index_beyond_64_bits_is_no_error(spark):
    from checks.base import row_index

    lines = [(0, 1, 5, 7), (11_529_214, 7, 0, 0), (11_529_215, 0, 36_854, 7_775_807), (54_000_000, 7, 7_199_999, 359_999), (40_000_000, 2, 1, 1)]
    df = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").select(row_index())
    exact = [((o * 8 + n) * 1000000 + p) * 100000 + s for o, n, p, s in lines]
    assert [r[0] for r in df.collect()] == [(v + 2**63) % 2**64 - 2**63 for v in exact]


def test_left_join_keeps_every_point_and_no_place_that_is_no_number(spark):
    from gridloom.operators.spatial_join import assign_points_to_polygons

    shape = "row_index long, x double, y double, tag string, sizes array<int>"
    pts = spark.createDataFrame(
        [(0, 2.0, 2.0, "in", [1]), (1, 9.0, 9.0, "out", None), (2, None, 1.0, "no x", [2]), (None, 2.0, 2.0, "no id", []), (4, 0.0, 0.0, None, [3, 4]), (5, float("nan"), 1.0, "nan", [5])], shape
    )
    poly = polygon_df(spark, SQUARE, ELL)
    got = assign_points_to_polygons(pts, poly)
    assert got.columns == [*pts.columns, "boundaries_id"]
    want = [(0, "in", 0), (1, "out", None), (2, "no x", None), (None, "no id", None), (4, None, 0), (4, None, 1), (5, "nan", None)]
    assert rows(got, "row_index", "tag", "boundaries_id") == sorted(want, key=repr)
    assert {(r["row_index"], tuple(r["sizes"] or ())) for r in got.collect()} == {(0, (1,)), (1, ()), (2, (2,)), (None, ()), (4, (3, 4)), (5, (5,))}
