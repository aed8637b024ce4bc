import json

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.cli import build_parser
from gridloom.config import ExportConfig, SegmentConfig
from gridloom.operators.embedding import cell_embedding, gene_embedding
from gridloom.operators.numbering import file_order_index, parquet_row_index, position_in_group, prefix_offsets
from gridloom.plans.export import export, load_assigned
from gridloom.plans.segment import segment, segment_only
from gridloom.sources import tables
from gridloom.sources.vendors import infer_platform, open_source
from tests.conftest import rows

SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]


def write(spark, data, schema, path):
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(path))


def xenium(spark, root, version="xenium-3.3.1.1", none="UNASSIGNED", grid=1, per_cell=0):
    root.mkdir()
    (root / "experiment.xenium").write_text(json.dumps({"analysis_sw_version": version}))
    tx = [
        (1.0, 1.0, "GeneA", "c0", 1, 20.0),
        (2.0, 2.0, "GeneA", none, 1, 30.0),
        (3.0, 3.0, "GeneB", "c0", 0, 19.99),
        (3.0, 1.0, "GeneB", "c0", 0, 20.01),
        (9.0, 9.0, "GeneB", none, 0, 40.0),
        (1.0, 2.0, "BLANK_1", "c0", 1, 40.0),
        (1.0, 2.0, "NegControlCodewor", "c0", 1, 40.0),
        (1.0, 2.0, None, "c0", 1, 40.0),
    ]
    rng = np.random.default_rng(0)
    for k in range(per_cell):
        for g in range(grid * grid):
            x, y = rng.random(2) * 4
            gene = f"Gene{'ABCD'[int(rng.integers(0, 4)) if rng.random() < 0.3 else g % 4]}"
            tx.append((float(x + 6 * (g % grid)), float(y + 6 * (g // grid)), gene, f"c{g}", int(1 < x < 3 and 1 < y < 3), 40.0))
    write(spark, tx, "x_location double, y_location double, feature_name string, cell_id string, overlaps_nucleus int, qv double", root / "transcripts.parquet")
    for name, lo, hi in (("cell", 0.0, 4.0), ("nucleus", 1.0, 3.0)):
        ring = [(lo, lo), (hi, lo), (hi, hi), (lo, hi), (lo, lo)]
        v = [(f"c{g}", x + 6 * (g % grid), y + 6 * (g // grid)) for g in range(grid * grid) for x, y in ring]
        if name == "cell":
            v += [("lone", 100 + x, 100 + y) for x, y in [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0)]]
        write(spark, v, "cell_id string, vertex_x double, vertex_y double", root / f"{name}_boundaries.parquet")
    return root


def test_xenium_points_and_polygons(spark, tmp_path):
    src = open_source(spark, xenium(spark, tmp_path / "x"))
    assert rows(src.points, "row_index", "cell_id", "cell_compartment") == [
        (0, "c0", 2),
        (1, None, 2),
        (3, "c0", 1),
        (4, None, 0),
    ]
    got = rows(src.polygons, "key", "contains_nucleus", "boundary_type")
    assert got == [("c0_0", True, "nucleus"), ("c0_1", True, "cell"), ("lone_1", False, "cell")]


def test_version_gate_and_inference(spark, tmp_path):
    old = xenium(spark, tmp_path / "old", "Xenium-1.7.0.2", "-1")
    assert infer_platform(old) == "10x_xenium_v1"
    assert rows(open_source(spark, old).points, "cell_id", "cell_compartment")[-1][1] in (0, 2)
    with pytest.raises(OSError, match="2.0.0"):
        open_source(spark, old, "10x_xenium")
    with pytest.raises(NotImplementedError):
        open_source(spark, old, "vizgen_merscope")
    with pytest.raises(ValueError, match="no reader"):
        open_source(spark, old, "other")
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="no platform fits"):
        infer_platform(tmp_path / "empty")


def cosmx(spark, root):
    root.mkdir()
    (root / "s_tx_file.csv").write_text(
        "fov,x_global_px,y_global_px,target,cell,CellComp\n"
        "1,1.5,2,GeneA,c_1_1_7,Nuclear\n1,2,3,Negative1,c_1_1_7,Nuclear\n1,2,3,GeneB,c_1_1_7,Membrane\n"
        "1,2,3,GeneB,c_1_1_7,Cytoplasm\n1,2,3,GeneC,c_1_1_0,None\n1,2,3,GeneC,c_1_1_0,\n"
    )
    (root / "s_fov_positions_file.csv").write_text("FOV,X_mm,Y_mm\n1,0.0,0.0\n")
    px = [(r, c, 7) for r in range(6) for c in range(6)]
    for kind, value in (("CellLabels", lambda r, c: 7), ("CompartmentLabels", lambda r, c: 1 if 1 < r < 5 and 1 < c < 5 else 3)):
        write(spark, [(r, c, value(r, c)) for r, c, _ in px], "row int, col int, value int", root / kind / f"{kind}_F001.parquet")
    return root


def test_cosmx(spark, tmp_path):
    root = cosmx(spark, tmp_path / "c")
    src = open_source(spark, root)
    assert rows(src.points, "row_index", "cell_id", "cell_compartment") == [
        (0, "c_1_1_7", 2),
        (2, "c_1_1_7", 1),
        (3, "c_1_1_7", 1),
        (4, None, 0),
        (5, None, 0),
    ]
    assert rows(src.polygons, "key", "contains_nucleus") == [("c_1_1_7_0", True), ("c_1_1_7_1", True)]
    (root / "s_tx_file.csv").write_text("x_global_px,y_global_px,target,cell,CellComp\n1,2,GeneA,c,Vacuole\n")
    with pytest.raises(Exception, match="unmapped"):
        open_source(spark, root).points.collect()
    (root / "s_fov_positions_file.csv").write_text("FOV,X_mm,Y_mm\n1,0,0\n2,1,1\n")
    with pytest.raises(FileNotFoundError, match="F002"):
        open_source(spark, root).polygons
    (root / "s_fov_positions_file.csv").write_text("FOV,X_mm\n1,0\n")
    with pytest.raises(ValueError, match="Y_mm"):
        open_source(spark, root).polygons


def test_row_indices(spark, tmp_path):
    spark.range(0, 1000, 1, 5).write.csv(str(tmp_path / "csv"), header=True)
    one = spark.range(500).coalesce(1)
    one.write.csv(str(tmp_path / "one"), header=True)
    got = file_order_index(spark.read.schema("id long").option("header", True).csv(str(tmp_path / "one")))
    assert got.where("id <> row_index").count() == 0
    many = file_order_index(spark.read.schema("id long").option("header", True).csv(str(tmp_path / "csv")))
    assert [r[0] for r in many.select("row_index").orderBy("row_index").collect()] == list(range(1000))
    spark.range(0, 1000, 1, 5).write.parquet(str(tmp_path / "pq"))
    several = parquet_row_index(spark.read.parquet(str(tmp_path / "pq")))
    assert [r[0] for r in several.select("row_index").orderBy("row_index").collect()] == list(range(1000))


def test_bucketed_numbering(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    got = prefix_offsets(df, "id", "v", "before", bits=4).orderBy("id").collect()
    total = 0
    for r in got:
        assert r["before"] == total
        total += r["v"]
    placed = position_in_group(spark.range(1000).withColumn("g", (F.col("id") < 700).cast("int")), "g", "id", "pos", 50)
    for g, n in ((0, 300), (1, 700)):
        assert sorted(r["pos"] for r in placed.where(F.col("g") == g).collect()) == list(range(n))


def test_tables(spark, tmp_path):
    panel = {"payload": {"targets": [{"codewords": [4, 9], "type": {"data": {"name": "Abc"}}}, {"codewords": [2], "type": {"data": {"name": "xY"}}}]}}
    (tmp_path / "panel.json").write_text(json.dumps(panel, indent=1))
    assert rows(tables.gene_panel(spark, str(tmp_path / "panel.json"))) == [(0, 4, "ABC"), (1, 2, "XY")]
    polys = spark.createDataFrame([("a", SQUARE)], "cell_id string, ring array<struct<x:double,y:double>>")
    calls = []
    build = lambda: calls.append(1) or polys
    first = tables.cached_polygons(spark, str(tmp_path / "p"), build)
    tables.cached_polygons(spark, str(tmp_path / "p"), build)
    assert len(calls) == 1 and first.first()["bbox_x_max"] == 4.0
    tables.cached_polygons(spark, str(tmp_path / "p"), build, overwrite=True)
    assert len(calls) == 2
    with pytest.raises(ValueError, match="assigned_cell_id"):
        tables.read_segmentation(spark, str(tmp_path / "p"))


def test_region_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "r")
    spark.range(10).selectExpr("id * 1D AS x", "id * 2D AS y", "id AS z", "id AS unused").write.parquet(path)
    region = tables.read_region(spark, path, "x", "y", (2, 0, 6, 100), ["z"])
    assert rows(region, "z") == [(3,), (4,), (5,)]
    plan = region._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,2.0)" in plan and "unused" not in plan


def test_load_assigned_precedence(spark):
    source = spark.createDataFrame([(i, 0.0, 0.0, "g", "v") for i in range(4)], "row_index long, x double, y double, feature_name string, cell_id string")
    seg = spark.createDataFrame([(0, 0.9, "a", 0.5), (1, 0.4, "a", 0.5), (2, 0.6, None, 0.5)], "row_index long, similarity double, assigned_cell_id string, similarity_threshold double")
    pick = lambda **k: [r[0] for r in rows(load_assigned(seg, source, **k), "row_index")]
    assert pick(include_all=True, min_similarity=0.95, min_transcripts=0) == [0, 1]
    assert pick(min_similarity=0.3, min_transcripts=0) == [0, 1]
    assert pick(min_transcripts=0) == [0]
    assert pick(min_transcripts=2) == []
    bare = seg.drop("similarity_threshold")
    assert [r[0] for r in rows(load_assigned(bare, source, min_transcripts=2), "row_index")] == [0, 1]


def test_embeddings_match_numpy(spark):
    rng = np.random.default_rng(9)
    x = rng.poisson(1.0, (40, 6)).astype(float)
    data = [(f"c{i}", f"g{j}", float(v), i < 30) for i, row in enumerate(x) for j, v in enumerate(row) if v]
    norm = spark.createDataFrame(data, "cell_id string, feature_name string, norm double, filtered boolean")
    kept = x[:30]
    r = np.nan_to_num(np.corrcoef(kept.T))
    u, s, _ = np.linalg.svd(r - r.mean(0))
    got = np.array([v["embedding"] for v in gene_embedding(norm.where("filtered"), F.lit(30), 3).orderBy("feature_name").collect()])
    assert np.abs(np.abs(got) - np.abs(u[:, :3] * s[:3])).max() < 1e-8
    _, _, vt = np.linalg.svd(kept - kept.mean(0))
    want = (x - kept.mean(0)) @ vt[:3].T
    got = {v["cell_id"]: np.array(v["embedding"]) for v in cell_embedding(norm, F.lit(30), 3).collect()}
    for i in range(40):
        if x[i].any():
            assert np.abs(np.abs(got[f"c{i}"]) - np.abs(want[i])).max() < 1e-8


def test_segment_and_export(spark, tmp_path):
    root = xenium(spark, tmp_path / "run", grid=3, per_cell=40)
    out = str(tmp_path / "out")
    config = SegmentConfig(
        input_directory=str(root),
        output_directory=out,
        cells_embedding_size=4,
        cells_clusters_n_neighbors=3,
        cells_clusters_min_size=0,
        cells_min_counts=3,
        genes_min_counts=5,
        genes_clusters_n_neighbors=2,
        tiling_nodes_per_tile=100,
        hidden_channels=4,
        out_channels=6,
        n_mid_layers=0,
        n_epochs=2,
        debug=True,
    )
    path = segment(spark, config)
    # Trained weights are a table; reading it gives the same scores.
    assert spark.read.option("header", True).csv(f"{out}/metrics").where("split = 'train'").count() == 2
    with_table = replace(config, scores="weights", weights=f"{out}/weights.parquet", output_directory=f"{out}/again", debug=False, save_matrix=False)
    assert rows(spark.read.parquet(segment(spark, with_table)), "row_index", "assigned_cell_id") == rows(spark.read.parquet(path), "row_index", "assigned_cell_id")
    with pytest.raises(ValueError):
        segment(spark, replace(with_table, weights=None))
    seg = spark.read.parquet(path)
    assert seg.columns == ["row_index", "similarity", "assigned_cell_id", "similarity_threshold", "converged"]
    assert seg.select("row_index").distinct().count() == seg.count()
    assert seg.where("assigned_cell_id IS NOT NULL").count() > 300
    assert spark.read.parquet(f"{out}/matrix/counts.parquet").count() > 0
    assert spark.read.parquet(f"{out}/debug/tiles.parquet").where("is_train").count() > 0
    written = export(
        spark,
        ExportConfig(
            segmentation_path=path, source_path=str(root), output_directory=str(tmp_path / "exp"),
            elements=("matrix", "boundaries", "transcripts"), min_transcripts=3, include_all_transcripts=True,
        ),
    )
    shapes = spark.read.parquet(written["boundaries"])
    assert shapes.count() == 9
    assert spark.read.parquet(f"{written['matrix']}/cells.parquet").where("area > 0").count() == 9
    assert "assigned_cell_id" in spark.read.parquet(written["transcripts"]).columns
    pred = seg.select("row_index", F.lit(0).cast("long").alias("cell_encoding"), "similarity", F.lit(0).cast("long").alias("gene_encoding"))
    pred.write.parquet(str(tmp_path / "pred"))
    spark.createDataFrame([("c0", 0)], "cell_id string, cell_encoding int").write.parquet(str(tmp_path / "cells"))
    again = segment_only(spark, str(tmp_path / "cells"), str(tmp_path / "pred"), str(tmp_path / "again"))
    assert spark.read.parquet(again).where("assigned_cell_id = 'c0'").count() == seg.count()


def test_encoder_path_of_the_plan(spark, tmp_path):
    from gridloom.operators.encoder import initial_weights

    root = xenium(spark, tmp_path / "enc", grid=2, per_cell=30)
    config = SegmentConfig(
        input_directory=str(root), output_directory=str(tmp_path / "enc_out"), scores="weights", cells_embedding_size=3,
        cells_clusters_n_neighbors=2, cells_clusters_min_size=0, cells_min_counts=1, genes_min_counts=1,
        genes_clusters_n_neighbors=2, tiling_mode="square", tiling_side_length=6.0, tiling_margin_prediction=2.0, save_matrix=False,
    )
    weights = initial_weights(4, 3, in_channels=4, hidden_channels=2, out_channels=3, n_mid_layers=0, frequency_size=8)
    seg = spark.read.parquet(segment(spark, config, weights=weights))
    assert seg.select("row_index").distinct().count() == seg.count()
    assert seg.where("assigned_cell_id IS NOT NULL").count() > 50


def test_configs_and_command_line():
    with pytest.raises(ValueError):
        SegmentConfig(tiling_mode="hexagonal")
    with pytest.raises(ValueError):
        SegmentConfig(edges_per_batch=0)
    with pytest.raises(ValueError):
        ExportConfig(elements=("plots",))
    args = build_parser().parse_args(["export", "--elements", "matrix", "--min-similarity", "0.5", "--include-all-transcripts"])
    assert args.elements == ["matrix"] and args.min_similarity == 0.5 and args.include_all_transcripts


def test_bounds_come_from_footers(spark, tmp_path):
    data = [(i, float(i % 97) - 3, float(i) / 7) for i in range(2000)]
    df = spark.createDataFrame(data, "id long, x double, y double")
    path = str(tmp_path / "p.parquet")
    df.repartition(3).write.parquet(path)
    row, plan = tables.footer_bounds(spark, path, "x", "y")
    assert "PushedAggregation: [MIN(x), MIN(y), MAX(x), MAX(y)]" in plan
    want = (-3.0, 0.0, 93.0, 1999 / 7)
    assert tuple(row) == want and tuple(tables.xy_bounds(spark, path, "x", "y").first()) == want
    import pyarrow.parquet as pq

    (tmp_path / "bare").mkdir()
    pq.write_table(df.toArrow(), str(tmp_path / "bare" / "a.parquet"), write_statistics=False)
    assert tables.footer_bounds(spark, str(tmp_path / "bare"), "x", "y")[0] is None
    assert tuple(tables.xy_bounds(spark, str(tmp_path / "bare"), "x", "y").first()) == want
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")


def test_polygons_are_written_in_space_order(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    rng = np.random.default_rng(5)
    places = rng.uniform(0, 1000, (3000, 2))
    data = [(i, [(float(x), float(y)), (float(x) + 2, float(y)), (float(x), float(y) + 2)]) for i, (x, y) in enumerate(places)]
    polygons = spark.createDataFrame(data, "cell_id long, ring array<struct<x:double,y:double>>").repartition(4)
    path = str(tmp_path / "shapes.parquet")
    # Few rows would be put into one file.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        tables.write_polygons(polygons, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    region = (100.0, 100.0, 250.0, 200.0)
    got = sorted(r["cell_id"] for r in tables.read_polygons_in(spark, path, region).collect())
    assert got == [i for i, (x, y) in enumerate(places) if x <= 250 and x + 2 >= 100 and y <= 200 and y + 2 >= 100]
    # Files are ranges of the curve: few of them can hold anything of a small region.
    boxes = []
    for name in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        at = {meta.schema.column(c).name: c for c in range(meta.num_columns) if meta.schema.column(c).name.startswith("bbox_")}
        for g in range(meta.num_row_groups):
            stat = {n: meta.row_group(g).column(c).statistics for n, c in at.items()}
            boxes.append((stat["bbox_x_min"].min, stat["bbox_y_min"].min, stat["bbox_x_max"].max, stat["bbox_y_max"].max))
    met = [b for b in boxes if b[0] <= 250 and b[2] >= 100 and b[1] <= 200 and b[3] >= 100]
    assert len(boxes) >= 4 and len(met) <= len(boxes) // 2
    tables.write_polygons(polygons.limit(0), str(tmp_path / "none.parquet"))
    assert tables.read_polygons_in(spark, str(tmp_path / "none.parquet"), region).count() == 0
