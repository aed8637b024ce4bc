"""Raw points and polygons -> assignments.

Each stage is a DataFrame function; the stages whose output several others read are
written to the checkpoint folder, so a lost executor costs one stage.
"""

from __future__ import annotations

import logging
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.config import SegmentConfig
from gridloom.functions import geometry as G
from gridloom.operators import encoder as enc
from gridloom.operators.assignment import assign, predict, score_edges
from gridloom.operators.clustering import cluster_similarity, cluster_vectors
from gridloom.operators.embedding import cell_embedding, gene_embedding
from gridloom.operators.graph import induced_edges, partition_edges, reference_edges, training_points, typed_edges
from gridloom.operators.knn import knn_within, uniform_candidates
from gridloom.operators.matrix import (
    cell_totals,
    centroids,
    check_reference_genes,
    count_matrix,
    depth_normalize,
    keep_genes,
    totals,
)
from gridloom.operators.numbering import encode as encode_keys
from gridloom.operators.outlines import morphology_embedding
from gridloom.operators.sampling import split_tiles
from gridloom.operators.spatial_join import prediction_candidates
from gridloom.operators.standardize import reference_mask
from gridloom.operators.tiling import quadtree_leaves, quadtree_shape, square_tiles, tile_fit_nodes, tile_predict_nodes
from gridloom.operators.training import TrainingConfig, read_weights, similarity_matrix, tile_rows, train, write_weights
from gridloom.session import cut_lineage
from gridloom.sources import tables
from gridloom.sources.vendors import open_source

log = logging.getLogger(__name__)


@dataclass
class Profiles:
    """Cell and gene tables with codes, clusters and embeddings, and cluster similarities."""

    counts: DataFrame
    cells: DataFrame
    genes: DataFrame
    cell_similarity: DataFrame
    gene_similarity: DataFrame


def build_profiles(points: DataFrame, config: SegmentConfig, polygons: DataFrame | None = None) -> Profiles:
    """Counts of trusted points -> normalised matrix -> embeddings -> clusters."""
    spark = points.sparkSession
    trusted = points.where(reference_mask(F.col("cell_compartment"), config.segmentation_graph_mode))
    counts = keep_genes(count_matrix(trusted), config.genes_min_counts)
    reference = None
    if config.gene_corr_reference_path:
        reference = tables.read_reference_matrix(spark, config.gene_corr_reference_path)
        counts = check_reference_genes(counts, reference, config.gene_missing_strategy, config.genes_min_counts)
    counts = cut_lineage(counts)
    cells = cell_totals(counts, config.cells_min_counts)
    norm = cut_lineage(depth_normalize(counts, cells))
    n_kept = cells.where("filtered").agg(F.count(F.lit(1))).scalar()

    if reference is None:
        gene_norm, gene_cells = norm.where("filtered"), n_kept
    else:
        panel = reference.join(counts.select("feature_name").distinct(), "feature_name", "left_semi")
        ref_cells = cell_totals(panel, config.cells_min_counts)
        gene_norm = depth_normalize(panel, ref_cells)
        gene_cells = ref_cells.agg(F.count(F.lit(1))).scalar()
    gene_vectors = cut_lineage(gene_embedding(gene_norm, gene_cells, config.cells_embedding_size))
    cell_vectors = cut_lineage(cell_embedding(norm, n_kept, config.cells_embedding_size))

    cell_codes = cut_lineage(encode_keys(cells, "cell_id", "cell_encoding"))
    gene_codes = cut_lineage(encode_keys(counts, "feature_name", "gene_encoding"))
    coded = cell_vectors.join(cell_codes, "cell_id").join(cells.select("cell_id", "filtered"), "cell_id")
    cell_clusters = cluster_vectors(
        coded.where("filtered"),
        config.cells_clusters_n_neighbors,
        config.cells_clusters_resolution,
        config.cells_clusters_min_size,
        ident="cell_encoding",
    )
    gene_coded = gene_vectors.join(gene_codes, "feature_name")
    gene_clusters = cluster_vectors(
        gene_coded, config.genes_clusters_n_neighbors, config.genes_clusters_resolution, ident="gene_encoding"
    )
    where = centroids(trusted)
    full_cells = (
        cells.join(cell_codes, "cell_id")
        .join(cell_vectors, "cell_id")
        .join(where, "cell_id")
        .join(cell_clusters.withColumnRenamed("id", "cell_encoding"), "cell_encoding", "left")
        .withColumn("cluster", F.coalesce("cluster", F.lit(-1)))
    )
    if config.cells_representation_mode == "morphology" and polygons is not None:
        kept = polygons.where(F.col("boundary_type") == config.segmentation_graph_mode)
        shapes = morphology_embedding(kept).withColumn("embedding", F.col("embedding").cast("array<double>"))
        full_cells = full_cells.drop("embedding").join(shapes, "cell_id")
    full_genes = (
        totals(counts, "feature_name")
        .join(gene_codes, "feature_name")
        .join(gene_vectors, "feature_name")
        .join(gene_clusters.withColumnRenamed("id", "gene_encoding"), "gene_encoding", "left")
    )
    full_cells, full_genes = cut_lineage(full_cells), cut_lineage(full_genes)
    return Profiles(norm, full_cells, full_genes, cluster_similarity(full_cells), cluster_similarity(full_genes))


def build_edges(points: DataFrame, polygons: DataFrame, cells: DataFrame, config: SegmentConfig) -> DataFrame:
    """The three edge tables, typed."""
    near = knn_within(points, config.transcripts_graph_max_k, config.transcripts_graph_max_dist).select("src", "dst")
    belongs = reference_edges(points, config.segmentation_graph_mode)
    if config.prediction_graph_mode == "uniform":
        candidates = uniform_candidates(points, cells, config.prediction_graph_max_k)
    else:
        kept = polygons.where(F.col("boundary_type") == config.prediction_graph_mode)
        kept = kept.join(cells.select("cell_id", "cell_encoding"), "cell_id")
        candidates = prediction_candidates(points, kept, config.prediction_graph_buffer_ratio)
    return typed_edges(near, belongs, candidates)


def build_tiles(points: DataFrame, config: SegmentConfig) -> DataFrame:
    if config.tiling_mode == "square":
        return square_tiles(points, config.tiling_side_length)
    return quadtree_leaves(points, config.tiling_nodes_per_tile, quadtree_shape(points))


def encoder_inputs(points, cells, polygons, edges, tiles, config: SegmentConfig):
    """Per tile: point nodes, cell nodes and the edges between them (margin included)."""
    boxes = tiles.select("tile_id", "x_min", "y_min", "x_max", "y_max")
    margin = config.tiling_margin_prediction
    tx = tile_predict_nodes(points, boxes, margin, carry=("gene_encoding",))
    tx = tx.join(points.select("row_index", "x", "y"), "row_index").withColumnRenamed("row_index", "id")
    kind = config.prediction_graph_mode if config.prediction_graph_mode != "uniform" else "cell"
    shapes = polygons.where(F.col("boundary_type") == kind).select("cell_id", G.centroid(F.col("ring")).alias("c"))
    placed = cells.join(shapes, "cell_id").select(
        F.col("cell_encoding").alias("id"), F.col("c.x").alias("x"), F.col("c.y").alias("y"), F.col("embedding").alias("features")
    )
    bd = tile_predict_nodes(placed, boxes, margin, ident="id").join(placed, "id")
    per_type = []
    for name, a, b in (("tx-tx", tx, tx), ("tx-belongs-bd", tx, bd), ("tx-neighbors-bd", tx, bd)):
        chosen = edges.where(F.col("edge_type") == name)
        inside = induced_edges(chosen, a.select("tile_id", "id"), b.select("tile_id", "id"))
        per_type.append(inside.withColumn("edge_type", F.lit(name)))
    return tx, bd, per_type[0].unionByName(per_type[1]).unionByName(per_type[2])


def embed_nodes(tx: DataFrame, bd: DataFrame, edges: DataFrame, genes: DataFrame, config: SegmentConfig, weights=None):
    """Encoder embeddings; without given weights they are drawn from the seed."""
    if weights is None:
        first = bd.select(F.size("features")).first()
        weights = enc.initial_weights(
            (genes.agg(F.max("gene_encoding")).first()[0] or 0) + 1,
            first[0] if first else config.cells_embedding_size,
            in_channels=config.in_channels,
            hidden_channels=config.hidden_channels,
            out_channels=config.out_channels,
            n_mid_layers=config.n_mid_layers,
            n_heads=config.n_heads,
            use_positions=config.use_positional_embeddings,
            normalize=config.normalize_embeddings,
        )
    return enc.encode(tx, bd, edges, weights, materialise=cut_lineage)


def profile_embeddings(points: DataFrame, profiles: Profiles) -> tuple[DataFrame, DataFrame]:
    """Embeddings without the encoder: a point is its gene's profile, a cell the mean profile
    of its counts, both in the gene embedding space."""
    genes = profiles.genes.select("feature_name", "gene_encoding", "embedding")
    tx = points.select(F.col("row_index").alias("id"), "gene_encoding").join(
        genes.select("gene_encoding", "embedding"), "gene_encoding"
    )
    parts = (
        profiles.counts.join(genes, "feature_name")
        .select("cell_id", "norm", F.posexplode("embedding").alias("dim", "v"))
        .groupBy("cell_id", "dim")
        .agg((F.sum(F.col("norm") * F.col("v")) / F.sum("norm")).alias("v"))
    )
    bd = parts.groupBy("cell_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"]).alias("embedding")
    )
    bd = bd.join(profiles.cells.select("cell_id", "cell_encoding"), "cell_id")
    return tx.select("id", "embedding"), bd.select(F.col("cell_encoding").alias("id"), "embedding")


def predict_assignments(points: DataFrame, candidates: DataFrame, tx: DataFrame, bd: DataFrame, cells: DataFrame) -> DataFrame:
    """Candidate scores -> best cell -> thresholds: the segmentation table."""
    scored = score_edges(candidates, tx, bd)
    return assign(cut_lineage(predict(points.select("row_index", "gene_encoding"), scored)), cells)


@dataclass
class Stages:
    """Written tables that both training and prediction start from."""

    points: DataFrame
    polygons: DataFrame
    profiles: Profiles
    edges: DataFrame
    tiles: DataFrame


def prepare_stages(spark: SparkSession, config: SegmentConfig) -> Stages:
    """Source -> profiles -> coded points -> edges -> split tiles."""
    source = open_source(spark, config.input_directory, config.platform)
    raw, polygons = cut_lineage(source.points), cut_lineage(source.polygons)
    profiles = build_profiles(raw, config, polygons)
    points = cut_lineage(training_points(raw, profiles.genes, profiles.cells, config.segmentation_graph_mode))
    edges = cut_lineage(build_edges(points, polygons, profiles.cells, config))
    tiles = cut_lineage(split_tiles(build_tiles(points, config), config.training_fraction))
    log.info("graph and tiles are written")
    return Stages(points, polygons, profiles, edges, tiles)


def training_tiles(stages: Stages, config: SegmentConfig) -> DataFrame:
    """One row per tile with its nodes, the edges inside it, and ``is_train``.

    A node lies in one tile; it is an anchor where it is inside the tile shrunk by the training margin.
    """
    boxes = stages.tiles.select("tile_id", "x_min", "y_min", "x_max", "y_max")
    margin = config.tiling_margin_training
    columns = ["tile_id", "id", "x", "y"]
    tx = tile_fit_nodes(stages.points, boxes, margin).select(
        "tile_id", F.col("row_index").alias("id"), "x", "y", "gene_encoding", F.col("gene_cluster").alias("cluster"), F.col("in_core").alias("mask")
    )
    kind = config.segmentation_graph_mode
    shapes = stages.polygons.where(F.col("boundary_type") == kind).select("cell_id", G.centroid(F.col("ring")).alias("c"))
    placed = stages.profiles.cells.join(shapes, "cell_id").select(
        F.col("cell_encoding").cast("long").alias("id"), F.col("c.x").alias("x"), F.col("c.y").alias("y"), F.col("embedding").alias("features"), "cluster"
    )
    bd = tile_fit_nodes(placed, boxes, margin, ident="id").select(*columns, "features", "cluster", F.col("in_core").alias("mask"))
    tx, bd = cut_lineage(tx.where("tile_id >= 0")), cut_lineage(bd.where("tile_id >= 0"))
    per_type = []
    for name, b in (("tx-tx", tx), ("tx-belongs-bd", bd)):
        chosen = stages.edges.where(F.col("edge_type") == name)
        inside = partition_edges(chosen, tx.select("id", "tile_id"), b.select("id", "tile_id"))
        per_type.append(inside.withColumn("edge_type", F.lit(name)))
    rows = tile_rows(tx, bd, per_type[0].unionByName(per_type[1]))
    return cut_lineage(rows.join(stages.tiles.select("tile_id", "is_train"), "tile_id"))


def train_weights(stages: Stages, config: SegmentConfig) -> tuple[enc.EncoderWeights, DataFrame]:
    """Fit the encoder to the training tiles; weights and metrics."""
    profiles = stages.profiles
    genes = profiles.genes.select("gene_encoding", "embedding").orderBy("gene_encoding").toArrow()
    table = np.array(genes.column("embedding").to_pylist(), float)
    weights = enc.initial_weights(
        len(table),
        profiles.cells.select(F.size("embedding")).first()[0],
        in_channels=config.in_channels,
        hidden_channels=config.hidden_channels,
        out_channels=config.out_channels,
        n_mid_layers=config.n_mid_layers,
        n_heads=config.n_heads,
        use_positions=config.use_positional_embeddings,
        normalize=config.normalize_embeddings,
        gene_embedding=table,
    )
    how = TrainingConfig(
        n_epochs=config.n_epochs,
        edges_per_batch=config.edges_per_batch,
        sg_loss_type=config.sg_loss_type,
        tx_margin=config.tx_margin,
        sg_margin=config.sg_margin,
        weights_start=tuple(w[0] for w in (config.tx_weight, config.bd_weight, config.sg_weight)),
        weights_end=tuple(w[1] for w in (config.tx_weight, config.bd_weight, config.sg_weight)),
    )
    sims = {"tx": similarity_matrix(profiles.gene_similarity), "bd": similarity_matrix(profiles.cell_similarity)}
    return train(training_tiles(stages, config), weights, sims, how)


def train_only(spark: SparkSession, config: SegmentConfig) -> str:
    """Train, and write ``weights.parquet`` and the metrics; returns the path of the weights."""
    weights, metrics = train_weights(prepare_stages(spark, config), config)
    path = f"{config.output_directory}/weights.parquet"
    write_weights(spark, weights, path)
    tables.write_metrics(metrics, config.output_directory)
    return path


def segment(spark: SparkSession, config: SegmentConfig, weights=None, embeddings: tuple[DataFrame, DataFrame] | None = None) -> str:
    """Run all stages; returns the path of the segmentation table.

    ``weights`` are encoder parameters or the path of their table; ``config.weights`` names such a table
    too.  ``config.scores`` says what scores the candidates: ``train`` fits the encoder first and writes its
    weights and metrics, ``weights`` reads them, ``profiles`` takes gene profiles in place of the encoder.
    ``embeddings`` are ready node embeddings ``(points, cells)``.
    """
    weights = weights if weights is not None else config.weights
    if isinstance(weights, str):
        weights = read_weights(spark, weights)
    if weights is None and embeddings is None and config.scores == "weights":
        raise ValueError("scores = 'weights' needs a table of weights")
    stages = prepare_stages(spark, config)
    points, profiles, edges, tiles = stages.points, stages.profiles, stages.edges, stages.tiles
    candidates = edges.where(F.col("edge_type") == "tx-neighbors-bd").select("src", "dst")
    if weights is None and embeddings is None and config.scores == "train":
        weights, metrics = train_weights(stages, config)
        write_weights(spark, weights, f"{config.output_directory}/weights.parquet")
        tables.write_metrics(metrics, config.output_directory)

    if weights is not None:
        tx, bd, per_tile = encoder_inputs(points, profiles.cells, stages.polygons, edges, tiles, config)
        per_tile = cut_lineage(per_tile)
        out = embed_nodes(tx, bd, per_tile, profiles.genes, config, weights)
        predictions = cut_lineage(tile_predictions(tx, per_tile, out))
        if config.debug:
            predictions.write.mode("overwrite").parquet(f"{config.output_directory}/debug/predictions.parquet")
        assigned = assign(predictions, profiles.cells)
    else:
        tx_vectors, bd_vectors = embeddings or profile_embeddings(points, profiles)
        assigned = predict_assignments(points, candidates, tx_vectors, bd_vectors, profiles.cells)

    path = tables.write_segmentation(assigned, config.output_directory)
    if config.save_matrix:
        write_assigned_matrix(spark.read.parquet(path), points, config.output_directory)
    if config.debug:
        write_debug(spark, config, profiles, edges, tiles)
    return path


def tile_predictions(tx: DataFrame, edges: DataFrame, embedded: dict[str, DataFrame]) -> DataFrame:
    """Best candidate per tile and core point; a point in two cores yields two rows."""
    from gridloom.functions.vectors import cosine
    from gridloom.operators.skew import keyed_join

    chosen = edges.where(F.col("edge_type") == "tx-neighbors-bd").select("tile_id", "src", "dst")
    a = embedded["tx"].select("tile_id", F.col("id").alias("src"), F.col("embedding").alias("_a"))
    b = embedded["bd"].select("tile_id", F.col("id").alias("dst"), F.col("embedding").alias("_b"))
    scored = keyed_join(chosen.join(a, ["tile_id", "src"]), b, ["tile_id", "dst"]).withColumn(
        "similarity", cosine(F.col("_a"), F.col("_b"))
    )
    best = scored.groupBy("tile_id", "src").agg(F.max(F.struct("similarity", (-F.col("dst")).alias("m"))).alias("b"))
    core = tx.where("is_core").select("tile_id", F.col("id").alias("src"), "gene_encoding")
    return core.join(best, ["tile_id", "src"], "left").select(
        F.col("src").cast("long").alias("row_index"),
        F.coalesce(-F.col("b.m"), F.lit(-1)).cast("long").alias("cell_encoding"),
        F.coalesce("b.similarity", F.lit(0.0)).alias("similarity"),
        F.col("gene_encoding").cast("long"),
    )


def write_assigned_matrix(segmentation: DataFrame, points: DataFrame, directory: str) -> None:
    """Matrix of assignments at or above their gene's threshold."""
    kept = segmentation.where(
        F.col("assigned_cell_id").isNotNull() & (F.col("similarity") >= F.col("similarity_threshold"))
    )
    located = points.select("row_index", "x", "y", "feature_name").join(kept.select("row_index", "assigned_cell_id"), "row_index")
    named = located.withColumnRenamed("assigned_cell_id", "cell_id")
    counts = count_matrix(named)
    tables.write_matrix(
        counts, totals(counts, "cell_id").join(centroids(named), "cell_id"), totals(counts, "feature_name"), directory
    )


def write_debug(spark: SparkSession, config: SegmentConfig, profiles: Profiles, edges: DataFrame, tiles: DataFrame) -> None:
    """Parameters, profiles, graph and tiles beside the output."""
    out = f"{config.output_directory}/debug"
    params = [(k, str(v)) for k, v in asdict(config).items()]
    spark.createDataFrame(params, "name string, value string").coalesce(1).write.mode("overwrite").json(f"{out}/params")
    named = {"cells": profiles.cells, "genes": profiles.genes, "edges": edges, "tiles": tiles}
    for name, table in named.items():
        table.write.mode("overwrite").parquet(f"{out}/{name}.parquet")


def segment_only(spark: SparkSession, cells_path: str, predictions_path: str, directory: str) -> str:
    """Re-run the last stage from written predictions and cells."""
    return tables.write_segmentation(
        assign(spark.read.parquet(predictions_path), spark.read.parquet(cells_path)), directory
    )


def predict_only(spark: SparkSession, points: str, candidates: str, tx: str, bd: str, cells: str, directory: str) -> str:
    """Re-run scoring and assignment from written embeddings."""
    read = spark.read.parquet
    return tables.write_segmentation(
        predict_assignments(read(points), read(candidates), read(tx), read(bd), read(cells)), directory
    )
