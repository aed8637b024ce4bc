"""Assignments -> cell matrix, points and cell polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.config import ExportConfig
from gridloom.functions import geometry as G
from gridloom.operators.matrix import centroids, count_matrix, totals
from gridloom.operators.numbering import dense_index
from gridloom.operators.outlines import cell_boundaries
from gridloom.operators.skew import keyed_join
from gridloom.sources import tables
from gridloom.sources.vendors import open_source


def load_assigned(
    segmentation: DataFrame,
    source: DataFrame,
    *,
    include_all: bool = False,
    min_similarity: float | None = None,
    min_transcripts: int = 10,
) -> DataFrame:
    """Join assignments to their points and filter.

    In this order: all assigned points; a fixed similarity; the per-gene threshold when
    both columns exist; otherwise any assignment.  Then cells with fewer than
    ``min_transcripts`` points go (0 keeps all).
    """
    joined = source.join(segmentation, "row_index", "left").where(F.col("assigned_cell_id").isNotNull())
    if include_all:
        pass
    elif min_similarity is not None:
        joined = joined.where(F.col("similarity") >= min_similarity)
    elif {"similarity", "similarity_threshold"} <= set(joined.columns):
        joined = joined.where(F.col("similarity") >= F.col("similarity_threshold"))
    if "cell_id" in joined.columns:
        joined = joined.drop("cell_id")
    if min_transcripts <= 0:
        return joined
    big = joined.groupBy("assigned_cell_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_transcripts)
    return keyed_join(joined, big.select("assigned_cell_id"), ["assigned_cell_id"])


def build_matrix(
    assigned: DataFrame, boundaries: DataFrame | None = None, region: str = "cell_boundaries"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(counts, cells, genes)``; cells have ``n_transcripts``, centroid, area and region."""
    points = assigned.withColumnRenamed("assigned_cell_id", "cell_id")
    counts = count_matrix(points)
    cells = totals(counts, "cell_id", name="n_transcripts").join(centroids(points), "cell_id")
    if boundaries is not None:
        cells = cells.join(boundaries.select("cell_id", G.area(F.col("ring")).alias("area")), "cell_id", "left")
    cells = cells.withColumn("region", F.lit(region))
    genes = dense_index(totals(counts, "feature_name"), ["feature_name"], "gene_encoding")
    return counts, cells, genes


def export(spark: SparkSession, config: ExportConfig, platform: str | None = None) -> dict[str, str]:
    """Write the chosen elements; returns their paths."""
    segmentation = tables.read_segmentation(spark, config.segmentation_path)
    source = open_source(spark, config.source_path, platform).points
    assigned = load_assigned(
        segmentation,
        source,
        include_all=config.include_all_transcripts,
        min_similarity=config.min_similarity,
        min_transcripts=config.min_transcripts,
    ).persist()
    out, written = config.output_directory, {}
    boundaries = None
    if "boundaries" in config.elements:
        traced = cell_boundaries(
            assigned, cell="assigned_cell_id", method=config.method, smoothing=config.chaikin_iterations
        )
        written["boundaries"] = f"{out}/cell_boundaries.parquet"
        tables.write_polygons(traced, written["boundaries"])
        boundaries = spark.read.parquet(written["boundaries"])
    if "matrix" in config.elements:
        tables.write_matrix(*build_matrix(assigned, boundaries), out)
        written["matrix"] = f"{out}/matrix"
    if "transcripts" in config.elements:
        written["transcripts"] = f"{out}/transcripts.parquet"
        assigned.write.mode("overwrite").parquet(written["transcripts"])
    assigned.unpersist()
    return written
