"""Counts of quality points inside grown polygons, and region bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geometry import owns_region
from gridloom.operators.spatial_join import count_points_in_polygons
from gridloom.operators.tiling import quadtree_leaves, region_shape
from gridloom.schemas import MetricColumns

Box = tuple[float, float, float, float]


def inside_open_box(x: Column, y: Column, bounds: Box) -> Column:
    x0, y0, x1, y1 = (F.lit(float(v)) for v in bounds)
    return (x > x0) & (x < x1) & (y > y0) & (y < y1)


def expression_matrix(points: DataFrame, polygons: DataFrame, *, label: str = "feature_name", **kwargs) -> DataFrame:
    """``(cell_id, <label>, n)`` of points strictly inside each polygon."""
    counts = count_points_in_polygons(points, polygons, label, "contains", **kwargs)
    return counts.select(F.col("index_match").alias("cell_id"), label, "n")


def buffered_counts(
    points: DataFrame,
    polygons: DataFrame,
    buffer_distance: float,
    *,
    bounds: Box | None = None,
    overlap: float = 100.0,
    min_quality: float = 20.0,
    label: str = "feature_name",
    columns: MetricColumns = MetricColumns(),
    **kwargs,
) -> DataFrame:
    """``(cell_id, <label>, n)`` inside polygons grown by ``buffer_distance``.

    Quality is strictly above ``min_quality``.  With ``bounds`` only polygons owned by
    that region are counted, against points in the region grown by ``overlap``.  Without,
    the whole table is one job: the shuffle does what regions are for, and no point near
    a region edge is counted twice.
    """
    kept = points.where(F.col(columns.quality) > min_quality)
    if bounds is not None:
        x0, y0, x1, y1 = bounds
        outset = (x0 - overlap, y0 - overlap, x1 + overlap, y1 + overlap)
        polygons = polygons.where(owns_region(F.col("ring"), bounds, outset))
        x, y = kwargs.get("x", "x"), kwargs.get("y", "y")
        kept = kept.where(inside_open_box(F.col(x), F.col(y), outset))
    return expression_matrix(
        kept, polygons, label=label, buffer=F.lit(float(buffer_distance)), **kwargs
    )


def merge_counts(*parts: DataFrame, cell: str = "cell_id", label: str = "feature_name") -> DataFrame:
    """Add partial count tables."""
    merged = parts[0]
    for more in parts[1:]:
        merged = merged.unionByName(more)
    return merged.groupBy(cell, label).agg(F.sum("n").alias("n"))


def point_regions(
    points: DataFrame, bounds: Box, max_size: int = 10_000_000, *, x: str = "x", y: str = "y", max_depth: int = 10
) -> DataFrame:
    """Boxes of at most ``max_size`` points (leaves of an unpadded, per-axis quadtree)."""
    inside = points.where(inside_open_box(F.col(x), F.col(y), bounds))
    return quadtree_leaves(inside, max_size, region_shape(bounds, max_depth), x=x, y=y)


def panel_order(counts: DataFrame, panel: DataFrame, *, label: str = "codeword_index") -> DataFrame:
    """Map codewords to panel genes: ``(cell_id, gene_order, gene_name, n)``."""
    return counts.join(panel.withColumnRenamed("codeword", label), label).select(
        "cell_id", "gene_order", "gene_name", "n"
    )
