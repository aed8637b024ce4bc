"""Row-level cleaning: filters, compartment codes, null ids, version strings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.schemas import COSMX_COMPARTMENTS, CYTOPLASM, EXTRACELLULAR, NUCLEUS, PointVendor

STANDARD_COLUMNS = ["row_index", "x", "y", "feature_name", "cell_id", "cell_compartment"]


def not_control(feature: Column, patterns: Sequence[str]) -> Column:
    """Keep features that match none of the patterns.

    The patterns are regular expressions matched anywhere in the name, although they
    look like globs.  A null feature matches neither way and is dropped.
    """
    return ~feature.rlike("|".join(patterns))


def null_if_sentinel(value: Column, sentinel) -> Column:
    return F.nullif(value, F.lit(sentinel))


def overlap_compartment(overlaps: Column, cell_id: Column, nucleus_value: int, null_cell_id: str) -> Column:
    """Nucleus when the flag says so, cytoplasm when another molecule has a cell, else outside."""
    return (
        F.when(overlaps == nucleus_value, F.lit(NUCLEUS))
        .when((overlaps != nucleus_value) & (cell_id != null_cell_id), F.lit(CYTOPLASM))
        .otherwise(F.lit(EXTRACELLULAR))
    )


def strict_map(value: Column, mapping: Mapping[str, int], null_value: int, what: str = "value") -> Column:
    """Dictionary lookup with its own code for null; an unknown value fails the job."""
    table = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])
    message = F.concat(F.lit(f"unmapped {what}: "), value)
    return F.when(value.isNull(), F.lit(null_value)).otherwise(
        F.coalesce(F.try_element_at(table, value), F.raise_error(message).cast("int"))
    )


def standardize_overlap_points(raw: DataFrame, vendor: PointVendor, min_quality: float = 20.0) -> DataFrame:
    """Raw rows with a nucleus-overlap flag -> standard points.  ``raw`` carries ``row_index``."""
    feature, cell_id = F.col(vendor.feature).cast("string"), F.col(vendor.cell_id).cast("string")
    return raw.where((F.col(vendor.quality) >= min_quality) & not_control(feature, vendor.control_patterns)).select(
        F.col("row_index").cast("long").alias("row_index"),
        F.col(vendor.x).cast("double").alias("x"),
        F.col(vendor.y).cast("double").alias("y"),
        feature.alias("feature_name"),
        null_if_sentinel(cell_id, vendor.null_cell_id).alias("cell_id"),
        overlap_compartment(F.col(vendor.compartment), cell_id, vendor.nucleus_value, vendor.null_cell_id).alias(
            "cell_compartment"
        ),
    )


def standardize_compartment_points(
    raw: DataFrame, vendor: PointVendor, compartments: Mapping[str, int] = COSMX_COMPARTMENTS
) -> DataFrame:
    """Raw rows with a compartment name -> standard points; outside a cell the id is null."""
    code = strict_map(F.col(vendor.compartment), compartments, EXTRACELLULAR, vendor.compartment)
    kept = raw.where(not_control(F.col(vendor.feature), vendor.control_patterns)).withColumn("cell_compartment", code)
    return kept.select(
        F.col("row_index").cast("long").alias("row_index"),
        F.col(vendor.x).cast("double").alias("x"),
        F.col(vendor.y).cast("double").alias("y"),
        F.col(vendor.feature).alias("feature_name"),
        F.when(F.col("cell_compartment") != EXTRACELLULAR, F.col(vendor.cell_id)).alias("cell_id"),
        "cell_compartment",
    )


def reference_mask(compartment: Column, mode: str) -> Column:
    """Which molecules carry a trusted cell label: nuclear ones, or any inside a cell."""
    modes = {"nucleus": [NUCLEUS], "cell": [NUCLEUS, CYTOPLASM]}
    if mode not in modes:
        raise ValueError(f"segmentation graph mode must be 'nucleus' or 'cell', not {mode!r}")
    return compartment.isin(modes[mode])


def version_numbers(version: Column) -> Column:
    """``"xenium-3.3.1.1"`` -> ``[3, 3, 1, 1]``."""
    return F.transform(F.split(F.element_at(F.split(version, "-"), -1), "\\."), lambda v: v.cast("int"))


def strip_nul(label: Column) -> Column:
    return F.regexp_replace(label, "\\x00", "")


def fov_cell_id(slide: Column, fov: Column, label: Column) -> Column:
    """Global cell id of a labelled region: ``c_<slide>_<fov>_<label>``."""
    return F.concat_ws("_", F.lit("c"), slide.cast("string"), fov.cast("string"), label.cast("string"))


def fov_file_name(prefix: str, fov: Column) -> Column:
    """``<prefix>_F007.tif``."""
    return F.concat(F.lit(f"{prefix}_F"), F.lpad(fov.cast("string"), 3, "0"), F.lit(".tif"))
