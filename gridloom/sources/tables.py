"""Parquet / JSON inputs and outputs that are not vendor specific."""

from __future__ import annotations

from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.operators.buffered_counts import inside_open_box
from gridloom.operators.standardize import strip_nul

Box = tuple[float, float, float, float]


def read_region(
    spark: SparkSession,
    path: str,
    x: str,
    y: str,
    bounds: Box | None = None,
    extra_columns: list[str] | None = None,
    extra_filter: Column | None = None,
) -> DataFrame:
    """Columns ``x, y`` and extras inside an open box; both filters reach the Parquet scan."""
    table = spark.read.parquet(path)
    if bounds is not None:
        table = table.where(inside_open_box(F.col(x), F.col(y), bounds))
    if extra_filter is not None:
        table = table.where(extra_filter)
    return table.select(x, y, *[c for c in extra_columns or [] if c not in (x, y)])


#: Settings under which Parquet is read by the newer reader, which answers minima and maxima from file footers.
_FOOTERS = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}


def _bounds(spark: SparkSession, path: str, x: str, y: str) -> DataFrame:
    return spark.read.parquet(path).agg(
        F.min(x).alias("x_min"), F.min(y).alias("y_min"), F.max(x).alias("x_max"), F.max(y).alias("y_max")
    )


def footer_bounds(spark: SparkSession, path: str, x: str, y: str) -> tuple[Row | None, str]:
    """The bounds from footer statistics, and the plan that gave them; None where a file has no statistics.

    Holds for plain columns: a minimum over an expression is not in any footer.
    """
    before = {k: spark.conf.get(k, None) for k in _FOOTERS}
    for k, v in _FOOTERS.items():
        spark.conf.set(k, v)
    try:
        found = _bounds(spark, path, x, y)
        plan = found._jdf.queryExecution().executedPlan().toString()
        if "PushedAggregation: [MIN" not in plan:
            return None, plan
        try:
            return found.first(), plan
        except (PySparkException, Py4JJavaError):
            # Spark refuses to answer from a footer without statistics.
            return None, plan
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def xy_bounds(spark: SparkSession, path: str, x: str, y: str) -> DataFrame:
    """One row ``(x_min, y_min, x_max, y_max)``, from file footers; by a scan of both columns where those have no statistics."""
    row, _ = footer_bounds(spark, path, x, y)
    plain = _bounds(spark, path, x, y)
    return plain if row is None else spark.createDataFrame([row], plain.schema)


def cell_labels(boundaries: DataFrame, label: str = "cell_id") -> DataFrame:
    """Distinct labels without NUL padding."""
    return boundaries.select(strip_nul(F.col(label)).alias(label)).distinct()


def gene_panel(spark: SparkSession, path: str) -> DataFrame:
    """Panel JSON -> ``(gene_order, codeword, gene_name)``; the first codeword of each target."""
    schema = "payload struct<targets: array<struct<codewords: array<int>, type: struct<data: struct<name: string>>>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    targets = raw.select(F.posexplode("payload.targets").alias("gene_order", "t"))
    return targets.select(
        "gene_order", F.col("t.codewords")[0].alias("codeword"), F.upper("t.type.data.name").alias("gene_name")
    )


def read_reference_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Reference counts in long form ``(cell_id, feature_name, n)`` (no HDF5 reader here)."""
    return spark.read.parquet(path).select(
        F.col("cell").cast("string").alias("cell_id"), F.col("gene").alias("feature_name"), "n"
    )


def read_segmentation(spark: SparkSession, path: str) -> DataFrame:
    table = spark.read.parquet(path)
    if "assigned_cell_id" not in table.columns:
        raise ValueError("the segmentation table has no column assigned_cell_id")
    return table


def z_order(x: Column, y: Column, bounds: Box, bits: int = 16) -> Column:
    """Position of a place along a Z-order curve over ``bounds``: the bits of both cell numbers, interleaved."""

    def spread(value: Column, low: float, high: float) -> Column:
        top = (1 << bits) - 1
        share = (value - F.lit(float(low))) / F.lit(float(high - low) or 1.0)
        v = F.least(F.greatest(F.floor(share * top).cast("long"), F.lit(0).cast("long")), F.lit(top).cast("long"))
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(x, bounds[0], bounds[2]).bitwiseOR(F.shiftleft(spread(y, bounds[1], bounds[3]), 1))


def write_polygons(polygons: DataFrame, path: str, *, ring: str = "ring") -> None:
    """Polygons with their box as plain columns, in Z-order of the box centres.

    Neighbours share files and row groups, so a later region scan on the box columns skips most of them.
    """
    flat = [F.col(f"bbox.{c}").alias(f"bbox_{c}") for c in ("x_min", "y_min", "x_max", "y_max")]
    boxed = polygons.withColumn("bbox", G.envelope(F.col(ring))).select(*polygons.columns, *flat)
    x, y = (F.col("bbox_x_min") + F.col("bbox_x_max")) / 2, (F.col("bbox_y_min") + F.col("bbox_y_max")) / 2
    extent = boxed.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first()
    if extent[0] is not None:
        boxed = boxed.withColumn("_z", z_order(x, y, tuple(extent))).repartitionByRange("_z").sortWithinPartitions("_z").drop("_z")
    boxed.write.mode("overwrite").parquet(path)


def read_polygons_in(spark: SparkSession, path: str, bounds: Box) -> DataFrame:
    """Polygons whose box meets ``bounds`` (edges included), as ``write_polygons`` wrote them; the filter reaches the scan."""
    x0, y0, x1, y1 = (F.lit(float(v)) for v in bounds)
    meets = (F.col("bbox_x_min") <= x1) & (F.col("bbox_x_max") >= x0) & (F.col("bbox_y_min") <= y1) & (F.col("bbox_y_max") >= y0)
    return spark.read.parquet(path).where(meets)


def cached_polygons(spark: SparkSession, path: str, build, overwrite: bool = False) -> DataFrame:
    """Read polygons written before, or build and write them first."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    if overwrite or not exists:
        write_polygons(build(), path)
    return spark.read.parquet(path)


def write_segmentation(assigned: DataFrame, directory: str | Path) -> str:
    path = f"{directory}/segmentation.parquet"
    assigned.write.mode("overwrite").parquet(path)
    return path


def write_matrix(counts: DataFrame, cells: DataFrame, genes: DataFrame, directory: str | Path) -> None:
    """A matrix as three tables: counts in long form, cells and genes."""
    for name, table in (("counts", counts), ("cells", cells), ("genes", genes)):
        table.write.mode("overwrite").parquet(f"{directory}/matrix/{name}.parquet")


def write_metrics(metrics: DataFrame, directory: str | Path) -> None:
    """Per-epoch losses (one row per epoch) as CSV."""
    metrics.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{directory}/metrics")
