"""Vendor directories -> standard points and polygons.

A loader is a pair of functions returning DataFrames plus a directory check.  Checks
look at file names and one small JSON file on the driver; data is only ever scanned by
Spark.
"""

from __future__ import annotations

import csv
import json
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.numbering import file_order_index, parquet_row_index
from gridloom.operators.outlines import boundary_key, boundary_union, flag_nuclei, raster_polygons, repair_polygons, rings_from_vertices
from gridloom.operators.standardize import standardize_compartment_points, standardize_overlap_points
from gridloom.schemas import (
    CELL_BOUNDARY,
    COSMX_CSV,
    COSMX_POINTS,
    COSMX_POLYGONS,
    FOV_CSV,
    NUCLEUS_BOUNDARY,
    XENIUM_POINTS,
    XENIUM_POLYGONS,
    XENIUM_V1_POINTS,
    PointVendor,
)


@dataclass(frozen=True)
class Loader:
    """One vendor: a directory check and two scans."""

    check: Callable[[Path], None]
    points: Callable[[SparkSession, Path], DataFrame]
    polygons: Callable[[SparkSession, Path], DataFrame]


LOADERS: dict[str, Loader] = {}


def register(name: str, loader: Loader) -> Loader:
    LOADERS[name] = loader
    return loader


@dataclass(frozen=True)
class Source:
    """A checked directory."""

    spark: SparkSession
    directory: Path
    loader: Loader

    @property
    def points(self) -> DataFrame:
        return self.loader.points(self.spark, self.directory)

    @property
    def polygons(self) -> DataFrame:
        return self.loader.polygons(self.spark, self.directory)


def _exactly_one(directory: Path, pattern: str, what: str) -> Path:
    found = sorted(directory.glob(pattern))
    if len(found) != 1:
        raise OSError(f"expected one {what} entry named {pattern} in {directory}, found {len(found)}")
    return found[0]


# --- vertex-table vendor --------------------------------------------------------


def software_version(directory: Path) -> list[int]:
    """``{"analysis_sw_version": "xenium-3.3.1.1"}`` -> ``[3, 3, 1, 1]``."""
    text = json.loads((directory / "experiment.xenium").read_text())["analysis_sw_version"]
    return [int(v) for v in text.rsplit("-", 1)[-1].split(".")]


def _xenium_check(accept: Callable[[int], bool], wanted: str) -> Callable[[Path], None]:
    def check(directory: Path) -> None:
        version = software_version(directory)
        if not accept(version[0]):
            found = ".".join(map(str, version))
            raise OSError(f"this reader needs software version {wanted}; the directory was made by {found}")
        for name in (XENIUM_POINTS.filename, XENIUM_POLYGONS.cell_filename, XENIUM_POLYGONS.nucleus_filename):
            _exactly_one(directory, name, "sample")

    return check


def _xenium_points(vendor: PointVendor) -> Callable[[SparkSession, Path], DataFrame]:
    def scan(spark: SparkSession, directory: Path) -> DataFrame:
        raw = parquet_row_index(spark.read.parquet(str(directory / vendor.filename)))
        return standardize_overlap_points(raw, vendor)

    return scan


def vertex_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Vertex table -> ``(cell_id, ring)``, vertices in file order, invalid rings repaired."""
    v = XENIUM_POLYGONS
    rows = parquet_row_index(spark.read.parquet(path), "_seq").withColumn(v.id, F.col(v.id).cast("string"))
    return repair_polygons(rings_from_vertices(rows, ident=v.id, x=v.x, y=v.y, order="_seq"))


def _xenium_polygons(spark: SparkSession, directory: Path) -> DataFrame:
    v = XENIUM_POLYGONS
    cells = vertex_polygons(spark, str(directory / v.cell_filename))
    nuclei = vertex_polygons(spark, str(directory / v.nucleus_filename))
    return boundary_union(cells, nuclei)


# --- label-raster vendor --------------------------------------------------------


def fov_positions(spark: SparkSession, directory: Path) -> DataFrame:
    """Field positions, one row per field of view; ``Slide`` is 1 when the file has none."""
    path = next(directory.glob(COSMX_POLYGONS.fov_positions_filename))
    with open(path, newline="") as f:
        header = next(csv.reader(f))
    schema = T.StructType([T.StructField(c, FOV_CSV.get(c, T.StringType())) for c in header])
    table = spark.read.schema(schema).option("header", True).csv(str(path))
    return table if "Slide" in header else table.withColumn("Slide", F.lit(1))


def raster_preflight(directory: Path) -> None:
    """All rasters named by the position file exist, and the file has its columns."""
    v = COSMX_POLYGONS
    for pattern in (v.compartment_labels_dirname, v.cell_labels_dirname, v.fov_positions_filename):
        if not any(directory.glob(pattern)):
            raise FileNotFoundError(f"{directory} has nothing named {pattern}")
    with open(next(directory.glob(v.fov_positions_filename)), newline="") as f:
        reader = csv.DictReader(f)
        missing = {"X_mm", "Y_mm"} - set(reader.fieldnames or [])
        if missing:
            raise ValueError(f"the field position file lacks {', '.join(sorted(missing))}")
        fields = [row["FOV"].zfill(3) for row in reader]
    for prefix in (v.cell_labels_dirname, v.compartment_labels_dirname):
        actual = {p.name.rsplit(".", 1)[0] for p in (directory / prefix).iterdir()}
        absent = sorted({f"{prefix}_F{f}" for f in fields} - actual)
        if absent:
            raise FileNotFoundError(f"{len(absent)} rasters are absent from {prefix}: " + ", ".join(absent))


def _cosmx_check(directory: Path) -> None:
    v = COSMX_POLYGONS
    for pattern in (
        COSMX_POINTS.filename,
        v.compartment_labels_dirname,
        v.cell_labels_dirname,
        v.fov_positions_filename,
    ):
        _exactly_one(directory, pattern, "sample")


def _cosmx_points(spark: SparkSession, directory: Path) -> DataFrame:
    path = next(directory.glob(COSMX_POINTS.filename))
    with open(path, newline="") as f:
        header = next(csv.reader(f))
    known = {f.name: f.dataType for f in COSMX_CSV}
    schema = T.StructType([T.StructField(c, known.get(c, T.StringType())) for c in header])
    raw = file_order_index(spark.read.schema(schema).option("header", True).csv(str(path)))
    return standardize_compartment_points(raw, COSMX_POINTS)


def label_pixels(spark: SparkSession, directory: Path) -> DataFrame:
    """Pixels ``(fov, row, col, label, comp)`` of all fields.

    No TIFF decoder is installed here, so a raster is read in decoded form: a Parquet
    file per field, ``CellLabels/CellLabels_F001.parquet`` and the compartment
    counterpart, with columns ``row, col, value``.
    """
    v = COSMX_POLYGONS

    def read(prefix: str, name: str) -> DataFrame:
        table = spark.read.schema("row int, col int, value int").option("recursiveFileLookup", True).parquet(str(directory / prefix))
        fov = F.regexp_extract(F.col("_metadata.file_path"), r"_F(\d+)\.[^/]*(/[^/]*)?$", 1).cast("int")
        return table.select(fov.alias("fov"), "row", "col", F.col("value").alias(name))

    labels = read(v.cell_labels_dirname, "label").where(F.col("label") != 0)
    return labels.join(read(v.compartment_labels_dirname, "comp"), ["fov", "row", "col"])


def _cosmx_polygons(spark: SparkSession, directory: Path) -> DataFrame:
    raster_preflight(directory)
    pixels, fields = label_pixels(spark, directory), fov_positions(spark, directory)
    parts = []
    for kind in (CELL_BOUNDARY, NUCLEUS_BOUNDARY):
        rings = repair_polygons(raster_polygons(pixels, fields, kind))
        parts.append(rings.withColumn("boundary_type", F.lit(kind)))
    both = flag_nuclei(parts[0].unionByName(parts[1]))
    return both.select(
        "cell_id",
        "boundary_type",
        "contains_nucleus",
        "ring",
        boundary_key(F.col("cell_id"), F.col("boundary_type")).alias("key"),
    )


# --- declared only --------------------------------------------------------------


def _merscope_check(directory: Path) -> None:
    raise NotImplementedError("this platform has a schema but no reader")


def _no_scan(spark: SparkSession, directory: Path) -> DataFrame:
    raise NotImplementedError("this platform has a schema but no reader")


register("nanostring_cosmx", Loader(_cosmx_check, _cosmx_points, _cosmx_polygons))
register(
    "10x_xenium",
    Loader(_xenium_check(lambda major: major > 1, "2.0.0 or higher"), _xenium_points(XENIUM_POINTS), _xenium_polygons),
)
register(
    "10x_xenium_v1",
    Loader(_xenium_check(lambda major: major == 1, "1.x"), _xenium_points(XENIUM_V1_POINTS), _xenium_polygons),
)
register("vizgen_merscope", Loader(_merscope_check, _no_scan, _no_scan))


def infer_platform(directory: Path) -> str:
    """The only platform whose directory check passes."""
    matches, problems = [], []
    for name, loader in LOADERS.items():
        try:
            loader.check(directory)
            matches.append(name)
        except Exception as e:  # any failure just means "not this platform"
            problems.append(f"{name}: {e}")
    if not matches:
        raise ValueError("no platform fits this directory - " + "; ".join(problems))
    if len(matches) > 1:
        raise ValueError("several platforms fit this directory: " + ", ".join(matches))
    return matches[0]


def open_source(spark: SparkSession, directory: str | Path, platform: str | None = None) -> Source:
    """Check a directory and return its lazily scanned tables."""
    directory = Path(directory)
    name = platform or infer_platform(directory)
    if name.lower() not in LOADERS:
        raise ValueError(f"no reader called {name!r}; there are {', '.join(LOADERS)}")
    loader = LOADERS[name.lower()]
    loader.check(directory)
    return Source(spark, directory, loader)
