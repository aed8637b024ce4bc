"""Fixed table schemas and vendor column mappings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

POINT_STRUCT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING = T.ArrayType(POINT_STRUCT)

STANDARD_POINTS = T.StructType(
    [
        T.StructField("row_index", T.LongType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("feature_name", T.StringType()),
        T.StructField("cell_id", T.StringType()),
        T.StructField("cell_compartment", T.IntegerType()),
    ]
)

TRAINING_POINTS = T.StructType(
    STANDARD_POINTS.fields
    + [
        T.StructField("cell_encoding", T.IntegerType()),
        T.StructField("gene_encoding", T.IntegerType()),
        T.StructField("cell_cluster", T.IntegerType()),
        T.StructField("gene_cluster", T.IntegerType()),
    ]
)

STANDARD_POLYGONS = T.StructType(
    [
        T.StructField("cell_id", T.StringType()),
        T.StructField("boundary_type", T.StringType()),
        T.StructField("contains_nucleus", T.BooleanType()),
        T.StructField("ring", RING),
        T.StructField("key", T.StringType()),
    ]
)

TRAINING_POLYGONS = T.StructType(
    STANDARD_POLYGONS.fields
    + [
        T.StructField("cell_encoding", T.IntegerType()),
        T.StructField("cell_cluster", T.IntegerType()),
    ]
)

EDGES = T.StructType(
    [
        T.StructField("edge_type", T.StringType()),
        T.StructField("src", T.LongType()),
        T.StructField("dst", T.LongType()),
    ]
)

TILES = T.StructType(
    [T.StructField("tile_id", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ("x_min", "y_min", "x_max", "y_max")]
)

PREDICTIONS = T.StructType(
    [
        T.StructField("row_index", T.LongType()),
        T.StructField("cell_encoding", T.LongType()),
        T.StructField("similarity", T.DoubleType()),
        T.StructField("gene_encoding", T.LongType()),
    ]
)

SEGMENTATION = T.StructType(
    [
        T.StructField("row_index", T.LongType()),
        T.StructField("similarity", T.DoubleType()),
        T.StructField("assigned_cell_id", T.StringType()),
        T.StructField("similarity_threshold", T.DoubleType()),
        T.StructField("converged", T.BooleanType()),
    ]
)

REFERENCE_SUMMARY = T.StructType(
    [
        T.StructField("cell_type_name", T.StringType()),
        T.StructField("gene_name", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("me", T.DoubleType()),
        T.StructField("n_cells_cell_type", T.LongType()),
        T.StructField("pc", T.DoubleType()),
    ]
)

# Standard compartment codes.
EXTRACELLULAR, CYTOPLASM, NUCLEUS = 0, 1, 2

# Boundary type names and their composite-key suffixes.
CELL_BOUNDARY, NUCLEUS_BOUNDARY = "cell", "nucleus"
BOUNDARY_CODE = {"nucleus": "0", "cell": "1"}

# Control-feature patterns (regular expressions, unanchored).
XENIUM_CONTROL_PATTERNS = (
    "NegControlProbe_*",
    "antisense_*",
    "NegControlCodeword*",
    "BLANK_*",
    "DeprecatedCodeword_*",
    "UnassignedCodeword_*",
)
COSMX_CONTROL_PATTERNS = ("Negative*", "SystemControl*", "NegPrb*")

# Label-raster compartment codes and micrometres per pixel.
COSMX_MASK_CODES = {"extracellular": 0, "nucleus": 1, "membrane": 2, "cytoplasm": 3}
COSMX_MPP = 0.12028


@dataclass(frozen=True)
class PointVendor:
    """How one vendor's molecule table maps onto the standard schema."""

    filename: str
    x: str
    y: str
    feature: str
    cell_id: str
    compartment: str | None = None
    quality: str | None = None
    null_cell_id: str | None = None
    nucleus_value: int | None = None
    control_patterns: tuple[str, ...] = ()


@dataclass(frozen=True)
class PolygonVendor:
    """How one vendor's boundary inputs are named."""

    id: str
    cell_filename: str | None = None
    nucleus_filename: str | None = None
    x: str | None = None
    y: str | None = None
    cell_labels_dirname: str | None = None
    compartment_labels_dirname: str | None = None
    fov_positions_filename: str | None = None


# Vendor file and column names.
XENIUM_POINTS = PointVendor(
    filename="transcripts.parquet",
    x="x_location",
    y="y_location",
    feature="feature_name",
    cell_id="cell_id",
    compartment="overlaps_nucleus",
    quality="qv",
    null_cell_id="UNASSIGNED",
    nucleus_value=1,
    control_patterns=XENIUM_CONTROL_PATTERNS,
)
XENIUM_V1_POINTS = PointVendor(**{**XENIUM_POINTS.__dict__, "null_cell_id": "-1"})
XENIUM_POLYGONS = PolygonVendor(
    id="cell_id",
    cell_filename="cell_boundaries.parquet",
    nucleus_filename="nucleus_boundaries.parquet",
    x="vertex_x",
    y="vertex_y",
)
MERSCOPE_POINTS = PointVendor(
    filename="detected_transcripts.csv", x="global_x", y="global_y", feature="gene", cell_id="cell_id"
)
MERSCOPE_POLYGONS = PolygonVendor(
    id="EntityID", cell_filename="cell_boundaries.parquet", nucleus_filename="nucleus_boundaries.parquet"
)
COSMX_POINTS = PointVendor(
    filename="*_tx_file.csv",
    x="x_global_px",
    y="y_global_px",
    feature="target",
    cell_id="cell",
    compartment="CellComp",
    control_patterns=COSMX_CONTROL_PATTERNS,
)
# Compartment names of the CSV and their standard codes.
COSMX_COMPARTMENTS = {"Nuclear": NUCLEUS, "Membrane": CYTOPLASM, "Cytoplasm": CYTOPLASM, "None": EXTRACELLULAR}
COSMX_POLYGONS = PolygonVendor(
    id="cell_id",
    cell_labels_dirname="CellLabels",
    compartment_labels_dirname="CompartmentLabels",
    fov_positions_filename="*fov_positions_file.csv",
)


@dataclass(frozen=True)
class MetricColumns:
    """Column names of the point and polygon inputs of ``operators.buffered_counts``."""

    x: str = "x_location"
    y: str = "y_location"
    label: str = "codeword_index"
    feature: str = "feature_name"
    quality: str = "qv"
    vertex_x: str = "vertex_x"
    vertex_y: str = "vertex_y"
    polygon: str = "label_id"
    cell: str = "cell_id"


# CSV columns are declared, never inferred.
COSMX_CSV = T.StructType(
    [
        T.StructField("x_global_px", T.DoubleType()),
        T.StructField("y_global_px", T.DoubleType()),
        T.StructField("target", T.StringType()),
        T.StructField("cell", T.StringType()),
        T.StructField("CellComp", T.StringType()),
    ]
)
FOV_CSV = {"FOV": T.IntegerType(), "X_mm": T.DoubleType(), "Y_mm": T.DoubleType(), "Slide": T.IntegerType()}
