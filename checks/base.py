"""Registry, and the roles the driver's tables play (points, polygons, vectors)."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.geometry import xy
from gridloom.session import ship_packages, use_defaults

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(tables) -> DataFrame`` under ``name``; ``sql`` must give the same rows."""

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_packages(spark, ROOT, ("gridloom", "checks"))
            return f(Tables(use_defaults(spark), sf_dir))

        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(run, sql)
        return f

    return wrap


def r(value: Column | str, digits: int = 6) -> Column:
    """Round, and turn -0.0 into 0.0."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value.cast("double"), digits) + F.lit(0.0)


class Tables:
    """The driver's tables under their roles."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def path(self, name: str) -> str:
        return f"{self.dir}/{name}.parquet"

    @property
    def raw_points(self) -> DataFrame:
        """Line items as a raw molecule table; parts of the smallest sizes are controls."""
        size = F.col("p_size")
        feature = (
            F.when(size <= 2, F.concat(F.lit("xBLANK_"), F.col("p_partkey").cast("string")))
            .when(size == 3, F.lit("NegControlCodewor"))
            .when(size == 4, F.lit("antisense_A"))
            .when(size == 5, F.lit(None).cast("string"))
            .otherwise(F.col("p_brand"))
        )
        flag = F.col("l_returnflag")
        return self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey")).select(
            row_index().alias("row_index"),
            (F.col("l_extendedprice") / 100).alias("x_location"),
            F.datediff("l_shipdate", F.lit("1992-01-01")).cast("double").alias("y_location"),
            feature.alias("feature_name"),
            F.when(flag == "N", F.lit("UNASSIGNED")).otherwise(F.col("l_suppkey").cast("string")).alias("cell_id"),
            F.when(flag == "R", 1).otherwise(0).alias("overlaps_nucleus"),
            F.col("l_quantity").alias("qv"),
            "l_returnflag",
            "l_linestatus",
        )

    @property
    def points(self) -> DataFrame:
        """Line items as standard points: brand is the gene, supplier the cell."""
        flag = F.col("l_returnflag")
        return self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey")).select(
            row_index().alias("row_index"),
            (F.col("l_extendedprice") / 100).alias("x"),
            F.datediff("l_shipdate", F.lit("1992-01-01")).cast("double").alias("y"),
            F.col("p_brand").alias("feature_name"),
            F.when(flag != "N", F.col("l_suppkey").cast("string")).alias("cell_id"),
            F.when(flag == "R", 2).when(flag == "A", 1).otherwise(0).alias("cell_compartment"),
            F.col("l_quantity").alias("qv"),
        )

    @property
    def event_points(self) -> DataFrame:
        """Events in the plane: time and value."""
        micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)
        return self.events.select(
            F.col("event_id").alias("row_index"),
            (micros.cast("double") / 1e6 / 2592.0).alias("x"),
            (F.col("value") * 10).alias("y"),
            F.col("event_type").alias("feature_name"),
            F.col("user_id").alias("owner"),
        )

    @property
    def polygons(self) -> DataFrame:
        """One polygon per supplier: a hexagon for even keys, a concave arrow for odd ones."""
        key = F.col("s_suppkey")
        cx = (F.lit(30) + F.pmod(key * 37, F.lit(100)) * 10).cast("double")
        cy = (F.lit(1100) + F.pmod(key * 53, F.lit(100)) * 25).cast("double")
        radius = (F.lit(20) + F.pmod(key, F.lit(30))).cast("double")

        def ring(shape):
            return F.array(*[xy(F.col("cx") + dx * F.col("radius"), F.col("cy") + dy * F.col("radius")) for dx, dy in shape])

        placed = self.supplier.select(key.alias("cell_id"), cx.alias("cx"), cy.alias("cy"), radius.alias("radius"))
        return placed.select(
            "cell_id", F.when(F.pmod("cell_id", F.lit(2)) == 0, ring(HEXAGON)).otherwise(ring(ARROW)).alias("ring")
        )

    @property
    def vectors(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("id"), "embedding", "label")

    @property
    def typed_cells(self) -> DataFrame:
        """Suppliers as cells: rounded centroid of their assigned points, region as type."""
        centre = self.points.where(F.col("cell_id").isNotNull()).groupBy("cell_id").agg(
            F.round(F.avg("x"), 3).alias("x"), F.round(F.avg("y"), 3).alias("y")
        )
        kinds = self.supplier.join(self.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("s_suppkey").cast("string").alias("cell_id"),
            F.concat(F.lit("T"), F.col("n_regionkey").cast("string")).alias("cell_type"),
        )
        return centre.join(kinds, "cell_id")


# Polygon shapes as unit offsets.
HEXAGON = ((1.0, 0.0), (0.5, 0.875), (-0.5, 0.875), (-1.0, 0.0), (-0.5, -0.875), (0.5, -0.875))
ARROW = ((1.0, -1.0), (0.0, 1.0), (-1.0, -1.0), (0.0, -0.5))


def row_index() -> Column:
    """One number from the four columns that identify a line item.

    From some 11.5 million orders it passes 64 bits; there it is the number's last 64 bits.
    """
    head, tail = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey"), F.col("l_suppkey")
    whole = head.cast("decimal(20,0)") * F.lit(100000).cast("decimal(6,0)") + tail.cast("decimal(20,0)")
    low, span = F.lit(-(2**63)).cast("decimal(19,0)"), F.lit(Decimal(2**64))
    return F.when(head < 92_233_720_000_000, head * 100000 + tail).otherwise((F.pmod(whole - low, span) + low).cast("long"))


# --- the same roles in SQL ------------------------------------------------------

_KEY = "((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 100000 + l_suppkey"
_DAY = "CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE)"

RAW = f"""raw AS (SELECT {_KEY} AS row_index, l_extendedprice / 100 AS x, {_DAY} AS y,
  CASE WHEN p_size <= 2 THEN 'xBLANK_' || p_partkey WHEN p_size = 3 THEN 'NegControlCodewor'
       WHEN p_size = 4 THEN 'antisense_A' WHEN p_size = 5 THEN NULL ELSE p_brand END AS feature_name,
  CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(l_suppkey AS VARCHAR) END AS cell_id,
  l_returnflag, l_linestatus, l_quantity AS qv FROM lineitem JOIN part ON l_partkey = p_partkey)"""

POINTS = f"""points AS (SELECT {_KEY} AS row_index, l_extendedprice / 100 AS x, {_DAY} AS y, p_brand AS feature_name,
  CASE WHEN l_returnflag <> 'N' THEN CAST(l_suppkey AS VARCHAR) END AS cell_id,
  CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS cell_compartment, l_quantity AS qv
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

EVENTS = """ev AS (SELECT event_id AS row_index,
  CAST(epoch_us(ts) - 1704067200000000 AS DOUBLE) / CAST(1000000 AS DOUBLE) / CAST(2592 AS DOUBLE) AS x,
  value * 10 AS y, event_type AS feature_name, user_id AS owner FROM events)"""


def _values(kind: int, shape) -> str:
    return ", ".join(f"({kind}, {i}, {len(shape)}, {dx}, {dy})" for i, (dx, dy) in enumerate(shape))


POLYGONS = f"""shape(kind, i, m, dx, dy) AS (VALUES {_values(0, HEXAGON)}, {_values(1, ARROW)}),
placed AS (SELECT s_suppkey AS cell_id, CAST(30 + (s_suppkey * 37) % 100 * 10 AS DOUBLE) AS cx,
  CAST(1100 + (s_suppkey * 53) % 100 * 25 AS DOUBLE) AS cy, CAST(20 + s_suppkey % 30 AS DOUBLE) AS radius FROM supplier),
verts AS (SELECT cell_id, i, m, cx + CAST(dx AS DOUBLE) * radius AS x, cy + CAST(dy AS DOUBLE) * radius AS y
  FROM placed JOIN shape ON kind = cell_id % 2),
edges AS (SELECT a.cell_id, a.i, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
  FROM verts a JOIN verts b ON a.cell_id = b.cell_id AND b.i = (a.i + 1) % a.m),
boxes AS (SELECT cell_id, min(x) AS bx0, min(y) AS by0, max(x) AS bx1, max(y) AS by1 FROM verts GROUP BY cell_id),
areas AS (SELECT cell_id, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area FROM edges GROUP BY cell_id)"""

COUNTS = "counts AS (SELECT cell_id, feature_name, count(*) AS n FROM points WHERE cell_id IS NOT NULL GROUP BY ALL)"

TYPED_CELLS = """typed_cells AS (SELECT c.cell_id, c.x, c.y, 'T' || n_regionkey AS cell_type FROM
  (SELECT cell_id, round(avg(x), 3) AS x, round(avg(y), 3) AS y FROM points WHERE cell_id IS NOT NULL GROUP BY cell_id) c
  JOIN supplier ON CAST(s_suppkey AS VARCHAR) = c.cell_id JOIN nation ON s_nationkey = n_nationkey)"""

VECTORS = "vec AS (SELECT vec_id AS id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS d FROM embeddings)"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
