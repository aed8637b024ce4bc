"""Grid keys: turning spatial predicates into equi-joins.

A box is placed on the power-of-two level whose cell side is at least its longer
side, so it touches at most 2 x 2 cells however large or small it is.  A point
looks the cell up once per level that is in use.  This keeps one giant polygon
from being copied into millions of small cells, and keeps small polygons from
sharing one coarse cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Fixed bound on the levels: cell sides from 2**-20 to 2**40.  The set of levels
# in use is therefore never more than 61 values.
MIN_LEVEL, MAX_LEVEL = -20, 40


def cell(value: Column, side: Column | float) -> Column:
    side = side if isinstance(side, Column) else F.lit(float(side))
    return F.floor(value / side).cast("long")


def box_level(x_min: Column, y_min: Column, x_max: Column, y_max: Column) -> Column:
    longest = F.greatest(x_max - x_min, y_max - y_min, F.lit(2.0**MIN_LEVEL))
    return F.least(F.ceil(F.log2(longest)).cast("int"), F.lit(MAX_LEVEL))


def side_of(level: Column) -> Column:
    return F.pow(F.lit(2.0), level)


def key_boxes(boxes: DataFrame, bounds: tuple[str, str, str, str]) -> DataFrame:
    """Add ``_level, _gx, _gy``: one row per cell the box touches."""
    x_min, y_min, x_max, y_max = (F.col(b) for b in bounds)
    keyed = boxes.withColumn("_level", box_level(x_min, y_min, x_max, y_max))
    side = side_of(F.col("_level"))
    return keyed.withColumn("_gx", F.explode(F.sequence(cell(x_min, side), cell(x_max, side)))).withColumn(
        "_gy", F.explode(F.sequence(cell(y_min, side), cell(y_max, side)))
    )


def levels_in_use(boxes: DataFrame, bounds: tuple[str, str, str, str]) -> Column:
    """Distinct box levels as a scalar subquery (at most 61 integers)."""
    return boxes.select(F.collect_set(box_level(*[F.col(b) for b in bounds]))).scalar()


def key_points(points: DataFrame, x: str, y: str, levels: Column) -> DataFrame:
    """Add ``_level, _gx, _gy``: one row per level in use."""
    keyed = points.withColumn("_level", F.explode(levels))
    side = side_of(F.col("_level"))
    return keyed.withColumn("_gx", cell(F.col(x), side)).withColumn("_gy", cell(F.col(y), side))


GRID_KEYS = ["_level", "_gx", "_gy"]


def point_box_join(
    points: DataFrame,
    boxes: DataFrame,
    condition: Column,
    *,
    x: str,
    y: str,
    bounds: tuple[str, str, str, str],
) -> DataFrame:
    """Inner join of points with boxes, ``condition`` refining the grid match.

    A point meets a box in exactly one cell, so no pair appears twice.
    """
    left = key_points(points, x, y, levels_in_use(boxes, bounds))
    right = key_boxes(boxes, bounds)
    # Where the boxes are small enough to broadcast, the points have no exchange of their own, and
    # the scan's splits may be few; adaptive execution evens them out.
    return left.hint("rebalance").join(right, GRID_KEYS).where(condition).drop(*GRID_KEYS)
