"""Joins on keys that may be hot.

No side is copied and no key is counted beforehand.  Spark broadcasts a side whose measured size
allows it; otherwise its own exchanges carry both sides, and adaptive execution splits a hot
partition of one side and repeats only the matching part of the other (``session.SESSION_DEFAULTS``
turns that on even below an aggregation on the same key).  A hand-made repartition before the join
would take that away, so there is none.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

# Rows that one task sorts or aggregates, about, where a step sizes its tasks itself.
ROWS_PER_TASK = 1 << 19


def keyed_join(many: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join, ``inner`` or ``left``; the exchanges on both sides stay Spark's own."""
    if how not in ("inner", "left"):
        raise ValueError(f"a keyed join is inner or left, not {how!r}")
    return many.join(few, keys, how)


def sized(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Hash partitions for a step on ``keys`` that takes ``rows`` rows in all: as many tasks as they need.

    A fixed number of shuffle partitions would make the state of a task grow with the table.
    """
    return df.repartition(max(1, math.ceil(rows / ROWS_PER_TASK)), *keys)


def is_broadcast_size(written: DataFrame) -> bool:
    """True where Spark would broadcast this table: its measured size is within the session's threshold.

    ``written`` is a table as ``session.cut_lineage`` gives it, whose estimate is the size of its files.
    """
    conf = written.sparkSession._jsparkSession.sessionState().conf()
    size = written._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= conf.autoBroadcastJoinThreshold()
