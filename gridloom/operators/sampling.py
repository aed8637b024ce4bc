"""Reproducible sampling by hash instead of a random generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(*keys, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the keys and the seed only: 52 bits of md5(key:...:seed)."""
    digest = F.md5(F.concat_ws(":", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys], F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def sample_per_group(df: DataFrame, group: str, ident: str, n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` rows of each group (the sampling operator), lowest draw first.

    The row-number limit is applied before the shuffle as well as after it.
    """
    order = Window.partitionBy(group).orderBy(uniform(ident, seed=seed), F.col(ident))
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def split_tiles(tiles: DataFrame, fraction: float = 0.75, seed: int = 0, *, tile: str = "tile_id") -> DataFrame:
    """Add ``is_train``: a hash split that does not depend on the plan or the order of tiles."""
    return tiles.withColumn("is_train", uniform(F.col(tile), seed=seed) < F.lit(float(fraction)))
