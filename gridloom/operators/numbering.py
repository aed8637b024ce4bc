"""Dense numbering of keys and files without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import cut_lineage


def dense_index(df: DataFrame, order_by: list[str | Column], name: str) -> DataFrame:
    """Number the rows 0..n-1 in a total order, as a range-partitioned sort.

    The ranges are written with their number, counted (one row each), and numbered apart.
    """
    ranged = cut_lineage(df.repartitionByRange(*order_by).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order_by)) - 1
    return ranged.join(starts, "_range").withColumn(name, F.col("_start") + inside).drop("_range", "_start")


def encode(df: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct non-null keys in sorted order with their dense code."""
    return dense_index(df.select(key).where(F.col(key).isNotNull()).distinct(), [key], name)


def file_order_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """0..n-1 in scan order for formats without a row-index metadata column.

    ``monotonically_increasing_id`` is (partition, position); the start of every
    partition comes from a count per partition - one row per input split.
    """
    tagged = df.withColumn("_mid", F.monotonically_increasing_id()).withColumn("_pid", F.shiftright("_mid", 33))
    sizes = tagged.groupBy("_pid").agg((F.max("_mid").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    position = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        tagged.join(starts, "_pid").withColumn(name, F.col("_start") + position).drop("_mid", "_pid", "_start")
    )


def parquet_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Row position before any filter.  With several files, files are taken in path order."""
    tagged = df.select("*", F.col("_metadata.row_index").alias(name), F.col("_metadata.file_path").alias("_file"))
    if len(df.inputFiles()) <= 1:
        return tagged.drop("_file")
    sizes = df.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_i"))
    sizes = sizes.groupBy("_file").agg((F.max("_i") + 1).alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return tagged.join(starts, "_file").withColumn(name, F.col(name) + F.col("_start")).drop("_file", "_start")


def lookup_with_default(keys: DataFrame, key: str, codes: DataFrame, code: str, default: int = -1) -> DataFrame:
    """Left join to a dictionary; unknown keys get ``default``."""
    return keys.join(codes.select(key, code), key, "left").withColumn(code, F.coalesce(F.col(code), F.lit(default)))


def prefix_offsets(df: DataFrame, key: str, value: str, name: str, bits: int = 20) -> DataFrame:
    """Running total of ``value`` before each integer ``key``.

    Keys are cut into ordered buckets of ``2**bits`` values: a window runs inside each
    bucket, and another over the bucket sums, so no task orders the whole table.
    """
    bucketed = df.withColumn("_b", F.shiftright(key, bits))
    up_to = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        bucketed.groupBy("_b")
        .agg(F.sum(value).alias("_s"))
        .select("_b", F.coalesce(F.sum("_s").over(up_to), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        bucketed.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(starts, "_b")
        .withColumn(name, F.col(name) + F.col("_start"))
        .drop("_b", "_start")
    )


def position_in_group(df: DataFrame, group: str, ident: str, name: str, rows_per_bucket: int = 100_000) -> DataFrame:
    """0-based position of each row inside its group, with the group's size as ``<name>_of``.

    A big group is hashed into buckets that are numbered apart and then stacked, so a
    group holding a third of all rows is still numbered by many tasks.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias(f"{name}_of"))
    tagged = df.join(sizes, group)
    buckets = F.ceil(F.col(f"{name}_of") / F.lit(rows_per_bucket)).cast("int")
    tagged = tagged.withColumn("_b", F.pmod(F.xxhash64(ident), F.greatest(buckets, F.lit(1))).cast("int"))
    counts = tagged.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_b").orderBy(ident)
    return (
        tagged.withColumn("_r", F.row_number().over(inside) - 1)
        .join(starts, [group, "_b"])
        .withColumn(name, (F.col("_start") + F.col("_r")).cast("long"))
        .drop("_b", "_r", "_start")
    )
