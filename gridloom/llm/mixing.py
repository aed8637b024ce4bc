"""Mixing sources to target weights.

Every document gets a hash-random key, documents are range-sorted by (source, key), a
distributed prefix sum of token counts places each document in its source's stream, and the
stream is cut at the source's exact budget; a budget above the source's size repeats epochs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.text import WHITE, require, words
from gridloom.session import cut_lineage

#: Weights by the position of the source in code-point order, and the most epochs.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"


def word_counts(docs: DataFrame, text: str = "text", out: str = "size") -> DataFrame:
    """``docs`` with the number of words ``[^\\x20\\x09-\\x0D]+`` of each text in place of the text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(text)
            n = words(batch.column(i), WHITE).counts if batch.num_rows else np.zeros(0, np.int64)
            columns = [pa.array(n, pa.int64()) if j == i else batch.column(j) for j in range(batch.num_columns)]
            names = [out if j == i else f.name for j, f in enumerate(batch.schema)]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"`{out}` long" if f.name == text else f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(count, schema)


def running_total(df: DataFrame, order: list[Column], value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` in the global order ``order``, without one task for all rows.

    Rows are range-partitioned and written with their range's number; each range sums its own
    rows, the sums of the ranges (one row each) are added up, and a window inside each range
    does the rest.  Equal rows may trade places.
    """
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = sums.select(
        "_range",
        F.coalesce(
            F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.join(before, "_range")
        .withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_range", "_before")
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: ``target`` and whole-word ``budget``.

    ``sizes`` has one row per source with ``source_size``.  Sources in code-point order (null
    last) weigh ``weights``, repeating, and share the sum of all sizes.  A target stops at
    ``max_epochs`` times its source's size and the excess is shared again by weight: in the order
    of cap / weight, the first sources are capped and the rest share what is left at one common
    rate.
    """
    position = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(position, F.lit(len(weights))) + 1).cast("long")
    weighed = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * max_epochs)
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    later = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = weighed.withColumn(
        "_left", F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0))
    ).withColumn("_open", F.sum("_w").over(later))
    # The first source, in that order, whose cap is not below its share: it sets the common rate.
    fits = F.col("_cap") * F.col("_open") >= F.col("_left") * F.col("_w")
    rate = F.max(F.when(fits, F.struct("_open", "_left"))).over(everything)
    return left.withColumn("_rate", rate).select(
        "source",
        "source_size",
        F.least(F.col("_cap").cast("double"), (F.col("_rate._left") * F.col("_w")).cast("double") / F.col("_rate._open")).alias("target"),
        F.least(F.col("_cap"), F.expr("(_rate._left * _w) div _rate._open")).alias("budget"),
    )


def mix(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for every row of ``docs``.

    ``taken`` counts the words that the mix takes from the document: its size in each full
    epoch, and in the last epoch what lies before the cut (so one document per source may be
    cut).  Within a source the order is that of md5(doc_id ':' seed), then size; the same input
    gives the same rows again.

    Null or empty text: size 0, nothing taken.  Null source: a source of its own, last in order.
    Null ids and repeated rows: each row counts for itself; rows equal in source, id and size may
    trade places.  Empty table: no rows.  Other columns are ignored.
    """
    require(docs, "doc_id", "text", "source")
    sized = word_counts(docs.select("doc_id", "source", "text"))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")))
    keyed = sized.withColumn("_key", key)
    placed = cut_lineage(running_total(keyed, [F.col("source").asc_nulls_last(), F.col("_key"), F.col("size")], "size", "_at"))
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("_at").alias("_begin"))
    wanted = targets(sizes.select("source", "source_size"), weights, max_epochs)
    begins = sizes.select(F.col("source").alias("_s"), "_begin")
    per_source = wanted.join(begins, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumnRenamed("source", "_source")
    epochs = F.expr("IF(source_size > 0, budget div source_size, 0)")
    rest = F.col("budget") - epochs * F.col("source_size")
    part = F.least(F.greatest(rest - (F.col("_at") - F.col("_begin")), F.lit(0)), F.col("size"))
    return placed.join(per_source, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).alias("taken")
    )
