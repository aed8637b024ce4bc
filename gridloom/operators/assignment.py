"""Scoring candidate edges, keeping the best cell per point, thresholding per gene."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.vectors import cosine
from gridloom.operators.skew import keyed_join
from gridloom.operators.thresholds import backfill_thresholds, gene_thresholds, li_thresholds, yen_thresholds  # noqa: F401
from gridloom.operators.vector_pairs import blocks_pay, measure_pairs
from gridloom.session import cut_lineage


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    length = [np.maximum(np.sqrt(np.einsum("ij,ij->i", m, m)), 1e-8) for m in (a, b)]
    return np.einsum("ij,ij->i", a, b) / (length[0] * length[1])


def score_edges(edges: DataFrame, src: DataFrame, dst: DataFrame) -> DataFrame:
    """Add ``similarity``, the cosine of the two ends.  Ends are ``(id, embedding)``.

    A cell that many candidates point at is spread over several tasks.  Where candidates are many for the vectors,
    these travel in blocks (``vector_pairs``), not on the edges.
    """
    if set(edges.columns) == {"src", "dst"}:
        edges = cut_lineage(edges)
        if blocks_pay(edges.count(), src.count(), dst.count()):
            return measure_pairs(edges, src, dst, _cosines, "similarity").select("dst", "src", "similarity")
    a = src.select(F.col("id").alias("src"), F.col("embedding").alias("_a"))
    b = dst.select(F.col("id").alias("dst"), F.col("embedding").alias("_b"))
    joined = edges.join(a, "src")
    scored = keyed_join(joined, b, ["dst"]).withColumn("similarity", cosine(F.col("_a"), F.col("_b")))
    return scored.drop("_a", "_b")


def best_per_source(scored: DataFrame) -> DataFrame:
    """``(src, dst, similarity)`` with the highest similarity, ties to the smaller ``dst``.

    A maximum over structs: no sort, and partial maxima are taken before the shuffle.
    """
    best = scored.groupBy("src").agg(F.max(F.struct("similarity", (-F.col("dst")).alias("m"))).alias("best"))
    return best.select("src", (-F.col("best.m")).alias("dst"), F.col("best.similarity").alias("similarity"))


def predict(nodes: DataFrame, scored: DataFrame, min_similarity: float | None = None) -> DataFrame:
    """Prediction rows of core points; without a candidate the cell is -1 and similarity 0.

    The best candidate is found first; below ``min_similarity`` its cell becomes -1 and its
    similarity stays.  ``nodes`` is ``(row_index, gene_encoding[, is_core])``.
    """
    core = nodes.where("is_core") if "is_core" in nodes.columns else nodes
    best = best_per_source(scored).withColumnRenamed("src", "row_index")
    cell = F.col("dst") if min_similarity is None else F.when(F.col("similarity") >= min_similarity, F.col("dst"))
    return core.join(best, "row_index", "left").select(
        F.col("row_index").cast("long"),
        F.coalesce(cell.cast("long"), F.lit(-1).cast("long")).alias("cell_encoding"),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
        F.col("gene_encoding").cast("long"),
    )


def keep_best_rows(predictions: DataFrame) -> DataFrame:
    """One row per ``row_index`` over all tiles: highest similarity, then smallest cell code."""
    order = F.struct("similarity", (-F.col("cell_encoding")).alias("m"), "gene_encoding")
    best = predictions.groupBy("row_index").agg(F.max(order).alias("b"))
    return best.select(
        "row_index",
        (-F.col("b.m")).alias("cell_encoding"),
        F.col("b.similarity").alias("similarity"),
        F.col("b.gene_encoding").alias("gene_encoding"),
    )


def decode_cells(predictions: DataFrame, cells: DataFrame) -> DataFrame:
    """Replace the cell code by its id (``assigned_cell_id``), null for -1 or an unknown code."""
    code = F.nullif(F.col("cell_encoding"), F.lit(-1).cast("long"))
    known = cells.select(F.col("cell_encoding").cast("long"), F.col("cell_id").alias("assigned_cell_id"))
    left = predictions.withColumn("cell_encoding", code)
    # The unassigned rows share one null key; they need no lookup at all.
    found = left.where(F.col("cell_encoding").isNotNull())
    decoded = keyed_join(found, known, ["cell_encoding"], "left")
    none = left.where(F.col("cell_encoding").isNull()).withColumn("assigned_cell_id", F.lit(None).cast("string"))
    return decoded.unionByName(none).drop("cell_encoding")


def assign(predictions: DataFrame, cells: DataFrame) -> DataFrame:
    """Predictions of all tiles -> the segmentation output table."""
    # Read by the histogram, the iteration and the result.
    decoded = cut_lineage(decode_cells(keep_best_rows(predictions), cells))
    thresholds = cut_lineage(gene_thresholds(decoded.where(F.col("assigned_cell_id").isNotNull())))
    return decoded.join(thresholds, "gene_encoding", "left").select(
        "row_index", "similarity", "assigned_cell_id", "similarity_threshold", "converged"
    )
