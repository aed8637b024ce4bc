"""Contamination of cells by their neighbours and the background, against a reference.

``counts`` is ``(cell_id, feature_name, n)``; ``cells`` is ``(cell_id, cell_type, x, y)``;
``reference`` is ``(cell_type_name, gene_name, n, me, n_cells_cell_type, pc)``.  Cell
types and genes are panel-sized; nothing here is collected.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.knn import knn, knn_within
from gridloom.operators.skew import keyed_join


def expression_summary(counts: DataFrame, cell_types: DataFrame, min_counts: int = 2) -> DataFrame:
    """Reference summary from counts: non-zero cells, mean of positives and their share.

    Values are ``ln(1 + 1e4 n / total)``, zeroed where the raw count is below
    ``min_counts``; types x genes without a positive value are dropped.
    """
    typed = counts.join(cell_types.select("cell_id", F.col("cell_type").alias("cell_type_name")), "cell_id")
    total = F.sum("n").over(Window.partitionBy("cell_id"))
    value = F.log1p(F.lit(1e4) * F.col("n") / total)
    scored = typed.withColumn("v", value).where((F.col("n") >= min_counts) & (F.col("v") > 0))
    per_gene = scored.groupBy("cell_type_name", F.col("feature_name").alias("gene_name")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("me")
    )
    sizes = cell_types.groupBy(F.col("cell_type").alias("cell_type_name")).agg(
        F.count(F.lit(1)).alias("n_cells_cell_type")
    )
    return per_gene.join(sizes, "cell_type_name").select(
        "cell_type_name",
        "gene_name",
        "n",
        "me",
        "n_cells_cell_type",
        (F.col("n") / F.col("n_cells_cell_type")).alias("pc"),
    )


def group_reference(reference: DataFrame, grouping: Mapping[str, str]) -> DataFrame:
    """Merge types into coarser ones: means weighted by positive cells, shares from sums.

    Types outside ``grouping`` keep their name.
    """
    table = F.create_map(*[F.lit(v) for pair in grouping.items() for v in pair]) if grouping else None
    name = F.col("cell_type_name")
    coarse = name if table is None else F.coalesce(F.try_element_at(table, name), name)
    renamed = reference.withColumn("_coarse", coarse)
    cells = (
        renamed.select("_coarse", "cell_type_name", "n_cells_cell_type")
        .distinct()
        .groupBy("_coarse")
        .agg(F.sum("n_cells_cell_type").alias("n_cells_cell_type"))
    )
    merged = renamed.groupBy("_coarse", "gene_name").agg(
        F.sum("n").alias("n"), F.sum(F.col("me") * F.col("n")).alias("_weighted")
    )
    return merged.join(cells, "_coarse").select(
        F.col("_coarse").alias("cell_type_name"),
        "gene_name",
        "n",
        F.coalesce(F.try_divide("_weighted", "n"), F.lit(0.0)).alias("me"),
        "n_cells_cell_type",
        F.coalesce(F.try_divide("n", "n_cells_cell_type"), F.lit(0.0)).alias("pc"),
    )


def neighbour_frequencies(
    cells: DataFrame, k: int, max_distance: float | None = None, normalize: bool = True
) -> DataFrame:
    """``(cell_id, neighbour_type, freq)`` of the ``k`` nearest cells, itself included.

    The ``k`` nearest are taken first and those beyond ``max_distance`` dropped after,
    which is the same as the ``k`` nearest within that distance.
    """
    if max_distance is None:
        edges = knn(cells, cells, k, ident="cell_id", query_ident="cell_id")
    else:
        edges = knn_within(cells, k, max_distance, ident="cell_id", closed=True)
    types = cells.select(F.col("cell_id").alias("dst"), F.col("cell_type").alias("neighbour_type"))
    counted = keyed_join(edges, types, ["dst"]).groupBy(F.col("src").alias("cell_id"), "neighbour_type").agg(
        F.count(F.lit(1)).alias("freq")
    )
    if not normalize:
        return counted.withColumn("freq", F.col("freq").cast("double"))
    whole = F.sum("freq").over(Window.partitionBy("cell_id"))  # at most k rows per cell
    return counted.withColumn("freq", F.col("freq") / whole)


def type_shares(cells: DataFrame) -> DataFrame:
    """Relative frequency of each cell type."""
    n = cells.agg(F.count(F.lit(1))).scalar()
    return cells.groupBy("cell_type").agg((F.count(F.lit(1)) / n).alias("share"))


def likelihoods(reference: DataFrame) -> DataFrame:
    """``(type, gene, weight)`` with ``weight = pc * me``; the floor is added where it is used."""
    return reference.select(
        F.col("cell_type_name").alias("type"),
        F.col("gene_name").alias("gene"),
        (F.col("pc") * F.col("me")).alias("weight"),
    )


def contamination_scores(
    counts: DataFrame,
    cells: DataFrame,
    reference: DataFrame,
    *,
    n_neighbors: int = 10,
    max_neighbor_distance: float | None = 20.0,
    alpha_self: float = 0.8,
    alpha_neighbor: float = 0.15,
    alpha_background: float = 0.05,
    eps: float = 1e-6,
    cutoff: float = 0.5,
) -> DataFrame:
    """Per non-zero count: posterior shares of own type, neighbours and background.

    ``(cell_id, cell_type, feature_name, n, q_self, q_neighbor, q_background,
    contaminated)``.  Genes outside the reference get shares 0 and are never flagged; a
    host type outside the reference has likelihood ``eps``.
    """
    weight = likelihoods(reference)
    ref_types = weight.select("type").distinct()
    ref_genes = weight.select("gene").distinct().withColumn("_known", F.lit(True))
    typed = counts.join(cells.select("cell_id", "cell_type"), "cell_id")

    # Neighbours of another, reference-known type.
    freq = neighbour_frequencies(cells, n_neighbors, max_neighbor_distance)
    freq = freq.join(ref_types.withColumnRenamed("type", "neighbour_type"), "neighbour_type", "left_semi")
    freq = freq.join(cells.select("cell_id", "cell_type"), "cell_id").where(F.col("neighbour_type") != F.col("cell_type"))
    other = freq.groupBy("cell_id").agg(F.sum("freq").alias("_other"))
    neigh = (
        typed.select("cell_id", "feature_name")
        .join(freq.select("cell_id", "neighbour_type", "freq"), "cell_id")
        .join(
            weight.select(F.col("type").alias("neighbour_type"), F.col("gene").alias("feature_name"), "weight"),
            ["neighbour_type", "feature_name"],
        )
        .groupBy("cell_id", "feature_name")
        .agg(F.sum(F.col("freq") * F.col("weight")).alias("_neigh"))
    )

    shares = type_shares(cells).join(ref_types.withColumnRenamed("type", "cell_type"), "cell_type", "left_semi")
    share_sum = F.coalesce(shares.agg(F.sum("share")).scalar(), F.lit(0.0))
    back = (
        weight.join(shares.withColumnRenamed("cell_type", "type"), "type")
        .groupBy(F.col("gene").alias("feature_name"))
        .agg(F.sum(F.col("share") * F.col("weight")).alias("_back"))
    )
    own = weight.select(F.col("type").alias("cell_type"), F.col("gene").alias("feature_name"), F.col("weight").alias("_own"))

    full = (
        typed.join(own, ["cell_type", "feature_name"], "left")
        .join(neigh, ["cell_id", "feature_name"], "left")
        .join(other, "cell_id", "left")
        .join(back, "feature_name", "left")
        .join(ref_genes.withColumnRenamed("gene", "feature_name"), "feature_name", "left")
    )
    zero, floor = F.lit(0.0), F.lit(eps)
    p_self = F.coalesce("_own", zero) + floor
    p_neigh = F.coalesce("_neigh", zero) + floor * F.coalesce("_other", zero) + floor
    p_back = F.coalesce("_back", zero) + floor * share_sum + floor
    a, b, c = F.lit(alpha_self) * p_self, F.lit(alpha_neighbor) * p_neigh, F.lit(alpha_background) * p_back
    known = F.coalesce("_known", F.lit(False))
    scored = full.withColumn("_a", a).withColumn("_b", b).withColumn("_c", c)
    total = F.col("_a") + F.col("_b") + F.col("_c")

    def share(part: str) -> Column:
        return F.when(known, F.col(part) / total).otherwise(zero)

    return scored.select(
        "cell_id",
        "cell_type",
        "feature_name",
        "n",
        share("_a").alias("q_self"),
        share("_b").alias("q_neighbor"),
        share("_c").alias("q_background"),
        (known & (F.col("_a") / total < cutoff)).alias("contaminated"),
    )


def percent_contamination(scores: DataFrame) -> DataFrame:
    """``(cell_id, percent_contamination)``: flagged share of each cell's counts."""
    flagged = F.sum(F.when(F.col("contaminated"), F.col("n")).otherwise(F.lit(0)))
    return scores.groupBy("cell_id").agg(
        (F.lit(100.0) * flagged / F.greatest(F.sum("n"), F.lit(1))).alias("percent_contamination")
    )


def contamination_flow(scores: DataFrame, cells: DataFrame, reference: DataFrame) -> DataFrame:
    """``(source, host, percent)``: where flagged counts come from, as a mean over host cells.

    Each gene is split over donor types by reference weight.  The mean is over all cells
    of the host type, including those without flagged counts; a donor that gives a host
    nothing is listed with 0.
    """
    weight = likelihoods(reference)
    whole = F.sum("weight").over(Window.partitionBy("gene"))  # one row per type
    split = weight.withColumn("w", F.coalesce(F.try_divide(F.col("weight"), whole), F.lit(0.0)))
    library = scores.groupBy("cell_id").agg(F.greatest(F.sum("n"), F.lit(1)).alias("library"))
    flagged = scores.where("contaminated").join(library, "cell_id")
    given = (
        flagged.join(split.select(F.col("gene").alias("feature_name"), F.col("type").alias("source"), "w"), "feature_name")
        .groupBy("source", F.col("cell_type").alias("host"))
        .agg(F.sum(F.lit(100.0) * F.col("n") * F.col("w") / F.col("library")).alias("total"))
    )
    hosts = cells.groupBy(F.col("cell_type").alias("host")).agg(F.count(F.lit(1)).alias("n_cells"))
    # Every donor for every host: donors are gathered into one array (one entry per type).
    donors = weight.select(F.sort_array(F.collect_set("type"))).scalar()
    grid = hosts.withColumn("source", F.explode(donors))
    return grid.join(given, ["source", "host"], "left").select(
        "source", "host", (F.coalesce("total", F.lit(0.0)) / F.col("n_cells")).alias("percent")
    )
