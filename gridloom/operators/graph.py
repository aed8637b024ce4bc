"""Node tables, edge tables, partitioned graphs and negative edges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.sampling import uniform
from gridloom.operators.skew import keyed_join, sized
from gridloom.operators.standardize import reference_mask

# Null join keys are spread over this many values that match nothing.
NULL_SPREAD = 4096


def _spread_nulls(key: Column, ident: str) -> Column:
    return F.coalesce(key, F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(ident), F.lit(NULL_SPREAD)).cast("string")))


def training_points(points: DataFrame, genes: DataFrame, cells: DataFrame, mode: str = "nucleus") -> DataFrame:
    """Standard points with gene and cell codes and clusters.

    Points of dropped genes leave (inner join).  Only points under the reference mask
    keep a cell key; everything else gets a null encoding and cluster -1.
    """
    g = genes.select("feature_name", F.col("gene_encoding").cast("int"), F.col("cluster").cast("int").alias("gene_cluster"))
    c = cells.select(
        F.col("cell_id").alias("_key"),
        F.col("cell_encoding").cast("int"),
        F.col("cluster").cast("int").alias("cell_cluster"),
    )
    keyed = points.join(g, "feature_name").withColumn(
        "_key", _spread_nulls(F.when(reference_mask(F.col("cell_compartment"), mode), F.col("cell_id")), "row_index")
    )
    joined = keyed_join(keyed, c, ["_key"], "left").drop("_key")
    return joined.withColumn("cell_cluster", F.coalesce("cell_cluster", F.lit(-1))).select(
        "row_index",
        "x",
        "y",
        "feature_name",
        "cell_id",
        "cell_compartment",
        "cell_encoding",
        "gene_encoding",
        "cell_cluster",
        "gene_cluster",
    )


def training_polygons(polygons: DataFrame, cells: DataFrame, boundary_type: str | None = None) -> DataFrame:
    """Polygons of known cells with their code and cluster, in code order."""
    kept = polygons if boundary_type is None else polygons.where(F.col("boundary_type") == boundary_type)
    c = cells.select("cell_id", F.col("cell_encoding").cast("int"), F.col("cluster").cast("int").alias("cell_cluster"))
    return kept.join(c, "cell_id")


def reference_edges(points: DataFrame, mode: str = "nucleus") -> DataFrame:
    """``(src, dst)`` from each trusted point to its cell; points without a cell have no edge."""
    kept = points.where(reference_mask(F.col("cell_compartment"), mode) & F.col("cell_encoding").isNotNull())
    return kept.select(F.col("row_index").alias("src"), F.col("cell_encoding").cast("long").alias("dst"))


def typed_edges(neighbours: DataFrame, belongs: DataFrame, candidates: DataFrame) -> DataFrame:
    """The three edge stores as one table with ``edge_type``."""
    parts = []
    for name, edges in (("tx-tx", neighbours), ("tx-belongs-bd", belongs), ("tx-neighbors-bd", candidates)):
        parts.append(
            edges.select(F.lit(name).alias("edge_type"), F.col("src").cast("long"), F.col("dst").cast("long"))
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _attach(edges: DataFrame, nodes: DataFrame, end: str, columns: dict[str, str], how: str = "inner") -> DataFrame:
    """Join node columns to one end of the edges; a hub node is spread over several tasks."""
    side = nodes.select(F.col("id").alias(end), *[F.col(a).alias(b) for a, b in columns.items()])
    return keyed_join(edges, side, [end], how)


def partition_edges(edges: DataFrame, src_labels: DataFrame, dst_labels: DataFrame) -> DataFrame:
    """Edges inside one partition: ``(tile_id, src, dst)``; edges across partitions are dropped.

    Labels are ``(id, tile_id)``.
    """
    labelled = _attach(edges, src_labels, "src", {"tile_id": "_ts"})
    labelled = _attach(labelled, dst_labels, "dst", {"tile_id": "_td"})
    return labelled.where(F.col("_ts") == F.col("_td")).select(F.col("_ts").alias("tile_id"), "src", "dst")


def induced_edges(edges: DataFrame, src_context: DataFrame, dst_context: DataFrame) -> DataFrame:
    """Per tile, the edges whose two ends are both in the tile's context.

    Contexts are ``(tile_id, id)``; a node may be in several tiles.
    """
    left = _attach(edges, src_context, "src", {"tile_id": "tile_id"})
    right = dst_context.select("tile_id", F.col("id").alias("dst"))
    return keyed_join(left, right, ["tile_id", "dst"]).select("tile_id", "src", "dst")


def local_ids(nodes: DataFrame, ident: str, *, tile: str = "tile_id") -> DataFrame:
    """Position of each node inside its partition (partitions are bounded by the tiling)."""
    return nodes.withColumn("local_id", F.row_number().over(Window.partitionBy(tile).orderBy(ident)) - 1)


def localise_edges(edges: DataFrame, src_nodes: DataFrame, dst_nodes: DataFrame) -> DataFrame:
    """Replace global ids by local ones.  Nodes are ``(tile_id, id, local_id)``."""
    s = src_nodes.select("tile_id", F.col("id").alias("src"), F.col("local_id").alias("local_src"))
    d = dst_nodes.select("tile_id", F.col("id").alias("dst"), F.col("local_id").alias("local_dst"))
    return edges.join(s, ["tile_id", "src"]).join(d, ["tile_id", "dst"])


def fetch_partition(table: DataFrame, index: int, n_partitions: int, *, part: str = "tile_id") -> DataFrame:
    """Rows of one partition, for partitions numbered 0..n-1; negative indices count from the end."""
    if not -n_partitions <= index < n_partitions:
        raise IndexError(f"partition {index} is out of range for {n_partitions} partitions")
    return table.where(F.col(part) == (index + n_partitions if index < 0 else index))


def check_partition(nodes: DataFrame, labels: DataFrame) -> None:
    """Every node has exactly one label and no label names an unknown node."""
    per_id = labels.groupBy("id").count()
    if per_id.where(F.col("count") > 1).limit(1).count():
        raise ValueError("a node has more than one partition label")
    if nodes.join(labels, "id", "left_anti").limit(1).count():
        raise ValueError("a node has no partition label")
    if labels.join(nodes, "id", "left_anti").limit(1).count():
        raise ValueError("a partition label names an unknown node")


def check_same_partitions(node_labels: dict[str, DataFrame]) -> int:
    """All node types use the same number of partitions; returns it."""
    found = {k: (v.agg(F.max("tile_id")).first()[0] or 0) + 1 for k, v in node_labels.items()}
    if len(set(found.values())) > 1:
        raise ValueError(f"node types disagree on the number of partitions: {found}")
    return next(iter(found.values()))


def add_node_attribute(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """Join an attribute table ``(id, ...)`` to partitioned nodes."""
    return nodes.join(values, "id", "left")


def permutation(nodes: DataFrame, sizes: DataFrame, ident: str, *, tile: str = "tile_id") -> DataFrame:
    """New position of every node when nodes are ordered by partition: offset + local id."""
    return local_ids(nodes, ident, tile=tile).join(sizes.select(tile, "offset"), tile).withColumn(
        "new_id", F.col("offset") + F.col("local_id")
    )


def negative_edges(edges: DataFrame, ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """Non-edges drawn by hash, about ``ratio`` per positive edge.

    A draw keeps the source of a positive edge and takes a destination in
    ``0..max(dst)``; draws that are edges, or repeat another draw, are left out.  ``edges``
    is read several times, so it should be a written table.
    """
    whole, part = int(ratio), ratio - int(ratio)
    edges = edges.select("src", "dst")
    n_edges, top = edges.agg(F.count(F.lit(1)), F.max("dst")).first()
    # What a task draws waits in its memory for the exchange; splits of a file would grow with the table.
    edges = sized(edges, n_edges, "src", "dst")
    draws = edges.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(whole))))
    draws = draws.where((F.col("_draw") < whole) | (uniform("src", "dst", seed=seed) < part))
    n_dst = F.lit((top or 0) + 1)
    drawn = draws.select("src", F.pmod(F.xxhash64("src", "dst", "_draw", F.lit(seed)), n_dst).cast("long").alias("dst"))
    # Repeats and edges leave in one aggregation of draws and edges together; an edge without an end marks nothing.
    marks = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).withColumn("_edge", F.lit(True))
    both = drawn.withColumn("_edge", F.lit(False)).unionByName(marks)
    once = sized(both, math.ceil(n_edges * (1 + ratio)), "src", "dst").groupBy("src", "dst").agg(F.bool_or("_edge").alias("_edge"))
    return once.where(~F.col("_edge")).select("src", "dst")
