"""Cell x gene counts, totals, depth normalisation and correlation (long / COO form)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Genes along a side of a block of the Gram matrix; entries and cells that a task multiplies together.
GRAM_BLOCK = 512
HELD_ENTRIES, HELD_CELLS = 1 << 20, 8192


def count_matrix(points: DataFrame, *, cell: str = "cell_id", feature: str = "feature_name") -> DataFrame:
    """``(cell, feature, n)`` for assigned points."""
    return (
        points.where(F.col(cell).isNotNull() & F.col(feature).isNotNull())
        .groupBy(cell, feature)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def mean_score_layer(points: DataFrame, score: str, *, cell: str = "cell_id", feature: str = "feature_name") -> DataFrame:
    """Mean score of the points of each (cell, feature)."""
    return (
        points.where(F.col(cell).isNotNull() & F.col(feature).isNotNull())
        .groupBy(cell, feature)
        .agg(F.avg(score).alias("mean_score"))
    )


def centroids(points: DataFrame, *, cell: str = "cell_id", x: str = "x", y: str = "y") -> DataFrame:
    return points.where(F.col(cell).isNotNull()).groupBy(cell).agg(F.avg(x).alias("x"), F.avg(y).alias("y"))


def totals(counts: DataFrame, key: str, n: str = "n", name: str = "n_counts") -> DataFrame:
    return counts.groupBy(key).agg(F.sum(n).alias(name))


def keep_genes(counts: DataFrame, min_counts: int = 100, *, feature: str = "feature_name") -> DataFrame:
    """Drop genes whose total is below ``min_counts``."""
    kept = totals(counts, feature).where(F.col("n_counts") >= min_counts).select(feature)
    return counts.join(kept, feature, "left_semi")


def cell_totals(counts: DataFrame, min_counts: int = 10, *, cell: str = "cell_id") -> DataFrame:
    """``(cell, n_counts, filtered)``; ``filtered`` marks cells with enough counts."""
    return totals(counts, cell).withColumn("filtered", F.col("n_counts") >= min_counts)


def exact_median(df: DataFrame, value: str) -> Column:
    """Interpolated median as a scalar subquery.

    Values are first counted per distinct value; for integer totals that table has at
    most sqrt(2 * sum) rows, so the last step stays small.
    """
    frequency = df.groupBy(value).agg(F.count(F.lit(1)).alias("_f"))
    return frequency.agg(F.percentile(value, F.lit(0.5), F.col("_f"))).scalar()


def depth_normalize(counts: DataFrame, cells: DataFrame, *, cell: str = "cell_id") -> DataFrame:
    """Add ``norm = n * median / total``; the median is over kept cells, all cells are scaled."""
    median = exact_median(cells.where("filtered"), "n_counts")
    return (
        counts.join(cells.select(cell, "n_counts", "filtered"), cell)
        .withColumn("norm", F.col("n") * median / F.col("n_counts"))
        .drop("n_counts")
    )


def check_reference_genes(
    counts: DataFrame, reference: DataFrame, strategy: str = "error", min_counts: int = 100, *, feature: str = "feature_name"
) -> DataFrame:
    """Compare the sample's genes with an external reference matrix.

    ``remove`` drops the genes the reference lacks, ``error`` refuses them.  Reference
    genes in use must reach ``min_counts`` and hold whole counts.
    """
    if strategy == "fill":
        raise NotImplementedError("gene_missing_strategy='fill' is not available")
    if strategy not in ("error", "remove"):
        raise ValueError(f"unknown gene_missing_strategy: {strategy!r}")
    if reference.where(F.col("n") != F.floor("n")).limit(1).count():
        raise ValueError("the reference must hold raw counts, but it has fractional values")
    genes, known = counts.select(feature).distinct(), reference.select(feature).distinct()
    missing = genes.join(known, feature, "left_anti")
    named = [r[0] for r in missing.orderBy(feature).limit(6).collect()]
    if named and strategy == "error":
        shown = ", ".join(named[:5]) + (", ..." if len(named) > 5 else "")
        raise ValueError(f"the correlation reference lacks {missing.count()} genes: {shown}")
    low = totals(reference.join(genes, feature, "left_semi"), feature).where(F.col("n_counts") < min_counts)
    weak = [r[0] for r in low.orderBy(feature).limit(5).collect()]
    if weak:
        raise ValueError(f"reference genes below {min_counts} counts: {', '.join(weak)}")
    return counts.join(known, feature, "left_semi") if named else counts


def _block_products(cells: int, owner: np.ndarray, gene: np.ndarray, value: np.ndarray, genes: int, block: int):
    """Nonempty entries ``(a, b, sum)`` with ``a <= b`` of the Gram matrix of sparse cells, block pair by block pair."""
    order = np.argsort(gene, kind="stable")
    owner, gene, value = owner[order], gene[order], value[order]
    edges = np.searchsorted(gene, np.arange(0, genes + block, block))
    # Where a product can vanish, presence is counted beside it.
    signed = bool((value <= 0).any())

    def dense(i: int, what: np.ndarray) -> np.ndarray:
        a, b = edges[i], edges[i + 1]
        out = np.zeros((cells, min(block, genes - i * block)))
        out[owner[a:b], gene[a:b] - i * block] = what[a:b]
        return out

    there = np.ones(len(value))
    for i in range(len(edges) - 1):
        left = dense(i, value)
        here = dense(i, there) if signed else None
        for j in range(i, len(edges) - 1):
            sums = left.T @ dense(j, value)
            met = (here.T @ dense(j, there)) if signed else sums
            a, b = np.nonzero(met)
            keep = (a + i * block <= b + j * block)
            a, b = a[keep], b[keep]
            yield a + i * block, b + j * block, sums[a, b]


def gene_products(norm: DataFrame, *, cell: str = "cell_id", feature: str = "feature_name", block: int = GRAM_BLOCK) -> DataFrame:
    """``(gene_a, gene_b, sxy)`` of genes that share a cell, ``gene_a <= gene_b``.

    Cells are rows of sparse entries; a task multiplies blocks of genes over all its cells and passes on sums
    of pairs, so what is shuffled is bounded by the square of the panel a task, not by the counts.
    """
    entry = F.struct(F.col(feature).cast("string").alias("g"), F.col("norm").cast("double").alias("v"))
    rows = norm.where(F.col(feature).isNotNull()).groupBy(cell).agg(F.collect_list(entry).alias("_row")).select("_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, pa.Array, np.ndarray]] = []
        entries = cells = 0

        def flush() -> Iterator[pa.RecordBatch]:
            names = pa.chunked_array([x[2] for x in held]).combine_chunks().dictionary_encode()
            shift = np.cumsum([0, *(x[0] for x in held)])
            owner = np.concatenate([x[1] + at for x, at in zip(held, shift)])
            # Genes by name, so that a pair has its smaller name first.
            words = names.dictionary.to_pylist()
            place = np.argsort(sorted(range(len(words)), key=words.__getitem__))
            gene = place[np.asarray(names.indices)]
            ordered = pa.array(sorted(words))
            for a, b, total in _block_products(int(shift[-1]), owner, gene, np.concatenate([x[3] for x in held]), len(words), block):
                yield pa.RecordBatch.from_arrays([ordered.take(pa.array(a)), ordered.take(pa.array(b)), pa.array(total)], ["gene_a", "gene_b", "sxy"])

        for batch in batches:
            row = batch.column(0)
            offs = np.asarray(row.offsets)
            flat = row.flatten()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offs))
            held.append((batch.num_rows, owner, flat.field(0), np.asarray(flat.field(1).fill_null(0.0))))
            entries, cells = entries + len(flat), cells + batch.num_rows
            if entries >= HELD_ENTRIES or cells >= HELD_CELLS:
                yield from flush()
                held, entries, cells = [], 0, 0
        if entries:
            yield from flush()

    return rows.mapInArrow(run, "gene_a string, gene_b string, sxy double").groupBy("gene_a", "gene_b").agg(F.sum("sxy").alias("sxy"))


def gene_moments(norm: DataFrame, n_cells: Column, *, cell: str = "cell_id", feature: str = "feature_name") -> DataFrame:
    """``(gene_a, gene_b, sxy, sa, sb, saa, sbb, cells)`` for ``gene_a <= gene_b``.

    Sparse Gram matrix: zeros contribute nothing to the products and enter through the cell count.  A cell
    holds each gene once.
    """
    cross = gene_products(norm, cell=cell, feature=feature)
    value = norm.select(F.col(feature).alias("g"), F.col("norm").alias("v"))
    single = value.groupBy("g").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"))
    left = single.select(F.col("g").alias("gene_a"), F.col("s").alias("sa"), F.col("ss").alias("saa"))
    right = single.select(F.col("g").alias("gene_b"), F.col("s").alias("sb"), F.col("ss").alias("sbb"))
    return cross.join(left, "gene_a").join(right, "gene_b").withColumn("cells", n_cells.cast("double"))


def gene_correlation(
    norm: DataFrame, n_cells: Column, *, cell: str = "cell_id", feature: str = "feature_name"
) -> DataFrame:
    """Pearson correlation of genes over all kept cells, zeros included.

    Returned for pairs that share a cell (``gene_a <= gene_b``).  A pair that never
    shares one has ``sxy = 0``; ``correlation_matrix`` fills those in.  An undefined
    value is 0, an infinite one 1.
    """
    m = gene_moments(norm, n_cells, cell=cell, feature=feature)
    n = F.col("cells")
    num = n * F.col("sxy") - F.col("sa") * F.col("sb")
    va, vb = n * F.col("saa") - F.col("sa") * F.col("sa"), n * F.col("sbb") - F.col("sb") * F.col("sb")
    # A variance this far below its own terms is rounding noise of a constant gene.
    flat = (va <= n * F.col("saa") * 1e-12) | (vb <= n * F.col("sbb") * 1e-12)
    r = F.when(flat, F.lit(0.0)).otherwise(num / F.nullif(F.sqrt(va) * F.sqrt(vb), F.lit(0.0)))
    return m.select("gene_a", "gene_b", F.coalesce(r, F.lit(0.0)).alias("r"))


def join_exactly_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join that fails unless every left row has exactly one match on the right."""
    matches = right.withColumn("_hits", F.count(F.lit(1)).over(Window.partitionBy(key)))
    joined = left.join(matches, key, "left")
    message = F.concat(F.lit("expected exactly one match for key "), F.col(key).cast("string"))
    checked = F.when(F.col("_hits") == 1, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return joined.where(checked).drop("_hits")
