"""Gene and cell embeddings from the correlation / covariance of a gene panel.

The only matrices that reach the driver are panel x panel: their size depends on
the number of genes measured, not on cells or points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.matrix import gene_moments

# Largest panel whose square matrix is taken to the driver (20,000 genes = 3.2 GB).
MAX_PANEL = 20_000


def _panel(norm: DataFrame, feature: str) -> list[str]:
    genes = [r[0] for r in norm.select(feature).distinct().orderBy(feature).limit(MAX_PANEL + 1).collect()]
    if len(genes) > MAX_PANEL:
        raise ValueError(f"more than {MAX_PANEL} genes: embed a filtered panel")
    return genes


def _moment_matrices(norm: DataFrame, n_cells: Column, genes: list[str], cell: str, feature: str):
    table = gene_moments(norm, n_cells, cell=cell, feature=feature).toPandas()
    at = {g: i for i, g in enumerate(genes)}
    size = len(genes)
    products, sums, n = np.zeros((size, size)), np.zeros(size), 0.0
    if len(table):
        ia, ib = table["gene_a"].map(at).to_numpy(), table["gene_b"].map(at).to_numpy()
        products[ia, ib] = table["sxy"]
        products[ib, ia] = table["sxy"]
        sums[ia] = table["sa"]
        n = float(table["cells"].iloc[0])
    return products, sums, n


def correlation_matrix(norm: DataFrame, n_cells: Column, genes: list[str], *, cell="cell_id", feature="feature_name"):
    """Dense correlation over ``genes``; undefined entries are 0."""
    products, sums, n = _moment_matrices(norm, n_cells, genes, cell, feature)
    if n == 0:
        return np.zeros((len(genes), len(genes)))
    cov = products - np.outer(sums, sums) / n
    var = np.diag(cov).copy()
    var[var <= np.diag(products) * 1e-12] = 0.0
    scale = np.sqrt(np.outer(var, var))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.where(scale > 0, cov / scale, 0.0)
    return np.clip(r, -1.0, 1.0)


def _fix_signs(components: np.ndarray) -> np.ndarray:
    """Make the largest entry of each component positive, so results are repeatable."""
    peak = components[np.abs(components).argmax(axis=0), np.arange(components.shape[1])]
    return components * np.where(peak < 0, -1.0, 1.0)


def principal_components(centred_gram: np.ndarray, k: int) -> np.ndarray:
    """Leading eigenvectors (columns) of a symmetric scatter matrix."""
    values, vectors = np.linalg.eigh(centred_gram)
    order = np.argsort(values)[::-1][: min(k, len(values))]
    return _fix_signs(vectors[:, order])


def gene_embedding(
    norm: DataFrame, n_cells: Column, k: int = 128, *, cell: str = "cell_id", feature: str = "feature_name"
) -> DataFrame:
    """PCA scores of the rows of the gene correlation matrix: ``(feature, embedding)``."""
    genes = _panel(norm, feature)
    r = correlation_matrix(norm, n_cells, genes, cell=cell, feature=feature)
    centred = r - r.mean(axis=0)
    scores = centred @ principal_components(centred.T @ centred, k)
    rows = pd.DataFrame({feature: genes, "embedding": [v.astype(float).tolist() for v in scores]})
    return norm.sparkSession.createDataFrame(rows, f"`{feature}` string, embedding array<double>")


def cell_embedding(
    norm: DataFrame, n_kept: Column, k: int = 128, *, cell: str = "cell_id", feature: str = "feature_name"
) -> DataFrame:
    """PCA fitted on kept cells, applied to all cells: ``(cell, embedding)``.

    ``norm`` has a boolean ``filtered`` column.  A cell's row is gathered as a sparse
    list of at most panel-size entries and projected in Arrow batches.
    """
    genes = _panel(norm, feature)
    products, sums, n = _moment_matrices(norm.where("filtered"), n_kept, genes, cell, feature)
    mean = sums / max(n, 1.0)
    components = principal_components(products - n * np.outer(mean, mean), k)
    offset = mean @ components
    spark = norm.sparkSession
    codes = spark.createDataFrame(
        pd.DataFrame({feature: genes, "_g": np.arange(len(genes), dtype="int32")}), f"`{feature}` string, _g int"
    )
    shared = spark.sparkContext.broadcast((components, offset))

    @F.pandas_udf("array<double>")
    def project(entries: pd.Series) -> pd.Series:
        basis, shift = shared.value
        lengths = entries.map(len).to_numpy()
        ids = np.concatenate([[e["_g"] for e in row] for row in entries] or [np.empty(0)]).astype(int)
        values = np.concatenate([[e["norm"] for e in row] for row in entries] or [np.empty(0)])
        owner = np.repeat(np.arange(len(lengths)), lengths)
        out = np.zeros((len(lengths), basis.shape[1]))
        np.add.at(out, owner, values[:, None] * basis[ids])
        return pd.Series(list(out - shift))

    # The code table has one row per gene, at most MAX_PANEL.
    gathered = norm.join(F.broadcast(codes), feature).groupBy(cell).agg(F.collect_list(F.struct("_g", "norm")).alias("_row"))
    return gathered.select(cell, project(F.col("_row")).alias("embedding"))
