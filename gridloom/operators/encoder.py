"""Forward pass of the graph attention encoder over DataFrames.

Dense layers run as Arrow-batched matrix products with broadcast weights, whose size
depends on the layer widths and the gene panel only.  Message passing is joins and
built-in sums: soft-max numerators and weighted features are partially aggregated
before the shuffle, so a node with very many edges costs no more than its share.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.vectors import sinusoidal
from gridloom.operators.blocks import lists
from gridloom.operators.skew import keyed_join

# Negative slope of the attention and width of the position code.
LEAKY_SLOPE = 0.2
POSITION_FREQUENCIES = 256
NODE_TYPES = ("tx", "bd")
# Edge kinds with messages: (name, source type, destination type).
EDGE_KINDS = (("tx-tx", "tx", "tx"), ("tx-belongs-bd", "tx", "bd"))


@dataclass
class EncoderWeights:
    """All parameters as numpy arrays."""

    gene: np.ndarray
    cell: tuple[np.ndarray, np.ndarray]
    position: list[tuple[np.ndarray, np.ndarray]]
    layers: list[dict[str, dict[str, np.ndarray]]] = field(default_factory=list)
    last: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    n_heads: int = 2
    use_positions: bool = True
    normalize: bool = True


def initial_weights(
    n_genes: int,
    cell_size: int,
    *,
    in_channels: int = 16,
    hidden_channels: int = 64,
    out_channels: int = 64,
    n_mid_layers: int = 2,
    n_heads: int = 2,
    use_positions: bool = True,
    normalize: bool = True,
    gene_embedding: np.ndarray | None = None,
    frequency_size: int = POSITION_FREQUENCIES,
    seed: int = 0,
) -> EncoderWeights:
    """Glorot-uniform weights from a seed; ``gene_embedding`` replaces the gene table."""
    rng = np.random.default_rng(seed)

    def glorot(a: int, b: int) -> np.ndarray:
        bound = math.sqrt(6.0 / (a + b))
        return rng.uniform(-bound, bound, (a, b))

    half = in_channels // 2
    gene = rng.normal(size=(n_genes, in_channels)) if gene_embedding is None else np.asarray(gene_embedding, dtype=float)
    weights = EncoderWeights(
        gene=gene,
        cell=(glorot(cell_size, gene.shape[1]), np.zeros(gene.shape[1])),
        position=[
            (glorot(frequency_size, half), np.zeros(half)),
            (glorot(half, half), np.zeros(half)),
        ],
        n_heads=n_heads,
        use_positions=use_positions,
        normalize=normalize,
    )
    width = gene.shape[1] + (2 * half if use_positions else 0)
    for channels in [hidden_channels] * (n_mid_layers + 1) + [out_channels]:
        layer = {}
        for kind, _, _ in EDGE_KINDS:
            layer[kind] = {
                "left": glorot(width, channels * n_heads),
                "left_bias": np.zeros(channels * n_heads),
                "right": glorot(width, channels * n_heads),
                "right_bias": np.zeros(channels * n_heads),
                "attention": glorot(n_heads, channels),
                "bias": np.zeros(channels * n_heads),
            }
        weights.layers.append(layer)
        width = channels * n_heads
    weights.last = {t: (glorot(width, out_channels), np.zeros(out_channels)) for t in NODE_TYPES}
    return weights


def _matrix(column: pa.Array) -> np.ndarray:
    _, values = lists(column)
    return np.asarray(values, float).reshape(len(column), -1)


def _vectors(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * np.int32(m.shape[1])), pa.array(m.ravel()))


def _dense(df: DataFrame, source: str, target: str, w: np.ndarray, b: np.ndarray) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast((w, b))

    @F.arrow_udf("array<double>")
    def apply(v: pa.Array) -> pa.Array:
        weight, bias = shared.value
        return _vectors(_matrix(v) @ weight + bias if len(v) else np.empty((0, len(bias))))

    return df.withColumn(target, apply(F.col(source).cast("array<double>")))


def _map(v: Column, f) -> Column:
    return F.transform(v, f)


def gelu(v: Column) -> Column:
    """Exact GELU needs erf; the maximum error of this rational form is 1.5e-7 (Abramowitz & Stegun 7.1.26)."""

    def one(x):
        z = F.abs(x) / F.lit(math.sqrt(2.0))
        t = 1.0 / (1.0 + 0.3275911 * z)
        poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
        erf = F.signum(x) * (1.0 - poly * F.exp(-z * z))
        return 0.5 * x * (1.0 + erf)

    return _map(v, one)


def _scaled(nodes: DataFrame, tile: str = "tile_id") -> DataFrame:
    """Add ``px, py``: the coordinates, min-max scaled inside each tile."""
    bounds = nodes.groupBy(tile).agg(
        F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1")
    )

    def scaled(axis: str) -> Column:
        return (F.col(axis) - F.col(f"_{axis}0")) / (F.col(f"_{axis}1") - F.col(f"_{axis}0") + F.lit(1e-8))

    return nodes.join(bounds, tile).withColumn("px", scaled("x")).withColumn("py", scaled("y")).drop("_x0", "_x1", "_y0", "_y1")


def position_codes(nodes: DataFrame, tile: str = "tile_id", size: int = POSITION_FREQUENCIES) -> DataFrame:
    """Add ``px, py``: sinusoidal codes of the coordinates, min-max scaled inside each tile."""
    scaled = _scaled(nodes, tile)
    return scaled.withColumn("px", sinusoidal(F.col("px"), size)).withColumn("py", sinusoidal(F.col("py"), size))


def _position(v: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Two dense layers over the sinusoidal code of scaled coordinates."""
    (w1, b1), (w2, b2) = layers
    half = w1.shape[0] // 2
    angle = v[:, None] * np.exp(-math.log(10000.0) * np.arange(half) / half)
    hidden = np.concatenate([np.cos(angle), np.sin(angle)], axis=1) @ w1 + b1
    return hidden / (1.0 + np.exp(-hidden)) @ w2 + b2


def _first_layer(nodes: DataFrame, source: str, weights: EncoderWeights) -> DataFrame:
    """Add ``h``: the gene's row or the dense layer of the cell's features, and the positions.

    One Python step: every step of its own in a chain would cost a task one more Python process.
    """
    shared = nodes.sparkSession.sparkContext.broadcast(
        ((weights.gene,) if source == "gene_encoding" else weights.cell, weights.position if weights.use_positions else None)
    )

    @F.arrow_udf("array<double>")
    def apply(v: pa.Array, px: pa.Array, py: pa.Array) -> pa.Array:
        first, position = shared.value
        if not len(v):
            return _vectors(np.empty((0, 1)))
        h = first[0][np.asarray(v, int)] if len(first) == 1 else _matrix(v) @ first[0] + first[1]
        if position is not None:
            h = np.concatenate([h, *(_position(np.asarray(p, float), position) for p in (px, py))], axis=1)
        return _vectors(h)

    placed = _scaled(nodes) if weights.use_positions else nodes.withColumn("px", F.col("x")).withColumn("py", F.col("y"))
    value = F.col(source) if source == "gene_encoding" else F.col(source).cast("array<double>")
    return placed.withColumn("h", apply(value, "px", "py")).drop("px", "py")


def attention_edges(
    edges: DataFrame, src: DataFrame, dst: DataFrame, w: dict[str, np.ndarray], n_heads: int
) -> DataFrame:
    """``(tile_id, src, dst, left, a)``: source features and one unnormalised weight per head.

    GATv2 scores ``att . leaky_relu(W_l h_src + W_r h_dst)``; the largest score of each
    destination is subtracted before the exponential.
    """
    channels = w["left"].shape[1] // n_heads
    left = _dense(src, "h", "left", w["left"], w["left_bias"]).select("tile_id", F.col("id").alias("src"), "left")
    right = _dense(dst, "h", "right", w["right"], w["right_bias"]).select("tile_id", F.col("id").alias("dst"), "right")
    joined = keyed_join(edges.join(left, ["tile_id", "src"]), right, ["tile_id", "dst"])
    att = w["attention"]

    def score(h: int) -> Column:
        lo = h * channels + 1
        mixed = F.zip_with(F.slice("left", lo, channels), F.slice("right", lo, channels), lambda p, q: p + q)
        leaky = _map(mixed, lambda v: F.when(v >= 0, v).otherwise(v * LEAKY_SLOPE))
        terms = F.zip_with(leaky, F.array(*[F.lit(float(x)) for x in att[h]]), lambda p, q: p * q)
        return F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v)

    scored = joined.select("tile_id", "src", "dst", "left", *[score(h).alias(f"s{h}") for h in range(n_heads)])
    top = scored.groupBy("tile_id", "dst").agg(*[F.max(f"s{h}").alias(f"m{h}") for h in range(n_heads)])
    shifted = keyed_join(scored, top, ["tile_id", "dst"])
    weights = F.array(*[F.exp(F.col(f"s{h}") - F.col(f"m{h}")) for h in range(n_heads)])
    return shifted.select("tile_id", "src", "dst", "left", weights.alias("a"))


def attention_weights(weighted: DataFrame) -> DataFrame:
    """Soft-maxed weight of every edge and head: ``(tile_id, src, dst, head, weight)``."""
    long = weighted.select("tile_id", "src", "dst", F.posexplode("a").alias("head", "a"))
    total = long.groupBy("tile_id", "dst", "head").agg(F.sum("a").alias("t"))
    joined = keyed_join(long, total, ["tile_id", "dst", "head"])
    return joined.select("tile_id", "src", "dst", "head", (F.col("a") / F.col("t")).alias("weight"))


def attention_layer(
    edges: DataFrame, src: DataFrame, dst: DataFrame, w: dict[str, np.ndarray], n_heads: int
) -> DataFrame:
    """New features ``(tile_id, id, m)`` of every destination node; without edges it is the bias."""
    size = w["left"].shape[1]
    channels = size // n_heads
    weighted = attention_edges(edges, src, dst, w, n_heads)
    sums = [F.sum(F.get("a", F.lit(i // channels)) * F.get("left", F.lit(i))).alias(f"v{i}") for i in range(size)]
    norms = [F.sum(F.get("a", F.lit(h))).alias(f"t{h}") for h in range(n_heads)]
    pooled = weighted.groupBy("tile_id", "dst").agg(*sums, *norms)
    bias = w["bias"]
    value = F.array(*[F.col(f"v{i}") / F.col(f"t{i // channels}") + F.lit(float(bias[i])) for i in range(size)])
    got = pooled.select("tile_id", F.col("dst").alias("id"), value.alias("m"))
    alone = F.array(*[F.lit(float(v)) for v in bias])
    return dst.select("tile_id", "id").join(got, ["tile_id", "id"], "left").withColumn("m", F.coalesce("m", alone))


def encode(
    tx: DataFrame, bd: DataFrame, edges: DataFrame, weights: EncoderWeights, materialise=lambda df: df
) -> dict[str, DataFrame]:
    """Embeddings ``(tile_id, id, embedding)`` of points and cells.

    ``tx`` is ``(tile_id, id, x, y, gene_encoding)``, ``bd`` is ``(tile_id, id, x, y,
    features)`` and ``edges`` is ``(tile_id, edge_type, src, dst)``.  ``materialise`` is
    called on the node tables after every layer - pass ``session.cut_lineage`` for deep
    stacks.
    """
    nodes = {"tx": _first_layer(tx, "gene_encoding", weights), "bd": _first_layer(bd, "features", weights)}
    for t in NODE_TYPES:
        nodes[t] = materialise(nodes[t].select("tile_id", "id", gelu(F.col("h")).alias("h")))
    for layer in weights.layers:
        fresh = {}
        for kind, a, b in EDGE_KINDS:
            chosen = edges.where(F.col("edge_type") == kind).select("tile_id", "src", "dst")
            out = attention_layer(chosen, nodes[a], nodes[b], layer[kind], weights.n_heads)
            fresh[b] = out.select("tile_id", "id", gelu(F.col("m")).alias("h"))
        nodes = {t: materialise(df) for t, df in fresh.items()}
    result = {}
    for t in NODE_TYPES:
        last = _dense(nodes[t], "h", "e", *weights.last[t])
        if weights.normalize:
            length = F.sqrt(F.aggregate(_map(F.col("e"), lambda v: v * v), F.lit(0.0), lambda acc, v: acc + v))
            last = last.withColumn("_n", F.greatest(length, F.lit(1e-12)))
            last = last.withColumn("e", F.transform("e", lambda v: v / F.col("_n")))
        result[t] = last.select("tile_id", "id", F.col("e").alias("embedding"))
    return result

