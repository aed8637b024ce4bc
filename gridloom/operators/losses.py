"""Triplet sampling and training losses as deterministic aggregates.

``labelled`` is ``(id, label, embedding)``; ``similarity`` is ``(a, b, sim)`` over labels.
Draws come from ``sampling.uniform`` of the anchor id, so a loss is repeatable.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.vectors import cosine, distance, dot
from gridloom.operators.numbering import position_in_group
from gridloom.operators.sampling import uniform
from gridloom.operators.skew import keyed_join
from gridloom.operators.vector_pairs import blocks_pay, measure_pairs
from gridloom.session import cut_lineage


def cluster_cdf(similarity: DataFrame, present: DataFrame, negative: bool = False) -> DataFrame:
    """``(a, b, upper)``: cumulative probability of drawing cluster ``b`` for an anchor in ``a``.

    Weights are the similarities (its own cluster counts 1), or their negatives, floored
    at 1e-8 and restricted to clusters that occur.  The last bound is exactly 1.
    """
    sim = F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(F.col("sim"))
    weight = F.greatest(-sim if negative else sim, F.lit(1e-8))
    kept = (
        similarity.join(present.select(F.col("label").alias("a")), "a", "left_semi")
        .join(present.select(F.col("label").alias("b")), "b", "left_semi")
        .withColumn("w", weight)
    )
    row = Window.partitionBy("a")
    upto = row.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("b") == F.max("b").over(row)
    share = F.sum("w").over(upto) / F.sum("w").over(row)
    return kept.select("a", "b", F.when(last, F.lit(1.0)).otherwise(share).alias("upper"))


def _pick_cluster(anchors: DataFrame, cdf: DataFrame, draw, name: str) -> DataFrame:
    """Add the drawn cluster: first bound not below the draw.  One array per anchor label."""
    steps = cdf.groupBy(F.col("a").alias("label")).agg(
        F.array_sort(F.collect_list(F.struct("upper", "b"))).alias("_steps")
    )
    chosen = F.filter("_steps", lambda s: s["upper"] >= F.col("_u"))[0]["b"]
    return anchors.withColumn("_u", draw).join(steps, "label").withColumn(name, chosen).drop("_steps", "_u")


def sample_triplets(labelled: DataFrame, similarity: DataFrame, seed: int = 0) -> DataFrame:
    """``(id, label, positive, positive_label, negative, negative_label)`` per anchor.

    A cluster is drawn first, then a member of it uniformly.
    """
    members = position_in_group(labelled.select("id", "label"), "label", "id", "pos")
    sizes = members.groupBy("label").agg(F.max("pos_of").alias("size"))
    anchors = labelled.select("id", "label")
    for offset, kind in ((0, "positive"), (1, "negative")):
        cdf = cluster_cdf(similarity, sizes, negative=kind == "negative")
        anchors = _pick_cluster(anchors, cdf, uniform("id", seed=seed * 10 + offset), f"{kind}_label")
        sized = anchors.join(sizes.withColumnRenamed("label", f"{kind}_label"), f"{kind}_label")
        place = F.floor(uniform("id", seed=seed * 10 + 4 + offset) * F.col("size")).cast("long")
        slots = members.select(
            F.col("label").alias(f"{kind}_label"), F.col("pos").alias("_p"), F.col("id").alias(kind)
        )
        anchors = sized.withColumn("_p", place).drop("size").join(slots, [f"{kind}_label", "_p"]).drop("_p")
    return anchors.select("id", "label", "positive", "positive_label", "negative", "negative_label")


def stratified_anchors(labelled: DataFrame, seed: int = 0) -> DataFrame:
    """As many anchors from every cluster as the (rounded) mean cluster size.

    Larger clusters give a hash sample without replacement; smaller ones repeat members
    in turn.  Column ``copy`` tells the repeats apart.
    """
    placed = position_in_group(
        labelled.select("id", "label").withColumn("_h", uniform("id", seed=seed)), "label", "_h", "pos"
    )
    sizes = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    target = sizes.agg(F.greatest(F.round(F.avg("n")).cast("long"), F.lit(1).cast("long"))).scalar()
    copies = F.floor((target - F.col("pos") - 1) / F.col("pos_of")).cast("long")
    return (
        placed.withColumn("_target", target)
        .where(F.col("pos") < F.col("_target"))
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies)))
        .select("id", "label", "copy")
    )


def _vectors(triplets: DataFrame, labelled: DataFrame) -> DataFrame:
    table = labelled.select("id", "embedding")
    return (
        triplets.join(table.withColumnRenamed("embedding", "_a"), "id")
        .join(table.select(F.col("id").alias("positive"), F.col("embedding").alias("_p")), "positive")
        .join(table.select(F.col("id").alias("negative"), F.col("embedding").alias("_n")), "negative")
    )


def triplet_loss(triplets: DataFrame, labelled: DataFrame, margin: float = 1.0) -> DataFrame:
    """One row ``loss``: mean of ``max(0, |a-p| - |a-n| + margin)``; 0 without anchors."""
    gap = distance(F.col("_a"), F.col("_p")) - distance(F.col("_a"), F.col("_n")) + F.lit(margin)
    return _vectors(triplets, labelled).agg(F.coalesce(F.avg(F.greatest(gap, F.lit(0.0))), F.lit(0.0)).alias("loss"))


def metric_loss(triplets: DataFrame, labelled: DataFrame, similarity: DataFrame) -> DataFrame:
    """One row ``loss``: squared error of cosine against cluster similarity, positives plus negatives."""
    sim = similarity.select("a", "b", F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(F.col("sim")).alias("sim"))
    pos = sim.select(F.col("a").alias("label"), F.col("b").alias("positive_label"), F.col("sim").alias("_sp"))
    neg = sim.select(F.col("a").alias("label"), F.col("b").alias("negative_label"), F.col("sim").alias("_sn"))
    full = _vectors(triplets, labelled)
    full = full.join(pos, ["label", "positive_label"]).join(neg, ["label", "negative_label"])
    dp = cosine(F.col("_a"), F.col("_p")) - F.col("_sp")
    dn = cosine(F.col("_a"), F.col("_n")) - F.col("_sn")
    return full.agg(F.coalesce(F.avg(dp * dp) + F.avg(dn * dn), F.lit(0.0)).alias("loss"))


def shifted_negatives(edges: DataFrame, n_dst: int, seed: int = 0) -> DataFrame:
    """Add ``neg``: the positive destination moved by a drawn step of 1..n_dst-1, modulo n_dst."""
    step = F.floor(uniform("src", "dst", seed=seed) * F.lit(n_dst - 1)).cast("long") + 1
    return edges.withColumn("neg", F.pmod(F.col("dst") + step, F.lit(n_dst)).cast("long"))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    apart = a - b
    return np.sqrt(np.einsum("ij,ij->i", apart, apart))


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


def segmentation_loss(
    edges: DataFrame, src: DataFrame, dst: DataFrame, n_dst: int, kind: str = "triplet", margin: float = 0.4, seed: int = 0
) -> DataFrame:
    """One row ``loss`` over point-cell edges ``(src, dst)``; 0 with fewer than two cells.

    ``triplet`` compares distances, ``bce`` is binary cross-entropy on dot products.
    """
    if kind not in ("triplet", "bce"):
        raise ValueError(f"sg_loss_type must be 'triplet' or 'bce', not {kind!r}")
    if n_dst <= 1:
        return edges.sparkSession.range(1).select(F.lit(0.0).alias("loss"))
    full = shifted_negatives(edges.select("src", "dst"), n_dst, seed)
    full = cut_lineage(full.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col("neg").isNotNull()))
    if blocks_pay(2 * full.count(), src.count(), dst.count()):
        # Equal edges draw equal negatives, so one group is one edge and its copies.
        both = full.select("src", "dst", F.col("dst").alias("edge"), F.lit(True).alias("own")).unionByName(
            full.select("src", F.col("neg").alias("dst"), F.col("dst").alias("edge"), F.lit(False).alias("own"))
        )
        measured = measure_pairs(both, src, dst, _distances if kind == "triplet" else _dots, "m")
        own = F.col("own")
        full = measured.groupBy("src", "edge").agg(
            F.max(F.when(own, F.col("m"))).alias("mp"),
            F.max(F.when(~own, F.col("m"))).alias("mn"),
            F.count_if(own).alias("copies"),
            F.count_if(~own).alias("drawn"),
        )
        full, p, n = full.where("copies > 0 AND drawn > 0"), F.col("mp"), F.col("mn")
    else:
        full = full.join(src.select(F.col("id").alias("src"), F.col("embedding").alias("_a")), "src")
        for end, name in (("dst", "_p"), ("neg", "_n")):
            side = dst.select(F.col("id").alias(end), F.col("embedding").alias(name))
            full = keyed_join(full, side, [end])
        meet = distance if kind == "triplet" else dot
        full = full.withColumn("copies", F.lit(1))
        p, n = meet(F.col("_a"), F.col("_p")), meet(F.col("_a"), F.col("_n"))
    if kind == "triplet":
        term = F.greatest(p - n + F.lit(margin), F.lit(0.0))
    else:
        # Stable log(1 + exp(z)).
        def softplus(z):
            return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))

        term = (softplus(-p) + softplus(n)) / 2.0
    total = F.sum(term * F.col("copies")) / F.sum(F.when(term.isNotNull(), F.col("copies")))
    return full.agg(F.coalesce(total, F.lit(0.0)).alias("loss"))


def scheduled_weights(start, end, epoch: int, n_epochs: int) -> list[float]:
    """Cosine ramp from ``start`` to ``end``, normalised to sum 1."""
    t = min(epoch, n_epochs - 1) / max(1, n_epochs - 1)
    alpha = 0.5 * (1.0 + math.cos(math.pi * t))
    mixed = [e + (s - e) * alpha for s, e in zip(start, end)]
    total = sum(mixed) + 1e-8
    return [w / total for w in mixed]


def combined_loss(losses: list[float], start, end, epoch: int, n_epochs: int) -> float:
    return sum(w * v for w, v in zip(scheduled_weights(start, end, epoch, n_epochs), losses))
