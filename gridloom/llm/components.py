"""Connected components over tables of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import cut_lineage

#: Rounds after which a run that has not settled fails; it grows with the square of a logarithm.
MAX_ROUNDS = 60


def _state(stars: DataFrame) -> tuple:
    return tuple(stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links (a, b)``; ``root`` is the least node of its component.

    Nodes may be of any type that can be ordered.  Loops, repeated and reversed links are
    allowed; rows with a null are ignored; no links, no rows.  Each round hooks every node to the
    least node next to it, with partial minima before each shuffle and one short row per link
    after it, so a node with very many links is never gathered.
    """
    stars = cut_lineage(
        links.where(F.col("a").isNotNull() & F.col("b").isNotNull())
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    state = _state(stars)
    for _ in range(MAX_ROUNDS):
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = cut_lineage(both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        first = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(first, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(first.select("a", F.col("m").alias("b")))
        )
        stars = cut_lineage(small.where(F.col("a") != F.col("b")).distinct())
        before, state = state, _state(stars)
        if state == before:
            roots = stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
