"""A bounded, repeatable sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.text import is_fold, require

#: Labelled rows that a classifier is fitted on at most (about; they are drawn by hash).
TRAIN_ROWS = 16_000
_STEPS = 1 << 30


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, rows: int = TRAIN_ROWS
) -> DataFrame:
    """``doc_id, text, label`` of about ``rows`` labelled documents outside the held-out fold.

    Several labels of one id are averaged, half counts as 1.  Rows with a null id or label are
    left out.  The drawn ids and labels (16 bytes a row, at most ``rows`` of them but for the
    spread of the draw) are broadcast, so no text is shuffled.
    """
    require(docs, "doc_id", "text")
    require(labels, "doc_id", label)
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~is_fold("doc_id", modulus, held_out))
        .groupBy(F.col("doc_id").alias("_id"))
        .agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("label"))
    )
    total = known.count()
    share = min(_STEPS, int(_STEPS * rows / max(total, 1)))
    drawn = known.where(F.pmod(F.xxhash64("_id", F.lit(label)), F.lit(_STEPS)) < share)
    texts = docs.select("doc_id", "text")
    return texts.join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label")
