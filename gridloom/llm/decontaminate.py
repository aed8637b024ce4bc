"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A benchmark item is cut into windows of ``width`` consecutive words (a shorter item is one window).
A window can occur in a document only where its rarest word occurs, so that word - the prefix of
the window's words ordered by their frequency in the documents - is all that is joined.  What
remains is checked at its place: the window must lie inside the words of the document (length
and position bounds), and the words there must be the window's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.text import require
from gridloom.session import cut_lineage

WIDTH = 10
#: Words of one piece of a document.  Pieces overlap by a window, so rows stay small whatever
#: the length of a text and each occurrence lies whole in the piece in which it starts.
PIECE = 512
#: A window table of at most so many rows (about 300 bytes each) is sent to every executor;
#: a larger one is joined by shuffling word positions.
BROADCAST_ROWS = 50_000

#: ASCII A-Z, and the bytes that separate words once those are lower case.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; none for null."""
    text = F.coalesce(text, F.lit(""))
    # lower() knows other alphabets too, so it serves only where all is ASCII.
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.array_remove(F.split(low, SEPARATORS), "")


def windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """``words`` of each distinct window and ``items``: the ids that have it."""
    parts = items.select("item_id", word_array(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("_w") - width + 1, F.lit(1))))
    cut = parts.withColumn("_i", starts).select("item_id", F.slice("_w", F.col("_i"), F.lit(width)).alias("words"))
    return cut.groupBy("words").agg(F.collect_set("item_id").alias("items"))


def pieces(docs: DataFrame, keys: list[str], width: int, size: int = PIECE) -> DataFrame:
    """``keys``, ``n_words``, and per piece ``base`` (words before it) and ``words``; one piece for a text without words."""
    n = F.size("_w")
    cut = F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size)))
    return (
        docs.select(*keys, word_array(F.col("text")).alias("_w"))
        .select(*keys, n.cast("long").alias("n_words"), "_w", cut.alias("base"))
        .select(*keys, "n_words", "base", F.slice("_w", F.col("base") + 1, F.lit(size + width - 1)).alias("words"))
    )


def rarest_words(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The windows with ``word``, their rarest word in the documents, and ``off``, its place in the window.

    Frequencies are exact counts over all documents of the words that occur in windows; a window
    with a word that no document has cannot occur and is left out.
    """
    vocabulary = found.select(F.explode("words").alias("word")).distinct()
    counted = (
        docs.select(F.explode(word_array(F.col("text"))).alias("word"))
        .join(vocabulary, "word", "left_semi")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    placed = found.select("words", "items", F.posexplode("words").alias("off", "word"))
    ranked = placed.join(counted, "word").groupBy("words").agg(
        F.min(F.struct("n", "word", "off")).alias("_r"),
        F.first("items").alias("items"),
        F.count(F.lit(1)).alias("_known"),
    )
    return ranked.where(F.col("_known") == F.size("words")).select(
        F.col("words").alias("window"), "items", F.col("_r.word").alias("word"), F.col("_r.off").alias("off")
    )


def _occurrences(docs: DataFrame, prefix: DataFrame, keys: list[str], width: int, small: bool) -> DataFrame:
    """``keys``, ``first``, ``past`` (word places) and ``items`` of every occurrence of every window, and one row
    per document with ``n_words`` and no occurrence."""
    cut = pieces(docs, keys, width)
    own = F.when(F.col("base") == 0, F.array(F.lit(""))).otherwise(F.array())
    start = F.col("at") - F.col("off")
    if small:
        # The words stay where they are: the generated rows are probed in place, and only matches
        # are ever copied.  The row with the empty word is the document's own.
        kind = {f.name: f.dataType for f in prefix.schema}
        marks = prefix.unionByName(
            prefix.sparkSession.range(1).select(
                F.array().cast(kind["window"]).alias("window"), F.array().cast(kind["items"]).alias("items"),
                F.lit("").alias("word"), F.lit(0).alias("off"),
            )
        )
        exploded = cut.select(*keys, "n_words", "base", "words", F.posexplode(F.concat("words", own)).alias("at", "word"))
        inside = (
            (F.col("word") == "")
            | ((start >= 0) & (start < PIECE) & (start + F.size("window") <= F.size("words"))
               & (F.slice("words", F.greatest(start, F.lit(0)) + 1, F.size("window")) == F.col("window")))
        )
        hits = exploded.join(F.broadcast(marks), "word").where(inside)
        place = F.when(F.col("word") != "", F.col("base") + start)
        return hits.select(*keys, F.when(F.col("word") == "", F.col("n_words")).alias("n_words"), place.alias("first"), (place + F.size("window")).alias("past"), "items")
    # Word positions without the text are joined; the pieces that have a candidate are then
    # joined again for the check.
    cut = cut_lineage(cut)
    places = cut.select(*keys, "base", F.posexplode("words").alias("at", "word"))
    candidates = places.join(prefix, "word").where((start >= 0) & (start < PIECE))
    match = [F.col(f"c.{k}").eqNullSafe(F.col(f"p.{k}")) for k in [*keys, "base"]]
    on = match[0]
    for m in match[1:]:
        on = on & m
    hits = (
        candidates.select(*keys, "base", start.alias("start"), "window", "items").distinct().alias("c")
        .join(cut.select(*keys, "base", "words").distinct().alias("p"), on)
        .where((F.col("start") + F.size("window") <= F.size("words")) & (F.slice("words", F.col("start") + 1, F.size("window")) == F.col("window")))
    )
    first = F.col("c.base") + F.col("start")
    found = hits.select(*[F.col(f"c.{k}").alias(k) for k in keys], F.lit(None).cast("long").alias("n_words"), first.alias("first"), (first + F.size("window")).alias("past"), "items")
    none = F.lit(None)
    return cut.where("base = 0").select(*keys, "n_words", none.cast("int").alias("first"), none.cast("int").alias("past"), none.cast(prefix.schema["items"].dataType).alias("items")).unionByName(found)


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id, text_hash, n_words, n_hit, item_ids, contaminated`` for every row of ``docs``.

    ``n_hit`` counts the words inside any occurrence of a window; ``item_ids`` are the items with
    an occurring window, as sorted strings.

    Null or empty text, of a document or an item: no words, no window.  An item without an id
    contaminates but is not listed.  Rows with equal id and text have equal results, each its own
    row; a null id is an id like any other.  Empty documents: no rows; empty benchmark: no hits.
    Other columns are ignored.
    """
    require(docs, "doc_id", "text")
    require(items, "item_id", "text")
    keys = ["doc_id", "text_hash"]
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    prefix = cut_lineage(rarest_words(docs, windows(items.select("item_id", "text"), width)))
    small = prefix.count() <= broadcast_rows
    rows = _occurrences(docs, prefix, keys, width, small)
    merged = rows.groupBy(*keys).agg(
        F.count("n_words").alias("_copies"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("first").isNotNull(), F.struct("first", "past")))).alias("_at"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("_items"),
    )
    # Occurrences in order of their start; each adds what lies past the words covered so far.
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("past")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(x["past"] - F.greatest(x["first"], s["past"]), F.lit(0))).alias("n"),
            F.greatest(s["past"], x["past"]).alias("past"),
        ),
        lambda s: s["n"].cast("long"),
    )
    ids = F.array_sort(F.transform("_items", lambda i: i.cast("string")))
    return merged.select(
        *keys, "n_words", covered.alias("n_hit"), F.array_compact(ids).alias("item_ids"),
        F.explode(F.array_repeat(F.size("_at") > 0, F.col("_copies").cast("int"))).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` in which no window of ``items`` occurs, with all their columns.

    Edge cases as in ``contamination``; a document without words is clean.
    """
    dirty = contamination(docs, items, width).where("contaminated").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct()
    return docs.join(dirty, docs["doc_id"].eqNullSafe(dirty["_d"]) & (F.xxhash64(docs["text"]) == dirty["_h"]), "left_anti")
