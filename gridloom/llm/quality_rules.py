"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger stores the measurements and one bit per
failed rule; policies (named, versioned bit masks) and ablations read only the ledger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.text import WHITE, SpanHash, mix, passes, require, separator_table, shingles, spans, flat

SYMBOLS = separator_table(b"#*$%&|<>")
UPPER = separator_table(range(0x41, 0x5B))
LETTER = separator_table([*range(0x41, 0x5B), *range(0x61, 0x7B)])
DIGIT = separator_table(range(0x30, 0x3A))
MARK = separator_table(b"!?")

#: Measurements in the ledger; all are whole numbers, so rules are exact comparisons.
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_upper", "n_ascii_letters", "n_digits", "n_marks", "n_same_next", "longest_word",
)

#: Rules in bit order; a document fails a rule when its condition holds.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("shouting", "n_ascii_letters >= 20 AND 2 * n_upper > n_ascii_letters"),
    ("stutter", "10 * n_same_next > 3 * n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("digits", "2 * n_digits > word_chars"),
    ("marks", "5 * n_marks > n_words"),
    ("mean_word_short", "word_chars < 2 * n_words"),
    ("mean_word_long", "word_chars > 20 * n_words"),
)

BASE = ("few_words", "repeated_windows")
#: Versioned policies: a document is kept when it fails none of the policy's rules.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": tuple(name for name, _ in RULES),
    "v2-lenient": (*BASE, "symbols", "shouting", "stutter", "marks"),
}


def policy_mask(policy: str | tuple[str, ...]) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    bits = {name: 1 << i for i, (name, _) in enumerate(RULES)}
    return sum(bits[n] for n in dict.fromkeys(names))


def _per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between consecutive offsets ``at``."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[at])


def _repeated(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags: the value occurs more than once in its row; it occurred earlier in its row."""
    key = mix(value ^ mix(row.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    often, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    often[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return often, later


def measure(text: pa.Array) -> dict[str, np.ndarray]:
    """All measurements of a batch of texts, as flat array passes over their bytes."""
    data, offs = flat(text)
    w = spans(data, offs, WHITE)
    rows, n = w.row_of, w.counts
    hashes = SpanHash(data)
    word = hashes(w.starts, w.ends)
    lead = ((data & 0xC0) != 0x80) & ~WHITE[data]

    # Windows of three words; rows of fewer words have none.
    gram, grows = shingles(word, w.rows, 3)
    gcount = np.where(n >= 3, np.diff(grows), 0)
    keep = np.repeat(n >= 3, np.diff(grows))
    often, _ = _repeated(np.repeat(np.arange(len(n)), gcount), gram[keep])
    at = np.flatnonzero(keep) - np.repeat(grows[:-1] - w.rows[:-1], np.diff(grows))[keep]
    covered = np.zeros(len(word) + 3, bool)
    for j in range(3):
        covered[at[often] + j] = True

    # Lines: split at \n; a line counts when it has a word.
    breaks = np.flatnonzero(data == 0x0A)
    begins = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
    owner = np.searchsorted(offs, np.concatenate([breaks, offs[1:]]), "right") - 1
    ends = np.concatenate([breaks, offs[1:]])
    order = np.lexsort((ends, np.concatenate([owner[: len(breaks)], np.arange(len(n))])))
    owner = np.concatenate([owner[: len(breaks)], np.arange(len(n))])[order]
    ends = ends[order]
    lead_sum = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=lead_sum[1:])
    filled = lead_sum[ends] > lead_sum[begins]
    begins, ends, owner = begins[filled], ends[filled], owner[filled]
    _, later = _repeated(owner, hashes(begins, ends))

    same_next = np.zeros(len(word), bool)
    same_next[1:] = (word[1:] == word[:-1]) & (rows[1:] == rows[:-1])
    longest = np.zeros(len(n), np.int64)
    if len(word):
        chars = lead_sum[w.ends] - lead_sum[w.starts]
        has = n > 0
        longest[has] = np.maximum.reduceat(chars, w.rows[:-1][has])
    return {
        "n_words": n,
        "word_chars": np.diff(lead_sum[offs]),
        "n_symbols": _per_row(SYMBOLS[data], offs),
        "n_lines": np.bincount(owner, minlength=len(n)),
        "n_dup_lines": np.bincount(owner[later], minlength=len(n)),
        "n_repeat_words": _per_row(covered[: len(word)], w.rows),
        "n_upper": _per_row(UPPER[data], offs),
        "n_ascii_letters": _per_row(LETTER[data], offs),
        "n_digits": _per_row(DIGIT[data], offs),
        "n_marks": _per_row(MARK[data], offs),
        "n_same_next": _per_row(same_next, w.rows),
        "longest_word": longest,
    }


def ledger(docs: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """``doc_id``, the measurements and ``failed`` (bit i: rule i failed), one row per row of ``docs``.

    No shuffle: every rule is evaluated once, where the text is read.  Null or empty text: all
    measurements 0 (so it fails ``few_words`` only).  Null ids and repeated rows: each row for
    itself.  Empty table: no rows.  Other columns are ignored.
    """
    require(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches):
            got = measure(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(got[m].astype(np.int64)) for m in MEASURES]], ["doc_id", *MEASURES]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    measured = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    failed = F.lit(0).cast("long")
    for i, (_, condition) in enumerate(rules):
        failed = failed.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed", failed)


def passes_policy(policy: str | tuple[str, ...], failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(policy_mask(policy)).cast("long")) == 0


def ablate(book: DataFrame, policy: str = "v2") -> DataFrame:
    """Per rule of ``policy``: documents that fail it, that fail nothing else, and the kept count without it.

    One aggregation over the ledger's bits; nothing is measured again.
    """
    mask = policy_mask(policy)
    bits = [(name, 1 << i) for i, (name, _) in enumerate(RULES) if mask >> i & 1]
    hit = F.col("failed").bitwiseAND(F.lit(mask).cast("long"))
    sums = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((hit == 0).cast("long")), F.lit(0)).alias("kept")]
    for name, bit in bits:
        sums.append(F.coalesce(F.sum((hit.bitwiseAND(F.lit(bit).cast("long")) != 0).cast("long")), F.lit(0)).alias(f"f_{name}"))
        sums.append(F.coalesce(F.sum((hit == bit).cast("long")), F.lit(0)).alias(f"o_{name}"))
    rows = F.array(
        *[F.struct(F.lit(name).alias("rule"), F.col(f"f_{name}").alias("fails"), F.col(f"o_{name}").alias("fails_alone"), (F.col("kept") + F.col(f"o_{name}")).alias("kept_without")) for name, _ in bits]
    )
    return book.agg(*sums).select(F.inline(rows), "n", "kept")
