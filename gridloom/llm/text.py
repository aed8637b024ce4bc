"""Shared helpers: Arrow text batches as flat byte arrays, word spans, span hashes, session set-up."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import ship_packages, use_defaults

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Rows of one Arrow batch, and bytes of text that one pass over flat arrays may hold (a
#: longer text is a pass of its own).
BATCH_ROWS = 1000
PASS_BYTES = 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Session defaults, source packages on the workers, and small Arrow batches."""
    use_defaults(spark)
    ship_packages(spark, ROOT, ("gridloom", "checks"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def fold(column: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % modulus


def is_fold(column: str, modulus: int, remainder: int) -> Column:
    """True where the fold is ``remainder``.  A null id belongs to it, so that it is never learned from."""
    return F.coalesce(fold(column, modulus) == remainder, F.lit(True))


def require(docs: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in docs.columns]
    if missing:
        raise ValueError(f"columns {missing} are not in {docs.columns}")


def fresh(docs: DataFrame, *names: str) -> None:
    """Refuse to overwrite a column that the caller's table already has."""
    clash = [n for n in names if n in docs.columns]
    if clash:
        raise ValueError(f"the table already has columns {clash}")


# --- Arrow ----------------------------------------------------------------------


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and n + 1 offsets into them; null is empty."""
    array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, np.int64, len(array) + 1, array.offset * 8)
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(data, np.uint8, int(offs[-1] - offs[0]), int(offs[0])), offs - offs[0]


def passes(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = flat(batch.column(batch.schema.get_field_index(column)))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b


# --- words ----------------------------------------------------------------------


def separator_table(separators: Iterable[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(separators)] = True
    return table


#: Words ``[^\x20\x09-\x0D]+`` and ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (the latter once A-Z are lower case).
WHITE = separator_table([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = separator_table([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Words:
    """Word spans of a batch: bytes ``[starts, ends)``; row r has words ``[rows[r], rows[r + 1])``."""

    data: np.ndarray
    offs: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    @property
    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), self.counts)


def spans(data: np.ndarray, offs: np.ndarray, separators: np.ndarray) -> Words:
    """Maximal runs of bytes outside ``separators``; no run crosses a row."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~separators[data]
    first = np.zeros(n + 1, bool)
    first[offs] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    return Words(data, offs, starts, ends, np.searchsorted(starts, offs))


def words(array: pa.Array, separators: np.ndarray, lower: bool = False) -> Words:
    data, offs = flat(array)
    return spans(LOWER[data] if lower else data, offs, separators)


# --- hashes ---------------------------------------------------------------------

_BASE = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        base = _BASE[which]
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = (both[0], both[1])
        if size <= PASS_BYTES * 2:
            _POWERS[which] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result depends on every bit of ``x``."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class SpanHash:
    """64-bit hashes of any spans of one value array, from prefix sums: one subtraction each."""

    def __init__(self, values: np.ndarray, which: int = 0):
        self.up, self.down = _powers(len(values) + 1, which)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * self.up[: len(values)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] ^ (ends - starts).astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def shingles(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` consecutive words, and their row offsets.

    A row of fewer words, but not none, has one shingle of all its words.
    """
    counts = np.diff(rows)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out = np.zeros(len(rows), np.int64)
    np.cumsum(n, out=out[1:])
    at = np.arange(out[-1]) - np.repeat(out[:-1] - rows[:-1], n)
    end = np.minimum(at + k, np.repeat(rows[1:], n))
    total = np.zeros(len(at), np.uint64)
    for j in range(k):
        p = at + j
        ok = p < end
        total = total * np.uint64(0x9E3779B97F4A7C15) + np.where(ok, hashes[np.minimum(p, max(len(hashes) - 1, 0))] if len(hashes) else 0, np.uint64(0))
    return mix(total ^ (end - at).astype(np.uint64)), out


def array_column(values: np.ndarray, rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column: row r holds ``values[rows[r]:rows[r + 1]]``."""
    return pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(values, kind))
