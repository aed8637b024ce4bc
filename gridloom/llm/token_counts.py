"""Exact token counts at every prefix, by dynamic programming over byte-pair merges.

A vocabulary of merges has one property that makes prefixes cheap: a token sequence is the
encoding of its bytes exactly if every two neighbouring tokens encode to themselves.  So the last
token of a prefix is the one token that ends there and is compatible with the last token of the
prefix it leaves over, and

    count[i] = count[i - len(last[i])] + 1.

One pass over a word gives the count at each of its prefixes; over the pieces of a text the counts
add up.  The table answers "how many tokens has this prefix" and "how much fits into n tokens"
without encoding anything again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.text import array_column, flat, passes, require

#: Entries that a worker keeps of finished words and of tested token pairs, before it starts afresh.
WORD_CACHE = 600_000
PAIR_CACHE = 500_000

#: Texts of these characters only need no Unicode tables: their normal form is their lower case.
_PLAIN = re.compile("[^\t\n\r -~¡-įı-ſ]")
_LETTERS = "a-zªµºß-öø-ſ"
_DIGITS = "0-9²³¹¼-¾"
#: The pieces of this vocabulary's pre-tokenizer, for plain texts.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\\s{_LETTERS}{_DIGITS}]+")


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Prefix counts under one vocabulary file (JSON text) of byte-level merges with word ends."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or not self.end:
            raise ValueError("a BPE vocabulary with word ends is needed")
        self.vocabulary = vocabulary
        self.special = sorted((t["content"] for t in spec["added_tokens"] if t["special"]), key=len, reverse=True)
        self._special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.to_byte = _byte_of_char()
        ids = model["vocab"]
        self.open: dict[bytes, int] = {}
        self.closed: dict[bytes, int] = {}
        for token, i in ids.items():
            if token.endswith(self.end) and token != self.end:
                self.closed[self._bytes(token[: -len(self.end)])] = i
            else:
                self.open[self._bytes(token)] = i
        self.merges: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        last = -1
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole = ids[a + b]
            if whole <= last:
                raise ValueError("token ids must follow the order of merges")
            last = whole
            self.merges[ids[a], ids[b]] = whole
            self.halves[whole] = (ids[a], ids[b])
        self.longest = max(map(len, [*self.open, *self.closed]))
        self.words: dict[str, int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.sound: dict[int, bool] = {}
        self._library = None

    def _bytes(self, token: str) -> bytes:
        return bytes(self.to_byte[c] for c in token)

    # --- compatibility ----------------------------------------------------------

    def _whole(self, token: int) -> bool:
        """Do the token's own bytes encode to it?"""
        got = self.sound.get(token)
        if got is None:
            half = self.halves.get(token)
            got = half is None or (self._whole(half[0]) and self._whole(half[1]) and self._apart(*half, token))
            self.sound[token] = got
        return got

    def _apart(self, a: int, b: int, limit: float = float("inf")) -> bool:
        """Do no merges below ``limit`` happen across the border of ``a`` and ``b``?

        Undo the later of the two tokens' merges, again and again; at each step a merge across
        the border counts only if it comes before what was undone.
        """
        while True:
            across = self.merges.get((a, b))
            if across is not None and across < limit:
                return False
            left, right = self.halves.get(a), self.halves.get(b)
            if left is None and right is None:
                return True
            if right is None or (left is not None and a > b):
                limit, a = min(limit, a), left[1]
            else:
                limit, b = min(limit, b + 1), right[0]

    def fits(self, a: int, b: int) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) >= PAIR_CACHE:
                self.pairs.clear()
            got = self.pairs[a, b] = self._whole(b) and self._apart(a, b)
        return got

    # --- one word ---------------------------------------------------------------

    def _step(self, raw: bytes, i: int, last: list[int], count: list[int], tokens: dict[bytes, int]) -> tuple[int, int]:
        """Last token and count of the prefix ``raw[:i]`` whose last token is from ``tokens``."""
        for j in range(max(0, i - self.longest), i):
            t = tokens.get(raw[j:i])
            if t is not None and (self._whole(t) if j == 0 else self.fits(last[j], t)):
                return t, count[j] + 1
        raise ValueError(f"no encoding of {raw[:i]!r}")

    def _open_table(self, raw: bytes) -> tuple[list[int], list[int]]:
        """Last token and count of every proper prefix of ``raw``, none of them at a word's end."""
        last, count = [-1], [0]
        token, known, longest = self.open.get, self.pairs.get, self.longest
        for i in range(1, len(raw)):
            for j in range(i - longest if i > longest else 0, i):
                t = token(raw[j:i])
                if t is None:
                    continue
                if j:
                    good = known((last[j], t))
                    if good is None:
                        good = self.fits(last[j], t)
                else:
                    good = self._whole(t)
                if good:
                    last.append(t)
                    count.append(count[j] + 1)
                    break
            else:
                raise ValueError(f"no encoding of {raw[:i]!r}")
        return last, count

    def word(self, piece: str) -> int:
        """Tokens of one whole piece."""
        got = self.words.get(piece)
        if got is None:
            raw = piece.encode()
            if raw in self.closed and self._whole(self.closed[raw]):
                got = 1
            else:
                got = self._step(raw, len(raw), *self._open_table(raw), self.closed)[1]
            if len(self.words) >= WORD_CACHE:
                self.words.clear()
            self.words[piece] = got
        return got

    def word_prefixes(self, piece: str) -> list[int]:
        """Tokens of each prefix of a piece, by characters: entry k is the count of ``piece[:k]``."""
        raw = piece.encode()
        last, count = self._open_table(raw)
        out, i = [0], 0
        for c in piece:
            i += len(c.encode())
            out.append(self._step(raw, i, last, count, self.closed)[1])
        return out

    # --- one text ---------------------------------------------------------------

    def normal(self, text: str) -> str:
        if not _PLAIN.search(text):
            return text.lower()
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.vocabulary)
        return self._library.normalizer.normalize_str(text)

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """Normal text, and special strings as they stand (each is one token)."""
        if self._special is None or "<" not in text or not self._special.search(text):
            yield self.normal(text), False
            return
        at = 0
        for m in self._special.finditer(text):
            if m.start() > at:
                yield self.normal(text[at : m.start()]), False
            yield m.group(), True
            at = m.end()
        if at < len(text):
            yield self.normal(text[at:]), False

    def pieces(self, normal: str) -> Iterable[tuple[str, int]]:
        """Pieces of normal text with the place where each ends."""
        if not _PLAIN.search(normal):
            return [(m.group(), m.end()) for m in _PIECES.finditer(normal)]
        if self._library is None:
            self.normal("Ā一")
        got = self._library.pre_tokenizer.pre_tokenize_str(normal)
        return [(self._bytes(p).decode(), end) for p, (_, end) in got]

    def counts(self, text: str) -> list[int]:
        """Tokens of each piece of a text, in order."""
        out: list[int] = []
        for part, special in self.segments(text):
            if special:
                out.append(1)
            elif not _PLAIN.search(part):
                known, word = self.words.get, self.word
                out.extend([known(p) or word(p) for p in _PIECES.findall(part)])
            else:
                out.extend([self.word(p) for p, _ in self.pieces(part)])
        return out

    def ends(self, text: str) -> list[int]:
        """Where each piece ends, in characters of the normal text."""
        out, base = [], 0
        for part, special in self.segments(text):
            out.extend([base + len(part)] if special else [base + e for _, e in self.pieces(part)])
            base += len(part)
        return out

    def cut(self, text: str, budget: int, counts: list[int] | None = None) -> int:
        """Characters of the normal text that fit into ``budget`` tokens; all of it if it fits."""
        counts = self.counts(text) if counts is None else counts
        total = np.cumsum(counts)
        k = int(np.searchsorted(total, budget, "right"))
        if k == len(counts):
            return sum(len(p) for p, _ in self.segments(text))
        before = int(total[k - 1]) if k else 0
        ends, base = [], 0
        for part, special in self.segments(text):
            ends.extend([(base + len(part), part, special)] if special else [(base + e, p, False) for p, e in self.pieces(part)])
            base += len(part)
        end, piece, special = ends[k]
        start = end - len(piece)
        if special:
            return start
        table = self.word_prefixes(piece)
        inside = max(i for i, n in enumerate(table) if before + n <= budget)
        return start + inside if inside else (ends[k - 1][0] if k else 0)


_COUNTERS: dict[int, PrefixCounter] = {}


def _counter(vocabulary: str) -> PrefixCounter:
    key = hash(vocabulary)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = PrefixCounter(vocabulary)
    return _COUNTERS[key]


def read_vocabulary(path: str) -> str:
    """The vocabulary file, read once on the driver (a few MB) and sent to the workers."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def prefix_table(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id``, ``ends`` and ``tokens``: after the piece that ends at character ``ends[i]`` of the
    normal text, the text has ``tokens[i]`` tokens.

    Null or empty text: empty arrays.  Null ids and repeated rows: each row for itself.  Empty
    table: no rows.  Other columns are ignored.  One pass, no shuffle.
    """
    require(docs, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for batch in passes(batches):
            tables = [np.cumsum(counter.counts(t or ""), dtype=np.int32) for t in batch.column(1).to_pylist()]
            ends = [np.asarray(counter.ends(t or ""), np.int32) for t in batch.column(1).to_pylist()]
            rows = np.concatenate([[0], np.cumsum([len(t) for t in tables])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(array_column(np.concatenate(x), rows, pa.int32()) for x in (ends, tables))],
                ["doc_id", "ends", "tokens"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ends array<int>, tokens array<int>")


def budget_answers(docs: DataFrame, vocabulary: str, budget: int) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, n_fit``: the last entry of each prefix table, and how
    many characters of the normal text fit into ``budget`` tokens.

    Edge cases as in ``prefix_table``; an empty text has 0 bytes and 0 tokens and fits.
    """
    require(docs, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for batch in passes(batches):
            n_tokens, n_fit = [], []
            n_bytes = np.diff(flat(batch.column(1))[1])
            for text in batch.column(1).to_pylist():
                text = text or ""
                counts = counter.counts(text)
                n_tokens.append(sum(counts))
                # A normal text as long as its source needs no second look when all of it fits.
                plain = n_tokens[-1] <= budget and not _PLAIN.search(text)
                n_fit.append(len(text) if plain else counter.cut(text, budget, counts))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_bytes, pa.int64()),
                    pa.array(n_tokens, pa.int64()),
                    pa.array([n > budget for n in n_tokens], pa.bool_()),
                    pa.array(n_fit, pa.int64()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_fit"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, n_fit long"
    )
