"""Secret scan by dictionary-primed zstandard novelty.

Fixed patterns give the base findings.  Beyond them, every opaque token in a sensitive context is
a candidate: it is compressed with a dictionary made of identifiers and of the text around it, and
the bytes it adds are compared with its length.  Words, paths, names used elsewhere and placeholders are
in the dictionary and cost almost nothing; a key or password is new and does not compress.  Copies of a
candidate that stand in a sensitive context themselves are left out of its dictionary.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from gridloom.llm.text import flat, passes, require

#: Base patterns by kind, in the order of kinds; letters of a name in either case.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32
HEX = re.compile("[0-9a-f]{%d,}" % MIN_HEX)
KINDS = ("assign", "access", "hex", "novel")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words that make the text before a token sensitive, and what a candidate looks like.
SENSITIVE = re.compile(
    r"(?ai:pass(?:word|wd|phrase|code)?|pwd|secret|token|\bkey\b|(?:api|access|private|licen[cs]e)[ _-]?key|client_?id|"
    r"credential|auth(?:orization)?|bearer|signature|session_?id|cookie|salt|aws)"
)
MIN_CANDIDATE = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=~!@#$%%^&*-]{%d,}" % MIN_CANDIDATE)
#: First and last lines of PEM blocks, and the lines of a block that has no end.
PEM = re.compile(r"-----(BEGIN|END) [A-Z0-9 ]*-----")
PEM_BODY = re.compile(r"[ \t\r]*\n(?:[ \t]*[A-Za-z0-9+/=]+[ \t\r]*(?:\n|\Z))*")

#: Identifiers and placeholders that are no secrets: the fixed part of every dictionary.
IDENTIFIERS = (
    "password passwd username user_name secret_key access_key private_key public_key api_key apikey token "
    "authorization bearer basic credentials session_id cookie client_id client_secret signature salt hash "
    "example sample placeholder changeme change_me your_password your_api_key your_token insert_here xxxxxxxx "
    "xxxxxxxxxxxxxxxx 1234567890 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000 "
    "aaaaaaaa -------- ======== ........ ________ ******** undefined null none true false default "
    "os.environ process.env getenv config.get settings localhost 127.0.0.1 http:// https:// www. .com .org "
    ".example.com /usr/local/bin /home/ /etc/ .json .yaml .html .py .java .txt import function return self. this. "
    "document.getElementById String.valueOf public static void const let var def class lambda "
)


@dataclass(frozen=True)
class Novelty:
    """Parameters: characters of text around a candidate, how far back a sensitive word may stand
    (candidates between them not counted; at the end of a line also before the next line that is
    not blank, from its beginning), and the least share of its bytes that a reported candidate adds."""

    around: int = 400
    reach: int = 48
    least: float = 0.6
    identifiers: str = IDENTIFIERS
    level: int = 3

    def added(self, token: str, before: str, after: str) -> float:
        """Marginal compressed bytes of ``token`` given the dictionary, per byte of it."""
        raw = token.encode()
        primer = zstandard.ZstdCompressionDict(
            self.identifiers.encode() + after.encode() + b"\n" + before.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT
        )
        packer = zstandard.ZstdCompressor(
            level=self.level, dict_data=primer, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        empty = len(packer.compress(b""))
        return max(0, len(packer.compress(raw)) - empty) / len(raw)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping per kind."""
    out = []
    folded = text.lower()
    if any(name in folded for name in _NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _contexts(text: str, reach: int) -> Iterator[tuple[int, int, int]]:
    """Sensitive places (start, stop, last): candidates begin from start to stop, which candidates put off as far as last."""
    heads = []
    for m in PEM.finditer(text):
        heads.append(m.span())
        if m[1] == "BEGIN" and "PRIVATE KEY" in m[0]:
            end = text.find("-----END", m.end())
            if end < 0:
                body = PEM_BODY.match(text, m.end())
                end = body.end() if body else m.end()
            yield m.end(), end, end
    k = 0
    for m in SENSITIVE.finditer(text):
        while k < len(heads) and heads[k][1] <= m.start():
            k += 1
        if k < len(heads) and heads[k][0] <= m.start():
            continue
        line_end = text.find("\n", m.end())
        line_end = len(text) if line_end < 0 else line_end
        yield m.end(), min(m.end() + reach, line_end), line_end
        if line_end - m.end() <= reach and (below := _FILLED.search(text, line_end)):
            end = text.find("\n", below.start())
            end = len(text) if end < 0 else end
            yield below.start(), min(below.start() + reach, end), end


def _candidates(text: str, taken: list[tuple[int, int, int]], reach: int) -> list[tuple[int, int]]:
    """All tokens in a sensitive context that may be keys and that no base span overlaps, by start."""
    covered = bytearray(len(text))
    for a, _, b in taken:
        covered[a:b] = b"\1" * (b - a)
    out = set()
    for start, stop, last in _contexts(text, reach):
        # A token begins before ``stop`` and is taken to its end, however long.
        while c := CANDIDATE.search(text, start, min(len(text), stop + MIN_CANDIDATE - 1)):
            a, b = CANDIDATE.match(text, c.start()).span()
            start = b
            # An assignment in the token: the secret is what follows the sign.
            sign = text.find("=", a, b) - a
            if 0 < sign < b - a - 12 and text[a + sign + 1] != "=":
                a += sign + 1
            token = text[a:b]
            kinds = bool(re.search("[a-z]", token)) + bool(re.search("[A-Z]", token)) + bool(re.search("[0-9]", token))
            # Words joined by signs, such as paths and slugs, are no keys.
            longest = max(map(len, re.split(r"[-_/.]", token)))
            if kinds < 2 or longest < 10 or covered.find(1, a, b) >= 0:
                continue
            out.add((a, b))
            stop = min(stop + b - a, last)
    return sorted(out)


def _without(text: str, low: int, high: int, token: str, private: bytearray) -> str:
    """``text[low:high]`` without those copies of ``token`` that touch ``private`` places."""
    parts, at = [], low
    while (p := text.find(token, at, high)) >= 0:
        end = p + len(token)
        parts.append(text[at:p] if private.find(1, p, end) >= 0 else text[at:end])
        at = end
    return "".join([*parts, text[at:high]])


def novel_spans(text: str, taken: list[tuple[int, int, int]], rule: Novelty) -> list[tuple[int, int, int, float]]:
    """Incompressible candidates in a sensitive context that no base span overlaps, with their novelty."""
    found = _candidates(text, taken, rule.reach)
    private = bytearray(len(text))
    for a, b in [*found, *((a, b) for a, _, b in taken)]:
        private[a:b] = b"\1" * (b - a)
    out, end = [], 0
    for a, b in found:
        if a < end:
            continue
        token = text[a:b]
        before = _without(text, max(0, a - rule.around), a, token, private)
        added = rule.added(token, before, _without(text, b, min(len(text), b + rule.around), token, private))
        if added >= rule.least:
            out.append((a, 3, b, added))
            end = b
    return out


_FILLED = re.compile(r"\S")

_HEX_BYTES = np.zeros(256, np.uint8)
_HEX_BYTES[list(b"0123456789abcdef")] = 1
_HINTS = tuple(
    s.encode() for s in ("pass", "pwd", "secret", "token", "key", "client", "credential", "auth", "bearer", "signature", "session", "cookie", "salt", "aws")
)


def _worth_a_look(raw: bytes, folded: bytes) -> bool:
    """Necessary for any finding, and cheap: a name, an access key's letters or a long run of hex digits.

    Names match on any letter case of ASCII; other letters that fold to ASCII are no match anyway.
    """
    if b"AKIA" in raw or any(h in folded for h in _HINTS):
        return True
    return bytes(_HEX_BYTES[np.frombuffer(raw, np.uint8)]).find(b"\1" * MIN_HEX) >= 0


def scan_text(text: str, rule: Novelty) -> list[tuple[int, int, int, float]]:
    """All findings of one text: (start, kind, end, novelty), by start, then kind."""
    base = base_spans(text)
    return sorted([(a, k, b, 1.0) for a, k, b in base] + novel_spans(text, base, rule))


def scan(docs: DataFrame, rule: Novelty | None = None) -> DataFrame:
    """``doc_id`` and ``findings``: array of (kind, start, end, novelty, value), one row per row of ``docs``.

    Places are code points, the end exclusive.  ``value`` is the text found.  Base findings have
    novelty 1.  Null or empty text: an empty array.  Null ids and repeated rows: each row for
    itself.  Empty table: no rows.  Other columns are ignored.  One pass, no shuffle; a text is
    scanned whole.
    """
    require(docs, "doc_id", "text")
    rule = rule or Novelty()
    item = pa.struct(
        [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64()), ("value", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches):
            data, offs = flat(batch.column(1))
            out = []
            for a, b in zip(offs[:-1], offs[1:]):
                raw = data[a:b].tobytes()
                if not _worth_a_look(raw, raw.lower()):
                    out.append([])
                    continue
                text = raw.decode()
                out.append(
                    [
                        {"kind": KINDS[k], "start": s, "end": e, "novelty": n, "value": text[s:e]}
                        for s, k, e, n in scan_text(text, rule)
                    ]
                )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(item))], ["doc_id", "findings"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, findings array<struct<kind:string,start:long,end:long,novelty:double,value:string>>"
    )
