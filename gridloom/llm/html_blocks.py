"""Web pages as sequences of leaf blocks: normalised text, and the tags, classes and roles above it."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

#: Bits of the set of path words above a block, and of the words of its own element.
PATH_BITS, OWN_BITS = 384, 128

TOKEN = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|(?P<cut>\Z))",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|type)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
CLOSES = {
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}),
    "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"}),
}
FENCES = frozenset("ul ol dl table div section article main aside body".split())

#: Words that name parts of pages, found inside longer class names too (from four letters on).
NOISE_WORDS = (
    "nav menu navbar topbar header masthead footer sidebar aside rail widget breadcrumb pagination pager crumb skip search form login signup signin "
    "register subscribe newsletter ad ads advert advertisement adsense sponsor sponsored promo promotion banner cookie consent gdpr notice alert "
    "warning popup modal overlay toast share sharing social follow related recommended recommend more popular trending teaser comment comments reply "
    "replies discussion disqus respond feedback toolbar tools tags legal copyright credits contact cta paywall outbrain taboola"
).split()
TEXT_WORDS = "article main content post entry story body text prose page hentry articlebody blog news detail".split()
KNOWN = tuple(w for w in (*NOISE_WORDS, *TEXT_WORDS) if len(w) >= 4)


@lru_cache(maxsize=1 << 14)
def _bits(name: str, attrs: str) -> tuple[int, int, frozenset[str]]:
    """Path bits, own bits and words of a start tag."""
    words = {name}
    for m in ATTRIBUTE.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("hidden", "aria-hidden"):
            words |= {"hidden"} if value.lower() != "false" else set()
            continue
        if key == "type" and name != "input":
            continue
        for piece in PIECE.findall(value):
            piece = piece.lower()
            words.add("." + piece)
            words.update("." + w for w in KNOWN if w in piece)
    path = own = 0
    for w in words:
        h = zlib.crc32(w.encode())
        path |= 1 << h % PATH_BITS
        own |= 1 << (h // PATH_BITS) % OWN_BITS
    return path, own, frozenset(words)


@dataclass(slots=True)
class Block:
    """A run of text without a block boundary inside."""

    text: str
    path: int
    own: int
    linked: int
    depth: int
    words: frozenset[str] | None


class _Page:
    def __init__(self, with_words: bool):
        self.stack: list[tuple[str, int, int, frozenset[str] | None]] = []
        self.open: dict[str, int] = {}
        self.blocks: list[Block] = []
        self.pieces: list[str] = []
        self.linked = 0
        self.with_words = with_words

    def flush(self) -> None:
        if not self.pieces:
            return
        text = " ".join("".join(self.pieces).split())
        if text:
            block = next((x for x in reversed(self.stack) if x[0] not in INLINE), None)
            _, path, own, words = block or ("", 0, 0, frozenset() if self.with_words else None)
            self.blocks.append(Block(text, path, own, self.linked, len(self.stack), words))
        self.pieces.clear()
        self.linked = 0

    def text(self, raw: str) -> None:
        raw = unescape(raw) if "&" in raw else raw
        self.pieces.append(raw)
        if self.open.get("a"):
            self.linked += len(raw)

    def push(self, name: str, attrs: str) -> None:
        path, own, words = _bits(name, attrs)
        if self.stack:
            _, above, _, theirs = self.stack[-1]
            path |= above
            words = words | theirs if self.with_words else None
        self.stack.append((name, path, own, words if self.with_words else None))
        self.open[name] = self.open.get(name, 0) + 1

    def pop(self) -> str:
        name = self.stack.pop()[0]
        self.open[name] -= 1
        return name

    def close(self, name: str) -> None:
        """An end tag: pops up to its start tag; an inline one looks no further than its block."""
        if not self.open.get(name):
            return
        if name in INLINE:
            for x in range(len(self.stack) - 1, -1, -1):
                if self.stack[x][0] == name:
                    break
                if self.stack[x][0] not in INLINE:
                    return
        while self.pop() != name:
            pass

    def imply(self, names: frozenset[str]) -> None:
        """End an open element of these names that stands inside the nearest fence."""
        for x in range(len(self.stack) - 1, -1, -1):
            here = self.stack[x][0]
            if here in names:
                while len(self.stack) > x:
                    self.pop()
                return
            if here in FENCES:
                return


_P = frozenset({"p"})
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}


def blocks_of(html: str | None, with_words: bool = False) -> list[Block]:
    """The leaf blocks of a page, in page order; null or text-free pages have none.

    Scripts, styles, templates, titles, comments and declarations are no text.  Character references
    are decoded, white space is one space, ends are trimmed.  Unclosed elements end where the standard
    says so for paragraphs, list items, cells and options, and else with their parents; a stray end tag is
    ignored; a tag that the end of the page cuts off is dropped.
    """
    page = _Page(with_words)
    html = html or ""
    at, n = 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            page.text(html[at:])
            break
        if m.start() > at:
            page.text(html[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None or m["cut"] is not None:
            continue
        name = name.lower()
        if m["end"]:
            if name not in INLINE:
                page.flush()
            page.close(name)
            continue
        if name in RAW:
            closing = _RAW_END[name].search(html, at)
            at = closing.end() if closing else n
            continue
        if name == "br":
            page.pieces.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                page.flush()
            continue
        if name not in INLINE:
            page.flush()
            if page.open.get("p"):
                page.imply(_P)
            closes = CLOSES.get(name)
            if closes and any(page.open.get(c) for c in closes):
                page.imply(closes)
        if not m["attrs"].rstrip().endswith("/") or name not in ("svg", "path"):
            page.push(name, m["attrs"])
    page.flush()
    return page.blocks
