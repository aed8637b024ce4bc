"""Main text of web pages: a bidirectional LSTM reads a page's leaf blocks and labels each in the light of all.

A block is a vector of the hashed words of its tag path, hashed words of its text, and a few measures.
The network is trained on a bounded sample of the pages themselves.  Labels come from landmarks, where
a page has them, and from layouts drawn anew: pieces of text of the sample are laid out as articles among
menus, notices, adverts, forms and comments, under many tag and class names, so that the labels are known
and the network learns to do without any one landmark.
"""

from __future__ import annotations

import pickle
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.llm.html_blocks import NOISE_WORDS, OWN_BITS, PATH_BITS, Block, blocks_of
from gridloom.llm.text import NOT_ALNUM, SpanHash, passes, require, words

WORD_BUCKETS = 128
MEASURES = 9
#: Pages that the network is trained on (about; drawn by hash), characters of each that are read for it,
#: and blocks of one training sequence.
TRAIN_PAGES, TRAIN_CHARS, TRAIN_BLOCKS = 240, 32_000, 160
#: Layouts drawn for each of them.
LAYOUTS = 5
#: Bytes of html of one pass over flat arrays.
PASS_BYTES = 2 << 20
PLACES = 9

# --- vectors --------------------------------------------------------------------


def _mask_rows(masks: list[int], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct bit sets as 0/1 rows, and the row of each mask."""
    index: dict[int, int] = {}
    at = np.array([index.setdefault(m, len(index)) for m in masks], np.int64)
    raw = b"".join(m.to_bytes(bits // 8, "little") for m in index)
    return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, bits // 8), axis=1, bitorder="little").astype(np.float64), at


@dataclass
class Inputs:
    """Blocks of several pages: page p has blocks ``[rows[p], rows[p + 1])``."""

    paths: np.ndarray
    path_at: np.ndarray
    owns: np.ndarray
    own_at: np.ndarray
    text: np.ndarray
    rows: np.ndarray


def encode(pages: list[list[Block]]) -> Inputs:
    """Input vectors of all blocks.  Pages without blocks are empty sequences."""
    rows = np.concatenate([[0], np.cumsum([len(p) for p in pages])]).astype(np.int64)
    blocks = [b for p in pages for b in p]
    n = len(blocks)
    if not n:
        nothing = np.zeros(0, np.int64)
        return Inputs(np.zeros((0, PATH_BITS)), nothing, np.zeros((0, OWN_BITS)), nothing, np.zeros((0, WORD_BUCKETS + MEASURES)), rows)
    paths, path_at = _mask_rows([b.path for b in blocks], PATH_BITS)
    owns, own_at = _mask_rows([b.own for b in blocks], OWN_BITS)
    texts = pa.array([b.text for b in blocks])
    w = words(texts, NOT_ALNUM, lower=True)
    bucket = (SpanHash(w.data)(w.starts, w.ends) % np.uint64(WORD_BUCKETS)).astype(np.int64)
    hashed = np.bincount(w.row_of * WORD_BUCKETS + bucket, minlength=n * WORD_BUCKETS).reshape(n, WORD_BUCKETS) > 0
    hashed = hashed / np.sqrt(np.maximum(hashed.sum(1, keepdims=True), 1))
    chars = np.array([len(b.text) for b in blocks], np.float64)
    page = np.repeat(np.arange(len(pages)), np.diff(rows))
    place = (np.arange(n) - rows[page]) / np.maximum(np.diff(rows)[page] - 1, 1)
    depth = np.array([b.depth for b in blocks], np.float64)
    stops = np.array([sum(map(b.text.count, ".,;:!?")) for b in blocks], np.float64)
    measures = [
        np.log1p(chars) / 4,
        np.log1p(w.counts) / 4,
        np.array([b.linked for b in blocks]) / np.maximum(chars, 1),
        stops / np.maximum(w.counts, 1),
        np.array([b.text[-1] in ".!?…”\"" for b in blocks], np.float64),
        place,
        np.minimum(depth, 20) / 10,
        np.concatenate([[0.0], (path_at[1:] != path_at[:-1]).astype(np.float64)]),
        np.array([b.text[0].isupper() for b in blocks], np.float64),
    ]
    text = np.concatenate([hashed, np.clip(np.stack(measures, 1), 0, 4)], axis=1)
    return Inputs(paths, path_at, owns, own_at, text, rows)


# --- network --------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class _Order:
    """Positions of packed sequences step by step: at step t, those of the sequences that are that long."""

    def __init__(self, rows: np.ndarray, back: bool):
        size = np.diff(rows)
        order = np.argsort(-size, kind="stable")
        size, start = size[order], rows[:-1][order]
        alive = np.searchsorted(-size, -np.arange(size.max(initial=0)), "left")
        last = start + size - 1
        self.steps = [(last[:m] - t if back else start[:m] + t) for t, m in enumerate(alive)]


def lstm(x: np.ndarray, recur: np.ndarray, order: _Order) -> tuple[np.ndarray, tuple]:
    """Hidden states of all positions from gate inputs ``x`` (input, forget, output, candidate)."""
    hidden = recur.shape[0]
    out, cell, gates = np.zeros((len(x), hidden)), np.zeros((len(x), hidden)), np.zeros_like(x)
    h = c = np.zeros((0, hidden))
    for t, at in enumerate(order.steps):
        z = x[at]
        if t:
            z += h[: len(at)] @ recur
        g = np.empty_like(z)
        g[:, : 3 * hidden] = _sigmoid(z[:, : 3 * hidden])
        g[:, 3 * hidden :] = np.tanh(z[:, 3 * hidden :])
        i, f, o, u = (g[:, j * hidden : (j + 1) * hidden] for j in range(4))
        c = i * u + (f * c[: len(at)] if t else 0)
        h = o * np.tanh(c)
        out[at], cell[at], gates[at] = h, c, g
    return out, (cell, gates)


def lstm_gradient(d_out: np.ndarray, recur: np.ndarray, order: _Order, out: np.ndarray, state: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gate inputs and of the recurrent weights."""
    cell, gates = state
    hidden = recur.shape[0]
    dx, d_recur = np.zeros_like(gates), np.zeros_like(recur)
    dh = dc = np.zeros((0, hidden))
    for t in range(len(order.steps) - 1, -1, -1):
        at = order.steps[t]
        m = len(at)
        grow_h, grow_c = np.zeros((m, hidden)), np.zeros((m, hidden))
        grow_h[: len(dh)], grow_c[: len(dc)] = dh, dc
        dh_t = d_out[at] + grow_h
        i, f, o, u = (gates[at, j * hidden : (j + 1) * hidden] for j in range(4))
        tc = np.tanh(cell[at])
        dct = grow_c + dh_t * o * (1 - tc * tc)
        before = order.steps[t - 1][:m] if t else None
        c_before = cell[before] if t else np.zeros((m, hidden))
        dz = np.concatenate([dct * u * i * (1 - i), dct * c_before * f * (1 - f), dh_t * tc * o * (1 - o), dct * i * (1 - u * u)], axis=1)
        dx[at] = dz
        if t:
            d_recur += out[before].T @ dz
            dh, dc = dz @ recur.T, dct * f
    return dx, d_recur


@dataclass
class Labeller:
    """Weights: embedding of the block vectors, two LSTM directions, and the label."""

    weights: dict[str, np.ndarray]

    @staticmethod
    def start(rng: np.random.Generator, embed: int = 24, hidden: int = 20) -> Labeller:
        def draw(*shape: int, scale: float | None = None) -> np.ndarray:
            return rng.normal(0, scale or 1 / np.sqrt(shape[0]), shape)

        w = {
            "path": draw(PATH_BITS, embed, scale=0.15), "own": draw(OWN_BITS, embed, scale=0.15), "text": draw(WORD_BUCKETS + MEASURES, embed, scale=0.15),
            "bias": np.zeros(embed), "in_f": draw(embed, 4 * hidden), "in_b": draw(embed, 4 * hidden), "re_f": draw(hidden, 4 * hidden), "re_b": draw(hidden, 4 * hidden),
            "b_f": np.zeros(4 * hidden), "b_b": np.zeros(4 * hidden), "label": draw(2 * hidden), "c": np.zeros(1),
        }
        w["b_f"][hidden : 2 * hidden] = w["b_b"][hidden : 2 * hidden] = 1.0
        return Labeller(w)

    def forward(self, x: Inputs) -> tuple[np.ndarray, tuple]:
        """Probability of main text of every block."""
        p = self.weights
        e = np.tanh((x.paths @ p["path"])[x.path_at] + (x.owns @ p["own"])[x.own_at] + x.text @ p["text"] + p["bias"])
        orders = _Order(x.rows, False), _Order(x.rows, True)
        hf, sf = lstm(e @ p["in_f"] + p["b_f"], p["re_f"], orders[0])
        hb, sb = lstm(e @ p["in_b"] + p["b_b"], p["re_b"], orders[1])
        both = np.concatenate([hf, hb], axis=1)
        return _sigmoid(both @ p["label"] + p["c"]), (e, orders, hf, sf, hb, sb, both)

    def gradient(self, x: Inputs, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean weighted log loss."""
        p = self.weights
        score, (e, orders, hf, sf, hb, sb, both) = self.forward(x)
        dl = (score - y) * weight / max(weight.sum(), 1e-9)
        d_both = dl[:, None] * p["label"]
        hidden = hf.shape[1]
        xf, re_f = lstm_gradient(d_both[:, :hidden], p["re_f"], orders[0], hf, sf)
        xb, re_b = lstm_gradient(d_both[:, hidden:], p["re_b"], orders[1], hb, sb)
        de = (xf @ p["in_f"].T + xb @ p["in_b"].T) * (1 - e * e)
        by_path, by_own = np.zeros((len(x.paths), de.shape[1])), np.zeros((len(x.owns), de.shape[1]))
        np.add.at(by_path, x.path_at, de)
        np.add.at(by_own, x.own_at, de)
        return {
            "path": x.paths.T @ by_path, "own": x.owns.T @ by_own, "text": x.text.T @ de, "bias": de.sum(0), "in_f": e.T @ xf, "in_b": e.T @ xb,
            "re_f": re_f, "re_b": re_b, "b_f": xf.sum(0), "b_b": xb.sum(0), "label": both.T @ dl, "c": np.array([dl.sum()]),
        }


def fit(sequences: list[tuple[list[Block], list[float | None]]], epochs: int = 10, batch: int = 24, rate: float = 0.01, decay: float = 1e-5, seed: int = 13) -> Labeller:
    """Adam on the log loss of known labels; the same input gives the same network."""
    rng = np.random.default_rng(seed)
    model = Labeller.start(rng)
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    batches = []
    # Sequences of like length share a batch.
    order = sorted(range(len(sequences)), key=lambda i: len(sequences[i][0]))
    for at in range(0, len(order), batch):
        pick = [sequences[i] for i in order[at : at + batch]]
        label = [y for _, ys in pick for y in ys]
        if label:
            known = np.array([y is not None for y in label], np.float64)
            batches.append((encode([b for b, _ in pick]), np.array([y or 0.0 for y in label]), known))
    step = 0
    for epoch in range(epochs):
        for at in rng.permutation(len(batches)):
            step += 1
            lr = rate * (1 - epoch / epochs)
            for k, g in model.gradient(*batches[at]).items():
                g = np.clip(g, -1, 1) + decay * model.weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.weights[k] -= lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


# --- training pages -------------------------------------------------------------

LANDMARK_NOISE = frozenset({"nav", "footer", "aside", "form", "dialog", "noscript", "button", "select", "textarea"}) | {
    "." + w for w in NOISE_WORDS if w not in ("more", "tools", "tags", "contact", "notice", "header", "rail", "follow")
}
LANDMARK_TEXT = frozenset({"article", "main", ".articlebody", ".article"})


def landmark(block: Block) -> float | None:
    """Label of a block below telling elements; None where there are none."""
    below = block.words or frozenset()
    if below & LANDMARK_NOISE:
        return 0.0
    if below & LANDMARK_TEXT:
        return 1.0
    return 0.0 if "header" in below else None


MARKS = {"\ue000": 1.0, "\ue001": 0.0}

#: Parts of pages: elements that may hold them, and class words (first: hardly ever without one of these).
PARTS = {
    "menu": (("nav", "ul", "div", "header"), ("nav", "menu", "navbar", "main-menu", "site-nav", "primary-navigation", "topnav", "top-menu")),
    "header": (("header", "div"), ("header", "site-header", "masthead", "page-header", "top-bar", "branding", "logo")),
    "crumbs": (("nav", "div", "ol"), ("breadcrumb", "breadcrumbs", "crumbs")),
    "notice": (("div", "section", "aside", "p"), ("cookie-notice", "cookie-banner", "consent", "notice", "gdpr", "alert", "site-notice", "banner", "popup", "modal")),
    "advert": (("div", "aside", "section", "ins"), ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "adsbygoogle", "sponsor", "banner-ad")),
    "form": (("form", "div"), ("search", "search-form", "newsletter", "subscribe", "signup", "login", "contact-form", "newsletter-signup")),
    "side": (("aside", "div", "section"), ("sidebar", "side", "rail", "right-rail", "widget", "widget-area", "secondary", "side-bar")),
    "related": (("div", "section", "aside", "ul"), ("related", "related-posts", "recommended", "read-more", "more-stories", "trending", "popular", "also-read")),
    "comments": (("section", "div", "ol", "ul"), ("comments", "comment-list", "comments-area", "discussion", "responses", "replies", "disqus_thread", "feedback", "reader-comments")),
    "share": (("div", "ul"), ("share", "social", "share-buttons", "sharing", "social-links")),
    "pager": (("nav", "div"), ("pagination", "pager", "page-numbers", "post-navigation")),
    "footer": (("footer", "div", "section"), ("footer", "site-footer", "page-footer", "colophon", "bottom", "legal", "copyright")),
}
WRAPS = ("", "article", "post", "entry", "entry-content", "post-content", "content", "main-content", "story", "story-body", "article-body", "text", "body-copy", "prose", "page-content", "blog-post")
SHELLS = ("container", "wrapper", "row", "page", "site", "inner", "layout", "grid", "col", "app", "root")


class Layout:
    """Draws pages whose labels are known, from pieces of text."""

    def __init__(self, long: list[str], short: list[str], r: random.Random):
        self.long, self.short, self.r = long, short or ["x"], r

    def tag(self, name: str, inside: str, *classes: str, close: bool = True) -> str:
        picked = " ".join(c for c in classes if c)
        key = self.r.choice(("class", "class", "class", "id"))
        return f'<{name}{f" {key}={chr(34)}{picked}{chr(34)}" if picked else ""}>{inside}{f"</{name}>" if close else ""}'

    def some(self, mark: str, n: int = 1) -> str:
        r = self.r
        return mark + r.choice(self.short) + "".join(" " + r.choice(self.short) for _ in range(n - 1))

    def prose(self, mark: str) -> str:
        return mark + self.r.choice(self.long or self.short)

    def links(self, n: int) -> str:
        r, mark = self.r, "\ue001"
        items = [f'<a href="/{i}">{self.some(mark, r.randint(1, 4))}</a>' for i in range(n)]
        shape = r.random()
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if shape < 0.6 else "".join(f"<div>{x}</div>" for x in items) if shape < 0.8 else " | ".join(items)

    def part(self, kind: str) -> str:
        r, no = self.r, "\ue001"
        names, classes = PARTS[kind]
        name, cls = r.choice(names), r.choice(classes)
        if name in ("nav", "footer", "aside", "form") and r.random() < 0.35:
            cls = ""
        line = lambda: self.prose(no) if r.random() < 0.5 else self.some(no, r.randint(2, 9))
        if kind in ("menu", "crumbs", "pager", "share"):
            inside = self.links(r.randint(2, 9))
        elif kind in ("header",):
            inside = self.tag(r.choice(("div", "h1", "p", "a")), self.some(no, r.randint(1, 4))) + (self.links(r.randint(2, 5)) if r.random() < 0.4 else "")
        elif kind in ("notice", "advert", "footer"):
            body = "".join(self.tag(r.choice(("p", "span", "div")), line()) for _ in range(r.randint(1, 2))) if r.random() < 0.6 else line()
            inside = body + (f"<button>{self.some(no)}</button>" if kind == "notice" else self.links(r.randint(2, 5)) if kind == "footer" and r.random() < 0.6 else "")
        elif kind == "form":
            inside = f'<label>{self.some(no, 2)}</label><input type="text"><button>{self.some(no)}</button>' + (f"<p>{line()}</p>" if r.random() < 0.5 else "")
        elif kind == "side":
            inside = f"<h3>{self.some(no, 2)}</h3>" + (self.links(r.randint(2, 6)) if r.random() < 0.6 else f"<p>{line()}</p>")
        elif kind == "related":
            inside = f"<h3>{self.some(no, 2)}</h3>" + "".join(f'<div><a href="/r">{self.some(no, 5)}</a><p>{line()}</p></div>' for _ in range(r.randint(1, 4)))
        else:
            item = r.choice(("li", "div", "article", "p"))
            inside = f"<h3>{self.some(no, 2)}</h3>" + "".join(
                self.tag(item, (f"<b>{self.some(no, 2)}</b>" if item == "p" else f"<div>{self.some(no, 2)}</div>{self.tag(r.choice(('p', 'div')), line())}") + line(), r.choice(("comment", "reply", "", "comment-body")))
                for _ in range(r.randint(1, 6))
            )
        return self.tag("div" if name == "ins" else name, inside, cls)

    def paragraphs(self) -> str:
        r, yes = self.r, "\ue000"
        out = []
        for _ in range(r.randint(1, 8)):
            shape = r.random()
            if shape < 0.6:
                out.append(self.tag(r.choice(("p", "p", "p", "div")), self.prose(yes), close=r.random() < 0.8))
            elif shape < 0.68:
                out.append(f"<p><b>{self.prose(yes)}<br>" if r.random() < 0.5 else f"<p><b>{self.some(yes, 3)}</b> {r.choice(self.short)}</p>")
            elif shape < 0.78:
                out.append(self.tag(r.choice(("h2", "h3")), self.some(yes, r.randint(1, 6))))
            elif shape < 0.86:
                out.append("<ul>" + "".join(f"<li>{self.some(yes, r.randint(1, 12))}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
            elif shape < 0.91:
                out.append(f"<blockquote><p>{self.prose(yes)}</p></blockquote>")
            elif shape < 0.95:
                out.append("<table>" + "".join(f"<tr><td>{self.some(yes)}</td><td>{self.some(yes, 2)}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>")
            else:
                out.append(self.part(r.choice(("advert", "related", "form", "share", "notice", "side"))))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        head = [self.part(k) for k in ("notice", "header", "menu", "crumbs", "advert", "form", "share") if r.random() < 0.45]
        tail = [self.part(k) for k in ("share", "related", "comments", "advert", "side", "form", "pager", "footer", "notice") if r.random() < 0.45]
        title = self.tag(r.choice(("h1", "h1", "h2")), self.some("\ue000", r.randint(2, 9)))
        if r.random() < 0.2:
            title = f"<header>{title}</header>"
        inner = (title if r.random() < 0.8 else "") + self.paragraphs()
        for _ in range(r.randint(0, 2)):
            inner = self.tag(r.choice(("div", "section", "div")), inner, r.choice(WRAPS))
        if r.random() < 0.25:
            # What follows an article may stand inside its element.
            inner += tail.pop(0) if tail else ""
        inner = self.tag(r.choice(("article", "main", "div", "section")), inner, r.choice(WRAPS))
        if r.random() < 0.15:
            inner += self.tag("article", self.paragraphs())
        if r.random() < 0.3:
            head, inner = [], "".join(head) + inner
        whole = "".join(head) + (self.tag("main", inner) if r.random() < 0.2 else inner) + "".join(tail)
        for _ in range(r.randint(0, 2)):
            whole = self.tag("div", whole, r.choice(SHELLS))
        return f"<!DOCTYPE html><html><head><title>t</title></head><body>{whole}</body></html>"


def marked(html: str) -> tuple[list[Block], list[float | None]]:
    """Blocks and labels of a drawn page."""
    blocks, labels = [], []
    for b in blocks_of(html):
        label = next((MARKS[c] for c in b.text if c in MARKS), None)
        b.text = " ".join(b.text.translate({ord(c): None for c in MARKS}).split())
        if b.text and label is not None:
            blocks.append(b)
            labels.append(label)
    return blocks, labels


def lessons(pages: list[str], seed: int = 5) -> list[tuple[list[Block], list[float | None]]]:
    """Training sequences of sampled pages: their own blocks by landmarks, and drawn layouts of their text."""
    r = random.Random(seed)
    own = [blocks_of(p, with_words=True) for p in pages]
    texts = [b.text.translate({ord(c): None for c in MARKS})[:400] for blocks in own for b in blocks]
    texts = [t.replace("<", " ").replace("&", " ") for t in texts]
    layout = Layout([t for t in texts if len(t.split()) >= 8], [w for t in texts if len(t.split()) < 8 for w in t.split()] or [w for t in texts for w in t.split()][:5000], r)
    out: list[tuple[list[Block], list[float | None]]] = []
    for blocks in own:
        out.append((blocks, [landmark(b) for b in blocks]))
        out.extend(marked(layout.page()) for _ in range(LAYOUTS))
    return [(blocks[:TRAIN_BLOCKS], labels[:TRAIN_BLOCKS]) for blocks, labels in out if blocks]


def learn(pages: DataFrame, rows: int = TRAIN_PAGES) -> Labeller | None:
    """Fit on about ``rows`` pages (drawn by hash of the html), of each at most ``TRAIN_CHARS`` characters.

    Null pages teach nothing.  None for a table without any page.
    """
    require(pages, "html")
    known = pages.where(F.col("html").isNotNull())
    total, steps = known.count(), 1 << 30
    key = F.pmod(F.xxhash64("html"), F.lit(steps))
    drawn = known.where(key < min(steps, int(steps * rows / max(total, 1)) + 1))
    # Copies of one page share a key: one of each is enough.
    got = drawn.groupBy(key.alias("k")).agg(F.min(F.substring("html", 1, TRAIN_CHARS)).alias("html")).orderBy("k").limit(2 * rows).toArrow()
    texts = got.column("html").to_pylist()
    return fit(lessons(texts)) if texts else None


def extract(pages: DataFrame, model: Labeller | None) -> DataFrame:
    """``pages`` with ``text``, ``n_chars`` (code points), ``n_blocks`` and ``n_kept``, without ``html``.

    ``text`` is the blocks labelled as main text, in page order, joined by one space.  A null, empty or
    text-free page has an empty text.  Without a model (no page to learn from) every block is kept.  Very
    long pages are passes of their own.  Repeated rows and null ids: each row for itself.  Empty table: no
    rows.  Other columns are kept; a column named like a new one is replaced.  One pass, no shuffle.
    """
    require(pages, "html")
    shared = pages.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # some 300 KB
    names = [c for c in pages.columns if c not in ("html", "text", "n_chars", "n_blocks", "n_kept")]
    kept = pages.select("html", *[F.col(f"`{c}`") for c in names])
    # Names with dots are no arguments of an Arrow function.
    plain = kept.toDF("html", *[f"c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller: Labeller | None = pickle.loads(shared.value)
        for batch in passes(batches, "html", PASS_BYTES):
            found = [blocks_of(h) for h in batch.column(0).to_pylist()]
            x = encode(found)
            keep = labeller.forward(x)[0].round(PLACES) >= 0.5 if labeller and x.rows[-1] else np.ones(int(x.rows[-1]), bool)
            texts = [" ".join(b.text for b, k in zip(blocks, keep[a:]) if k) for blocks, a in zip(found, x.rows)]
            total = np.concatenate([[0], np.cumsum(keep)])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(1, batch.num_columns)),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(np.diff(x.rows), pa.int64()),
                    pa.array(total[x.rows[1:]] - total[x.rows[:-1]], pa.int64()),
                ],
                [*names, "text", "n_chars", "n_blocks", "n_kept"],
            )

    schema = StructType(kept.schema.fields[1:])
    for name, kind in (("text", "string"), ("n_chars", "long"), ("n_blocks", "long"), ("n_kept", "long")):
        schema = schema.add(name, kind)
    return plain.mapInArrow(run, schema)
