"""Toxicity scores from a learned lexicon, matched by Levenshtein automata over a trie.

Terms that mark toxic documents are learned from labels.  They are kept in a trie; the Levenshtein
automata of all words, intersected with that trie, form one deterministic automaton whose states
are built when they are first met, so a word costs one table look-up per letter.  It accepts
misspelled terms.  Every hit is seen in its window: quotation marks and reporting words speak for
quotation, address and further hits for abuse.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.labelled import TRAIN_ROWS, labelled_sample
from gridloom.llm.text import array_column, passes, require

#: A word: letters, with single digits or signs between them as in "id1ot".
TOKEN = re.compile(r"[^\W\d_]+(?:[0-9@$*!|+][^\W\d_]+)*")
SIGN = re.compile(r"[^\W\d_]")
#: Least document frequency of a term among toxic documents (rows, and per mille of them), and
#: its least log odds.
MIN_DOCS, MIN_PER_MILLE, MIN_ODDS = 3, 4, 2.5
#: Words on either side of a hit that its window holds.
WINDOW = 8
#: Entries that a worker keeps of judged words, and of automaton states, before it starts afresh.
WORD_CACHE, STATE_CACHE = 400_000, 60_000

#: Fixed word lists of the window test.
REPORTING = frozenset(
    "said says say wrote writes written called calls quote quoted quotes term word words phrase slur reported "
    "according insult insults dit disait écrit appelé terme mot sagte sagt schrieb nannte wort begriff dijo dice "
    "escribió llamó palabra término".split()
)
ADDRESS = frozenset("you your yours youre u tu te toi vous ton ta du dich dir dein deine ihr usted ustedes tú ti".split())
#: Quotation marks, and what closes each that can open.
MARK = re.compile('["“”«»„]')
CLOSES = {'"': '"', "“": "”", "«": "»", "„": "“”"}

FEATURES = ("abuse", "quoted", "misspelled", "window", "density", "terms", "address", "length")


def edits(term: str) -> int:
    """Edits within which a term is recognised: none below 5 letters, one below 9, else two."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


def quotations(text: str) -> tuple[list[int], list[int]]:
    """Begins and ends of the quotations of a text, of any length and over any lines, in one scan.

    A mark that closes nothing and opens nothing is passed over; a quotation that is never closed is none.
    """
    begins, ends, opened, at = [], [], "", 0
    for m in MARK.finditer(text):
        mark = m.group()
        if opened and mark in CLOSES[opened]:
            begins.append(at)
            ends.append(m.end())
            opened = ""
        elif not opened and mark in CLOSES:
            opened, at = mark, m.start()
    return begins, ends


class LexiconAutomaton:
    """All words within ``edits(term)`` of some term, as one lazily built deterministic automaton."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.term_at: list[int] = [-1]
        self.slack: list[int] = [0]
        for k, term in enumerate(terms):
            node, d = 0, edits(term)
            self.slack[0] = max(self.slack[0], d)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term_at.append(-1)
                    self.slack.append(0)
                node = self.children[node][c]
                self.slack[node] = max(self.slack[node], d)
            self.term_at[node] = k
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[tuple[tuple[int, int], ...], int] = {(): 0}
        self.states: list[tuple[tuple[int, int], ...]] = [()]
        self.accepts: list[tuple[int, int] | None] = [None]
        self.moves: list[dict[str, int]] = [{}]
        self.start = self._state({0: 0})

    def _state(self, at: dict[int, int]) -> int:
        """The state of these trie nodes with their least edits, closed under letters left out."""
        todo = list(at.items())
        while todo:
            node, e = todo.pop()
            if at[node] < e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.slack[child] and at.get(child, 9) > e + 1:
                    at[child] = e + 1
                    todo.append((child, e + 1))
        key = tuple(sorted(at.items()))
        got = self.ids.get(key)
        if got is None:
            got = self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            best = [(e, self.term_at[n]) for n, e in key if self.term_at[n] >= 0 and e <= edits(self.terms[self.term_at[n]])]
            self.accepts.append(min(best) if best else None)
        return got

    def _move(self, state: int, c: str) -> int:
        at: dict[int, int] = {}
        for node, e in self.states[state]:
            if e + 1 <= self.slack[node] and at.get(node, 9) > e + 1:
                at[node] = e + 1  # an extra letter
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.slack[child] and at.get(child, 9) > cost:
                    at[child] = cost
        return self._state(at) if at else 0

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term number) of the nearest term, the first of equals; None if no term is near."""
        if len(self.states) > STATE_CACHE:
            self._reset()
        state, moves = self.start, self.moves
        for c in word:
            nxt = moves[state].get(c)
            if nxt is None:
                nxt = moves[state][c] = self._move(state, c)
            if not nxt:
                return None
            state = nxt
        return self.accepts[state]


@dataclass
class Lexicon:
    """Terms with weights; ``benign`` are words near a term that clean documents use."""

    terms: list[str]
    weights: list[float]
    benign: frozenset[str] = frozenset()
    coefficients: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    _automaton: LexiconAutomaton | None = field(default=None, repr=False)
    _words: dict[str, tuple[float, int] | None] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state):
        self.__dict__.update(state, _automaton=None, _words={})

    @property
    def automaton(self) -> LexiconAutomaton:
        if self._automaton is None:
            self._automaton = LexiconAutomaton(self.terms)
        return self._automaton

    def judge(self, word: str) -> tuple[float, int] | None:
        """(weight, edits) of the term that a word spells, or None."""
        if len(self._words) >= WORD_CACHE:
            self._words.clear()
        got = None
        near = self.automaton.match(word) if len(word) >= 3 else None
        if near is None and len(word) < 5 and not word.isalpha():
            near = self._masked(word)
        if near is not None and (near[0] == 0 or word not in self.benign):
            got = (self.weights[near[1]] / (1 + near[0]), near[0])
        self._words[word] = got
        return got

    def _masked(self, word: str) -> tuple[int, int] | None:
        """A term of three or four letters, one of which the word shows as a digit or a sign."""
        signs = [i for i, c in enumerate(word) if not SIGN.match(c)]
        if len(signs) == 1:
            i = signs[0]
            for k, term in enumerate(self.terms):
                if len(term) == len(word) and term[:i] == word[:i] and term[i + 1 :] == word[i + 1 :]:
                    return 1, k
        return None

    def hits(self, text: str) -> tuple[list[str], list[tuple[int, float, int]]]:
        """Words of a text, and (place, weight, edits) of those that spell a term."""
        tokens = TOKEN.findall(text.lower())
        known, judge = self._words, self.judge
        out = []
        for i, w in enumerate(tokens):
            got = known[w] if w in known else judge(w)
            if got is not None:
                out.append((i, *got))
        return tokens, out

    def features(self, text: str, tokens: list[str] | None = None, hits: list[tuple[int, float, int]] | None = None) -> list[float]:
        if tokens is None or hits is None:
            tokens, hits = self.hits(text)
        n = len(tokens)
        if not hits:
            return [0.0] * 7 + [np.log1p(n)]
        quoted_places: set[int] = set()
        low = text.lower()
        begins, ends = quotations(low)
        if begins:
            wanted = {i for i, _, _ in hits}
            for i, m in enumerate(TOKEN.finditer(low)):
                if i in wanted:
                    q = bisect_right(begins, m.start()) - 1
                    if q >= 0 and m.start() < ends[q]:
                        quoted_places.add(i)
        abuse = quoted = misspelled = address = best = 0.0
        lo = 0
        places = [h[0] for h in hits]
        for k, (i, weight, e) in enumerate(hits):
            near = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
            reported = i in quoted_places or not REPORTING.isdisjoint(near)
            direct = not ADDRESS.isdisjoint(near)
            while places[lo] < i - WINDOW:
                lo += 1
            window = 0.0
            for j in range(lo, len(hits)):
                if places[j] > i + WINDOW:
                    break
                window += hits[j][1]
            if reported and not direct:
                quoted += weight
                window *= 0.5
            else:
                abuse += weight
            misspelled += weight * (e > 0)
            address += direct
            best = max(best, window)
        terms = len({tokens[i] for i in places})
        return [np.log1p(abuse), np.log1p(quoted), np.log1p(misspelled), best, 100 * len(hits) / n, np.log1p(terms), np.log1p(address), np.log1p(n)]

    def score(self, text: str, tokens: list[str] | None = None, hits: list[tuple[int, float, int]] | None = None) -> float:
        if self.coefficients is None:
            return 0.0
        z = (np.asarray(self.features(text, tokens, hits)) - self.mean) / self.scale
        return float(1 / (1 + np.exp(-np.clip(z @ self.coefficients[1:] + self.coefficients[0], -30, 30))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept comes first and is not shrunk."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 3, held_out: int = 1, rows: int = TRAIN_ROWS) -> Lexicon:
    """Terms, benign lookalikes and the weights of the features.

    About ``rows`` labelled documents outside the held-out fold are used: two thirds for the terms,
    the others for the weights, so that the weights see terms as unseen documents do.  What
    reaches the driver is the lexicon and one row of numbers per document of the sample.
    """
    sample = labelled_sample(docs, labels, label, modulus, held_out, rows)
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches):
            seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[y].update({w for w in TOKEN.findall((text or "").lower()) if len(w) >= 3})
            vocabulary = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(vocabulary, pa.string()), *(pa.array([seen[y][w] for w in vocabulary], pa.int64()) for y in (1, 0))],
                ["word", "pos", "neg"],
            )

    for_terms = sample.where(part != 0).select("text", "label")
    totals = {r["label"]: r["n"] for r in for_terms.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = totals.get(1, 0), totals.get(0, 0)
    if not n_pos or not n_neg:
        return Lexicon([], [])
    counted = for_terms.mapInArrow(count, "word string, pos long, neg long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
    least = max(MIN_DOCS, n_pos * MIN_PER_MILLE / 1000)
    counted = counted.withColumn("odds", odds).persist()
    found = sorted((r["word"], r["odds"]) for r in counted.where((F.col("pos") >= least) & (F.col("odds") >= MIN_ODDS)).select("word", "odds").collect())
    lexicon = Lexicon([w for w, _ in found], [round(o, 6) for _, o in found])
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(lexicon))

    def lookalikes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(sent.value)
        for batch in batches:
            near = [(m := known.automaton.match(w)) is not None and m[0] > 0 for w in batch.column(0).to_pylist()]
            yield batch.filter(pa.array(near, pa.bool_()))

    clean = counted.where((F.col("neg") >= 1) & (F.col("odds") < 1)).select("word").mapInArrow(lookalikes, "word string")
    lexicon.benign = frozenset(r["word"] for r in clean.collect())
    counted.unpersist()
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(lexicon))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(sent.value)
        for batch in passes(batches):
            x = np.array([known.features(t or "") for t in batch.column(1).to_pylist()])
            at = np.arange(len(x) + 1) * len(FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), array_column(x.ravel(), at, pa.float64()), batch.column(2)], ["doc_id", "x", "label"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sample.where(part == 0).mapInArrow(describe, f"doc_id {kind}, x array<double>, label int").toArrow().sort_by("doc_id")
    y = np.asarray(got.column("label"), np.float64)
    if len(y) and 0 < y.mean() < 1:
        x = np.array(got.column("x").to_pylist())
        lexicon.mean, lexicon.scale = x.mean(0), x.std(0) + 1e-3
        lexicon.coefficients = fit_logistic((x - lexicon.mean) / lexicon.scale, y)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, score, n_hits, n_misspelled, spans`` for every row of ``docs``.

    ``spans`` lists the words that spell a term, as (place in words, word, edits).  ``score`` is
    between 0 and 1.  A null or empty text has no hit and gets the score of an empty text.  Without
    a model (no labels of both kinds) every score is 0.  Null ids and repeated rows: each row for
    itself.  Empty table: no rows.  Other columns are ignored.  One pass, no shuffle.
    """
    require(docs, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(lexicon))  # bounded by the sample
    span = pa.struct([("place", pa.int64()), ("word", pa.string()), ("edits", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(shared.value)
        for batch in passes(batches):
            value, spans = [], []
            for text in batch.column(1).to_pylist():
                tokens, hits = known.hits(text or "")
                value.append(known.score(text or "", tokens, hits))
                spans.append([{"place": i, "word": tokens[i], "edits": e} for i, _, e in hits])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(value, pa.float64()),
                    pa.array([len(s) for s in spans], pa.int64()),
                    pa.array([sum(x["edits"] > 0 for x in s) for s in spans], pa.int64()),
                    pa.array(spans, pa.list_(span)),
                ],
                ["doc_id", "score", "n_hits", "n_misspelled", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, score double, n_hits long, n_misspelled long, spans array<struct<place:long,word:string,edits:long>>"
    )
