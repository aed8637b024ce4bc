"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages.  Every passage is encoded; gated attention weights, learned from
document labels alone, say how much each passage counts; the weighted passage representation is
scored.  One bad page in a long clean document can so decide, or be outweighed.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.labelled import TRAIN_ROWS, labelled_sample
from gridloom.llm.quality_rules import DIGIT, LETTER, MARK, SYMBOLS, UPPER
from gridloom.llm.text import WHITE, SpanHash, Words, array_column, mix, passes, require, separator_table, shingles, words

#: Words of a passage.
PASSAGE = 64
FEATURES = 17
COMMA = separator_table(b",;:")
STOP = separator_table(b".")
OTHER = separator_table([b for b in range(0x21, 0x7F) if not (LETTER[b] or DIGIT[b] or MARK[b] or SYMBOLS[b] or COMMA[b] or STOP[b])])


def _runs(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags: first of its value in its row; value occurs more than once in its row."""
    key = mix(value ^ mix(row.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    first, often = np.zeros(len(key), bool), np.zeros(len(key), bool)
    first[order] = ~same[:-1]
    often[order] = same[:-1] | same[1:]
    return first, often


def encode(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of a batch of texts, and the row offsets of the passages.

    A text without words is one passage of zeros.
    """
    w: Words = words(text, WHITE)
    n = w.counts
    parts = np.maximum(-(-n // PASSAGE), 1)
    rows = np.concatenate([[0], np.cumsum(parts)])
    owner = np.repeat(np.arange(len(n)), parts)
    index = np.arange(rows[-1]) - rows[owner]
    a = np.minimum(w.rows[owner] + index * PASSAGE, w.rows[owner + 1])
    b = np.minimum(a + PASSAGE, w.rows[owner + 1])
    size = np.maximum(b - a, 1).astype(np.float64)
    out = np.zeros((len(owner), FEATURES))
    if not len(w.starts):
        return out, rows

    full = b > a
    lo = np.where(full, w.starts[np.minimum(a, len(w.starts) - 1)], 0)
    hi = np.where(full, w.ends[np.maximum(b - 1, 0)], 0)
    data = w.data

    def between(flags: np.ndarray, x: np.ndarray = lo, y: np.ndarray = hi) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return (total[y] - total[x]).astype(np.float64)

    lead = ((data & 0xC0) != 0x80) & ~WHITE[data]
    chars = np.maximum(between(lead), 1)
    letters = np.maximum(between(LETTER[data]), 1)
    hashes = SpanHash(data)(w.starts, w.ends)
    passage_of = np.repeat(np.arange(len(owner)), b - a)
    first, _ = _runs(passage_of, hashes)
    gram, grows = shingles(hashes, w.rows, 3)
    _, often = _runs(np.repeat(np.arange(len(n)), np.diff(grows)), gram)
    again = np.zeros(len(hashes), bool)
    again[np.arange(len(gram)) - np.repeat(grows[:-1] - w.rows[:-1], np.diff(grows))] = often
    follows = np.zeros(len(hashes), bool)
    follows[1:] = (hashes[1:] == hashes[:-1]) & (passage_of[1:] == passage_of[:-1])
    start_byte, end_byte = data[w.starts], data[w.ends - 1]
    columns = [
        full.astype(np.float64),
        np.log1p(b - a),
        np.log(chars / size),
        between(UPPER[data]) / letters,
        between(DIGIT[data]) / chars,
        between(SYMBOLS[data]) / size,
        between(MARK[data]) / size,
        between(COMMA[data]) / size,
        between(STOP[data]) / size,
        between(OTHER[data]) / size,
        between(data == 0x0A) / size,
        between(data >= 0xC0) / chars,
        between(follows, a, b) / size,
        between(first, a, b) / size,
        between(again, a, b) / size,
        between(UPPER[start_byte], a, b) / size,
        between(SYMBOLS[end_byte] | MARK[end_byte], a, b) / size,
    ]
    out[:] = np.stack(columns, 1) * full[:, None]
    return out, rows


#: Places to which scores are rounded before they are compared or returned.
PLACES = 12


def rows_times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``x @ w`` summed column by column, so that a row's result does not depend on its neighbours."""
    out = x[:, 0, None] * w[0] if w.ndim == 2 else x[:, 0] * w[0]
    for j in range(1, len(w)):
        out += x[:, j, None] * w[j] if w.ndim == 2 else x[:, j] * w[j]
    return out


@dataclass
class Bags:
    """Gated attention over encoded passages; ``fit`` learns everything from bag labels."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    @staticmethod
    def start(mean: np.ndarray, scale: np.ndarray, hidden: int, gate: int, rng: np.random.Generator) -> Bags:
        def draw(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

        f = len(mean)
        w = {"W": draw(f, hidden), "b": np.zeros(hidden), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate), "c": draw(hidden), "d": np.zeros(1)}
        return Bags(mean, scale, w)

    def forward(self, x: np.ndarray, rows: np.ndarray):
        p = self.weights
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(rows_times(z, p["W"]) + p["b"])
        t, s = np.tanh(rows_times(h, p["V"])), 1 / (1 + np.exp(-rows_times(h, p["U"])))
        e = rows_times(t * s, p["w"])
        owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        e = np.exp(e - np.maximum.reduceat(e, rows[:-1])[owner])
        a = e / np.add.reduceat(e, rows[:-1])[owner]
        m = np.add.reduceat(a[:, None] * h, rows[:-1], axis=0)
        score = 1 / (1 + np.exp(-np.clip(rows_times(m, p["c"]) + p["d"], -30, 30)))
        return score, a, (z, h, t, s, m, owner)

    def gradient(self, x: np.ndarray, rows: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        score, a, (z, h, t, s, m, owner) = self.forward(x, rows)
        dl = (score - y) / len(y)
        dm = (dl[:, None] * p["c"])[owner]
        da = (h * dm).sum(1)
        de = a * (da - np.add.reduceat(a * da, rows[:-1])[owner])
        dg = de[:, None] * p["w"]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = a[:, None] * dm + dt @ p["V"].T + ds @ p["U"].T
        dz = dh * (1 - h * h)
        return {"W": z.T @ dz, "b": dz.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": m.T @ dl, "d": np.array([dl.sum()])}


def fit(x: np.ndarray, rows: np.ndarray, y: np.ndarray, hidden: int = 16, gate: int = 8, epochs: int = 12, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Bags:
    """Adam on the log loss of bag labels; the same input gives the same model."""
    rng = np.random.default_rng(seed)
    model = Bags.start(x.mean(0), x.std(0) + 1e-3, hidden, gate, rng)
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step, n = 0, len(y)
    for epoch in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            pick = order[at : at + batch]
            size = np.diff(rows)[pick]
            part = np.concatenate([[0], np.cumsum(size)])
            take = np.arange(part[-1]) + np.repeat(rows[pick] - part[:-1], size)
            step += 1
            for k, g in model.gradient(x[take], part, y[pick]).items():
                g = g + decay * model.weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                lr = rate * (1 - epoch / epochs)
                model.weights[k] = model.weights[k] - lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, held_out: int = 0, rows: int = TRAIN_ROWS) -> Bags | None:
    """Fit on about ``rows`` labelled documents outside the held-out fold; None if there is no label.

    Whole texts are encoded where they are read; what reaches the driver is one row of numbers
    per passage of the sample.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches):
            x, at = encode(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), array_column(x.astype(np.float32).ravel(), at * FEATURES, pa.float32()), batch.column(2)],
                ["doc_id", "x", "label"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = labelled_sample(docs, labels, label, modulus, held_out, rows)
    got = sample.mapInArrow(run, f"doc_id {kind}, x array<float>, label int").toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by("doc_id").combine_chunks()
    column = got.column("x").chunk(0)
    at = np.asarray(column.offsets, np.int64) // FEATURES
    x = np.asarray(column.flatten(), np.float64).reshape(-1, FEATURES)
    return fit(x, at - at[0], np.asarray(got.column("label"), np.float64))


def score(docs: DataFrame, model: Bags | None) -> DataFrame:
    """``doc_id, score, passages, top_passage, top_weight`` for every row of ``docs``.

    ``score`` is between 0 and 1, higher for label 1; ``top_passage`` (from 0) is the passage with
    the largest attention weight.  A null or empty text is one empty passage.  Without a model
    (nothing was labelled) every score is 0.5.  Equal texts have equal scores, whatever batch they
    stand in.  Null ids and repeated rows: each row for itself.
    Empty table: no rows.  Other columns are ignored.  One pass, no shuffle.
    """
    require(docs, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # some KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags: Bags | None = pickle.loads(shared.value)
        for batch in passes(batches):
            x, at = encode(batch.column(1))
            if bags is None:
                value, a = np.full(len(at) - 1, 0.5), np.repeat(1 / np.diff(at), np.diff(at))
            else:
                value, a, _ = bags.forward(x, at)
                value, a = value.round(PLACES), a.round(PLACES)
            owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
            top = np.lexsort((np.arange(len(a)), -a, owner))[at[:-1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(value), pa.array(np.diff(at), pa.int64()), pa.array(top - at[:-1], pa.int64()), pa.array(a[top])],
                ["doc_id", "score", "passages", "top_passage", "top_weight"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, score double, passages long, top_passage long, top_weight double"
    )


def keep_good(docs: DataFrame, model: Bags | None, threshold: float) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches ``threshold``.

    Edge cases as in ``score``; any column may be null and of any type that Arrow carries.
    """
    require(docs, "text")
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags: Bags | None = pickle.loads(shared.value)
        for batch in passes(batches):
            good = bags.forward(*encode(batch.column(at)))[0].round(PLACES) >= threshold if bags else np.full(batch.num_rows, threshold <= 0.5)
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)

