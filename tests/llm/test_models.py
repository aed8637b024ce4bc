"""Learned operators: held-out accuracy, brute force, gradients, and odd input."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import quality_classifier, suffix_tree, toxicity
from gridloom.llm.text import passes
from tests.llm.conftest import speak

SF = "/root/testdata/sf0.01"


def test_lexicon_automaton_is_the_edit_distance():
    def distance(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    r = random.Random(1)
    terms = sorted({"".join(r.choice("abcd") for _ in range(r.randint(3, 11))) for _ in range(60)})
    auto = toxicity.LexiconAutomaton(terms)
    for _ in range(3000):
        word = "".join(r.choice("abcde") for _ in range(r.randint(1, 12)))
        near = [(distance(word, t), i) for i, t in enumerate(terms) if distance(word, t) <= toxicity.edits(t)]
        assert auto.match(word) == (min(near) if near else None)


def test_misspellings_and_quotation():
    lexicon = toxicity.Lexicon(["horrible", "wretched"], [4.0, 4.0], frozenset({"horrable"}))
    assert [h[2] for h in lexicon.hits("horrible horible HORRIBLE wretchd")[1]] == [0, 1, 0, 1]
    assert lexicon.hits("horrable terrible")[1] == []
    abuse = lexicon.features("you are a horrible wretched thing")
    quote = lexicon.features('the report said "horrible wretched" was the word that was used')
    assert abuse[0] > 0 == abuse[1] and quote[1] > 0 == quote[0]
    assert abuse[3] > quote[3] and lexicon.features("")[:7] == [0.0] * 7


def test_letters_as_digits_long_quotations_and_long_texts():
    import time

    lexicon = toxicity.Lexicon(["idiot", "moron", "scum"], [4.0, 4.0, 4.0])
    assert [h[0] for h in lexicon.hits("an id1ot, a mor0n and sc*m; 1diot")[1]] == [1, 3, 5, 6]
    assert lexicon.hits("scam sum 12 a1b")[1] == []
    far = "“first line\n" + "word " * 300 + "idiot” it went on"
    assert lexicon.features(far)[0] == 0 < lexicon.features(far)[1]
    assert lexicon.features('never "closed idiot')[1] == 0
    assert toxicity.quotations('a "b" «c» “d” „e“ "f') == ([2, 6, 10, 14], [5, 9, 13, 17])
    start = time.time()
    lexicon.features('he "idiot" and ' * 100_000)
    assert time.time() - start < 20


def labelled(spark, kind):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    truth = {r["doc_id"]: r[kind] for r in labels.collect()}
    return docs, labels, truth


def test_toxicity_held_out(llm):
    docs, labels, truth = labelled(llm, "toxic")
    # Junk pages of this table are made over after they were labelled; toxic ones among them have
    # lost their terms.
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    truth = {i: y for i, y in truth.items() if y == 0 or i in good}
    got = toxicity.score(docs, toxicity.learn(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    held = [(truth[r["doc_id"]], r["score"]) for r in got if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    clean, toxic = [s for y, s in held if y == 0], [s for y, s in held if y == 1]
    assert np.mean([s >= 0.7 for s in clean]) < 0.02
    assert np.mean([s > np.median(clean) for s in toxic]) > 0.85


def test_toxicity_of_odd_tables(llm, messy, nothing):
    none = llm.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    lexicon = toxicity.learn(messy, none)
    assert {r["score"] for r in toxicity.score(messy, lexicon).collect()} == {0.0}
    assert toxicity.score(nothing, lexicon).count() == 0


def test_quality_held_out(llm):
    docs, labels, truth = labelled(llm, "quality")
    model = quality_classifier.learn(docs, labels)
    got = quality_classifier.score(docs, model).collect()
    held = [(truth[r["doc_id"]], r["score"]) for r in got if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    right = np.mean([(s >= 0.3) == bool(y) for y, s in held])
    assert len(got) == docs.count() and right > 0.95


def test_quality_of_odd_tables(llm, messy, nothing):
    none = llm.createDataFrame([], "doc_id long, quality int")
    assert quality_classifier.learn(messy, none) is None
    assert {r["score"] for r in quality_classifier.score(messy, None).collect()} == {0.5}
    few = llm.createDataFrame([(4, 1), (5, 1), (6, 0), (7, 0), (7, None)], "doc_id long, quality int")
    model = quality_classifier.learn(messy, few)
    got = quality_classifier.score(messy, model).collect()
    assert len(got) == messy.count() and all(0 <= r["score"] <= 1 for r in got)
    kept = quality_classifier.keep_good(messy, model, 0.0)
    assert kept.columns == messy.columns and kept.count() == messy.count()
    assert quality_classifier.keep_good(nothing, model, 0.3).count() == 0
    same = [r["score"] for r in got if r["doc_id"] in (1, 2, 3)]
    assert len(set(same)) == 1


def test_gradient_of_the_bags():
    rng = np.random.default_rng(0)
    x, rows, y = rng.normal(size=(11, 4)), np.array([0, 3, 4, 9, 11]), np.array([1.0, 0, 1, 0])
    bags = quality_classifier.Bags.start(x.mean(0), x.std(0), 5, 3, rng)

    def loss():
        s = bags.forward(x, rows)[0]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for name, g in bags.gradient(x, rows, y).items():
        w = bags.weights[name]
        for at in list(np.ndindex(w.shape))[:6]:
            old = w[at]
            w[at] = old + 1e-6
            up = loss()
            w[at] = old - 1e-6
            down = loss()
            w[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-5)


# --- suffix tree ----------------------------------------------------------------

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_base(rows, held):
    words = [(re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) + [None]) for _, t in rows]
    c = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    n, norm = sum(c.values()), sum(c.values()) + 0.1 * (len(c) + 1)
    return [(len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / norm) for w in ws)) for ws in words]


@pytest.mark.parametrize("common", [1e-6, 0.05, 2.0])
def test_base_scores_match_plain_python(llm, common):
    rows = [(i, speak(i, 3 + i % 40)) for i in range(80)] + [(90, None), (91, ""), (None, "alpha1 alpha1"), (92, "Ünïcode ALPHA1"), (3, speak(3, 6))]
    rows += [rows[5], rows[5]]
    held = [i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    got = suffix_tree.score(docs, suffix_tree.outside_fold(10, 0), common).collect()
    want = sorted((str(i), h, *b[:3], round(b[3], 6)) for (i, _), h, b in zip(rows, held, plain_base(rows, held)))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def grown(texts, least=1.0, divergence=0.0):
    keys = []
    for batch in passes([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]):
        w, _ = suffix_tree._read(batch.column(0))
        keys.append(suffix_tree.grams(*suffix_tree.stream(w)))
    code, n = suffix_tree.tally(np.concatenate(keys))
    parts = [suffix_tree.tally(code & ((1 << (8 * (d + 1))) - 1), n) for d in range(suffix_tree.DEPTH + 1)]
    level = np.concatenate([np.full(len(k), d) for d, (k, _) in enumerate(parts)])
    entry, count = (np.concatenate([p[j] for p in parts]) for j in (0, 1))
    return suffix_tree.prune(level, entry, count, least, suffix_tree.DEPTH, divergence)


def test_distributions_sum_to_one_and_states_are_longest():
    tree = grown([speak(i, 30) for i in range(40)], least=3.0, divergence=0.05)
    for before in (b"\n\n\n\n\n", b"alpha", b" beta", b"\xff\x00zzq", b"kappa"):
        context = sum(c << (8 * (d + 1)) for d, c in enumerate(before[::-1]))
        p = tree.probability(np.array([context | b for b in range(256)], np.int64))
        assert p.sum() == pytest.approx(1.0) and (p > 0).all()
    for d in range(1, suffix_tree.DEPTH):
        shorter = tree.contexts[d] & ((1 << (8 * d)) - 1)
        assert np.isin(shorter, tree.contexts[d - 1]).all()
    # A harder divergence test keeps fewer contexts.
    harder = grown([speak(i, 30) for i in range(40)], least=3.0, divergence=0.5)
    assert sum(map(len, harder.contexts)) < sum(map(len, tree.contexts))


def test_streams_of_rows():
    w, _ = suffix_tree._read(pa.array(["Ab  c", "", None, "x"]))
    out, rows = suffix_tree.stream(w)
    assert out.tobytes() == b"ab c\n\n\nx\n" and rows.tolist() == [0, 5, 6, 7, 9]


def test_scores_of_odd_tables(messy, nothing):
    got = suffix_tree.score(messy, suffix_tree.outside_fold(10, 0)).collect()
    assert len(got) == messy.count()
    assert suffix_tree.score(nothing, suffix_tree.outside_fold(10, 0)).count() == 0
    from pyspark.sql import functions as F

    alone = suffix_tree.score(messy, F.lit(False)).collect()
    assert {r["n_known"] for r in alone} == {0} and {r["train_tokens"] for r in alone} == {0}
