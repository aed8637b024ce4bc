"""Operators that compare texts with each other: against brute force, and on odd input."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import dart_minhash, decontaminate, line_dedup
from gridloom.llm.components import components
from tests.llm.conftest import LONG, speak

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def union(items, links):
    up = {i: i for i in items}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


def test_components(llm):
    r = random.Random(2)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(500, i) for i in range(501, 560)] + [(i, i + 1) for i in range(600, 640)]
    got = {x["node"]: x["root"] for x in components(llm.createDataFrame([*links, (7, 7), (None, 3)], "a long, b long")).collect()}
    nodes = {n for pair in links for n in pair if pair[0] != pair[1]}
    assert got == {n: c for n, c in union({n for p in links for n in p}, links).items() if n in nodes}
    assert components(llm.createDataFrame([], "a long, b long")).count() == 0


# --- decontamination ------------------------------------------------------------


def plain_hits(text, items, width=10):
    w = ALNUM.findall((text or "").translate(LOW))
    hit, found = set(), set()
    for item, t in items:
        v = ALNUM.findall((t or "").translate(LOW))
        n = min(width, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                if item is not None:
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("limit", [50_000, 0])
def test_windows_match_plain_python(table, llm, limit):
    items = [(i, speak(1000 + i, 8 + 3 * i)) for i in range(12)]
    items += [(50, "Two words"), (51, "  ... "), (52, None), (None, speak(77, 12)), (53, speak(1003, 17)), (54, "É ß 😀 x"), (55, speak(9, 30, ("one", "two")))]
    rows = []
    for i in range(60):
        item = items[i % 12][1].split()
        rows.append((i, speak(i, 20) + " " + " ".join(item[i % 4 : i % 4 + 6 + i % 9]) + ", " + speak(i + 100, 700 if i % 20 == 0 else 9), "s"))
    rows += [(70, "x TWO-words", "s"), (71, None, "s"), (72, "", "s"), (None, items[15][1], "s"), (73, items[4][1].upper(), "s"), (73, "other", "s")]
    rows += [(74, "É ß 😀 x", "s"), (75, items[18][1] + " " + items[18][1], "s"), rows[2], rows[2]]
    got = decontaminate.contamination(table(rows), llm.createDataFrame(items, "item_id long, text string"), broadcast_rows=limit).collect()
    want = sorted((str(i), *plain_hits(t, items)) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["item_ids"]) for r in got) == want
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in got)


def test_decontamination_is_native(messy, llm):
    plan = decontaminate.contamination(messy, llm.createDataFrame([(1, "a b")], "item_id long, text string"))
    text = plan._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", text) and "Cartesian" not in text


def test_decontamination_of_odd_tables(messy, nothing, llm):
    none = llm.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(nothing, none).count() == 0
    got = decontaminate.contamination(messy, none).collect()
    assert len(got) == messy.count() and not any(r["contaminated"] for r in got)
    item = llm.createDataFrame([(1, "the same line of some length")], "item_id long, text string")
    left = decontaminate.clean(messy, item)
    assert left.columns == messy.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(["1", "2", "3", "4", "5", "None", "7", "9"])


# --- near-duplicates ------------------------------------------------------------


def shingled(t):
    w = ALNUM.findall((t or "").translate(LOW))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def family(seed, copies, changes, n=60):
    r = random.Random(seed)
    base = speak(seed, n).split()
    out = []
    for i in range(copies):
        w = base[:]
        for _ in range(r.randint(0, changes)):
            w[r.randrange(n)] = f"new{r.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


def test_classes_match_brute_force(table):
    texts = [t for s in range(6) for t in family(s, 6, 2)] + family(99, 90, 6) + [speak(i, 40) for i in range(200, 220)] + ["a b", "A, b!", "a b c"]
    texts += [texts[0]] * 4 + [" ".join(["x y z v w"] * k) for k in (5, 6, 9)]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    sets = {i: shingled(t) for i, t, _ in rows}
    links = [(i, j) for i in sets for j in range(i) if similarity(sets[i], sets[j]) >= 0.8]
    got = dart_minhash.near_duplicates(table(rows)).collect()
    classes = {r["doc_id"]: r["class_id"] for r in got}
    assert classes == union(sets, links)
    assert {r["doc_id"] for r in got if r["keeper"]} == set(classes.values())
    sizes = Counter(classes.values())
    assert all(r["class_size"] == sizes[r["class_id"]] for r in got)


def test_signatures_estimate_weighted_similarity():
    a, b = "x y z v w " * 30 + speak(1, 80), "x y z v w " * 20 + speak(1, 80)
    cell, rows, _ = dart_minhash.cells(pa.array([a, b, None]))
    s = dart_minhash.signatures(cell, rows, 6000)
    assert (s[0] == s[1]).mean() == pytest.approx(similarity(shingled(a), shingled(b)), abs=0.03)
    assert (s[2] == 0).all() and (s[:2] != 0).all()


def test_signatures_do_not_depend_on_company():
    texts = [speak(i, 5 + 40 * i) for i in range(8)] + ["a", LONG[:20_000]]
    together = dart_minhash.signatures(*dart_minhash.cells(pa.array(texts))[:2], 64)
    for i, t in enumerate(texts):
        assert (dart_minhash.signatures(*dart_minhash.cells(pa.array([t]))[:2], 64)[0] == together[i]).all()


def test_near_duplicates_of_odd_tables(messy, nothing):
    assert dart_minhash.near_duplicates(nothing).count() == 0
    got = dart_minhash.near_duplicates(messy).collect()
    assert len(got) == messy.count()
    assert sorted(str(r["doc_id"]) for r in got if r["class_id"] == 5 and r["class_size"] == 4) == ["5", "5", "8", "None"]
    kept = dart_minhash.keep_one(messy)
    assert kept.columns == messy.columns
    # One of the two equal rows of id 5 stays, and the other text of that id.
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "5", "None", "6", "7", "9"])


# --- lines ----------------------------------------------------------------------


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def edited(r, s, most):
    t = list(s)
    for _ in range(r.randint(0, most)):
        kind, i = r.randint(0, 2), r.randrange(len(t)) if t else 0
        if kind == 0 or not t:
            t.insert(i, r.choice("abé"))
        elif kind == 1:
            del t[i]
        else:
            t[i] = r.choice("abc")
    return "".join(t)


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_banded_distance(edits):
    r = random.Random(edits)
    first = ["".join(r.choice("abc") for _ in range(r.randint(0, 15))) for _ in range(1500)]
    second = [edited(r, s, edits + 2) for s in first]
    assert line_dedup.within(first, second, edits).tolist() == [distance(a, b) <= edits for a, b in zip(first, second)]


def test_distance_to_a_line_of_which_nothing_is_left():
    assert line_dedup.within(["abcd", "xaby"], ["abc", "xby"], 1).tolist() == [True, True]


@pytest.mark.parametrize("crowded", [line_dedup.CROWDED, 40])
def test_line_classes_match_brute_force(table, crowded):
    r = random.Random(5)
    lines = []
    for _ in range(30):
        base = "".join(r.choice("abcdefgh") for _ in range(r.randint(22, 50)))
        lines += [base, *(edited(r, base, 4) for _ in range(r.randint(0, 5)))]
    lines += ["a common beginning of the line " + "".join(r.choice("0123456789") for _ in range(r.randint(3, 6))) for _ in range(90)]
    rows = [(i, "\n".join(r.sample(lines, r.randint(1, 5))), "s") for i in range(110)]
    found = {}
    texts = {i: t.split("\n") for i, t, _ in rows}
    for x in line_dedup.line_classes(table(rows), crowded=crowded).collect():
        found.setdefault(bytes(x["root"]), set()).add(texts[x["doc_id"]][x["place"]])
    every = sorted({s for t in texts.values() for s in t if len(s) >= 20})
    links = [(a, b) for i, a in enumerate(every) for b in every[:i] if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2]
    want = {}
    for s, c in union(every, links).items():
        want.setdefault(c, set()).add(s)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_crowds_with_two_variable_places(table, edits):
    r = random.Random(8)
    lines = set()
    while len(lines) < 160:
        digits, queue = "".join(r.choice("012") for _ in range(6)), r.choice(["A", "B", "C", "", "DE"])
        lines.add(f"{digits} is the ticket that was moved to queue {queue} by the desk" + r.choice(["", "", " x", "!"]))
        # Beginnings and ends that differ in length, so that a looked-up rest is longer than its edits.
        lines.add(r.choice(["", "a", "bc", "def"]) + " one more common line with short ends " + "".join(r.choice("pqr") for _ in range(r.randint(0, 4))))
    every = sorted({s.strip() for s in lines})
    pairs = [(a, b) for i, a in enumerate(every) for b in every[:i]]
    near = line_dedup.within([a for a, _ in pairs], [b for _, b in pairs], edits)
    want = union(every, [p for p, good in zip(pairs, near) if good])
    rows = [(i, s, "s") for i, s in enumerate(every)]
    for crowded in (6,):
        found, classes = {}, {}
        for x in line_dedup.line_classes(table(rows), edits, crowded=crowded).collect():
            found.setdefault(bytes(x["root"]), set()).add(every[x["doc_id"]])
        for s, c in want.items():
            classes.setdefault(c, set()).add(s)
        assert sorted(map(sorted, found.values())) == sorted(map(sorted, classes.values()))


def test_two_edited_places_link_in_a_crowd(table):
    """A changed digit and another queue letter: such a pair shares crowded entries only."""
    r = random.Random(3)
    lines = [f"{''.join(r.choice('0123456789') for _ in range(8))} is the ticket that was moved to queue {r.choice('ABCDEFGH')} by the support desk on call" for _ in range(150)]
    first = "84736251 is the ticket that was moved to queue A by the support desk on call"
    lines += [first, first.replace("847", "837").replace("queue A", "queue H")]
    found = line_dedup.line_classes(table([(i, s, "s") for i, s in enumerate(lines)]), crowded=40).where("doc_id >= 150").collect()
    assert len({bytes(x["root"]) for x in found}) == 1 and all(x["copies"] == 2 for x in found)


def test_long_lines_of_an_entry(table, monkeypatch):
    """Too many code points for one group: compared by letters, likely pairs by their texts; also more than 32,767 of a letter."""
    monkeypatch.setattr(line_dedup, "CROWDED_CHARS", 1000)
    base = speak(4, 60)
    lines = [base, base + "x", base[:200] + "y" + base[200:], base + " and something else", "a" * 32767 + "b" * 20, "a" * 32768 + "b" * 20]
    found = {x["doc_id"]: bytes(x["root"]) for x in line_dedup.line_classes(table([(i, s, "s") for i, s in enumerate(lines)])).collect()}
    assert found[0] == found[1] == found[2] != found[3] and found[4] == found[5] and len(set(found.values())) == 3


def test_lines_go_but_the_first(table, messy, nothing):
    same = "this very line is found in all of them"
    rows = [(3, f"own line of the third text here\n{same}!", "s"), (1, f"{same}\nshort\n\nshort", "s"), (2, f"  {same}.\nanother own line that is long", "s"), (4, same, "s"), (5, "short", "s")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(table(rows)).collect()}
    assert got == {1: rows[1][1], 2: "another own line that is long", 3: "own line of the third text here", 5: "short"}
    assert line_dedup.dedup(nothing).count() == 0
    kept = line_dedup.dedup(messy)
    assert kept.columns == messy.columns
    left = sorted((str(r["doc_id"]), (r["text"] or "")[:12]) for r in kept.collect())
    # Both equal rows of id 5 are one document and stay; the null id comes last; upper case differs.
    assert [i for i, _ in left] == sorted(["1", "2", "3", "4", "5", "5", "5", "None", "6", "7", "8", "9"])


def test_short_lines_have_exact_classes_and_classes_have_links(table):
    long = "this very line is found in all of them"
    rows = [(1, f"{long}\nAll rights reserved\nMenu", "s"), (2, f"All rights reserved\n{long}!\nMenus", "s"), (3, f"{long}!?\n\n  All rights reserved", "s")]
    classes = line_dedup.line_classes(table(rows), exact_from=1)
    got = {(r["doc_id"], r["place"]): r for r in classes.collect()}
    notice = [got[1, 1], got[2, 0], got[3, 2]]
    assert {(r["copies"], r["links"], r["short"]) for r in notice} == {(3, 0, True)} and len({bytes(r["root"]) for r in notice}) == 1
    near = [got[1, 0], got[2, 1], got[3, 0]]
    assert {(r["copies"], r["links"], r["short"]) for r in near} == {(3, 2, False)} and len({bytes(r["root"]) for r in near}) == 1
    assert got[1, 2]["copies"] == got[2, 2]["copies"] == 1 and len(got) == 8
    lists = {r["doc_id"]: r for r in line_dedup.drop_lists(classes).collect()}
    assert [(r["n_lines"], r["n_repeated"], r["drop"]) for _, r in sorted(lists.items())] == [(3, 2, []), (3, 2, [1]), (2, 2, [0])]
    assert [(c["place"], c["copies"], c["links"]) for c in lists[2]["classes"]] == [(0, 3, 0), (1, 3, 2)]
    assert lists[2]["classes"][1]["class_id"] == lists[3]["classes"][0]["class_id"]
    left = {r["doc_id"]: r["text"] for r in line_dedup.dedup(table(rows), drop_from=1).collect()}
    assert left == {1: rows[0][1], 2: "Menus"}
