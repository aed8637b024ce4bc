"""Collocations, conversation repair and html extraction against brute force, hand-made pages, and odd input."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import collocations, conversation_repair, html_blocks, html_extract

SF = "/root/testdata/sf0.01"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- collocations ---------------------------------------------------------------


def plain_collocations(rows, least, top):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        count = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                count.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, count in f.items():
        often = {p: a for p, a in count.items() if a >= least and len(p) > 1}
        ranked = []
        for p, a in often.items():
            score, k = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
            inside = any(
                len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in often.items()
            )
            if not inside:
                ranked.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def chatter(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        words = [r.choice("a b c d e f ü 日本 New new York of the".split()) for _ in range(r.randint(0, 40))]
        if r.random() < 0.5:
            words[r.randint(0, len(words)) : 0] = ["in", "the", "City", "of", "Z"]
        out.append((r.choice(["en", "de", None, "und"]), "".join(w + r.choice([" ", " ", " ", "\t", ", ", "\n", "  "]) for w in words)))
    return out


@pytest.mark.parametrize("limit", [1 << 20, 5])
def test_collocations_match_plain_python(llm, limit):
    rows = chatter(3, 300) + [(None, None), ("en", ""), ("xx", "once only"), ("en", "x " * 9000), ("en", "x " * 9000)]
    docs = llm.createDataFrame([(*r, 1, "q") for r in rows], "lang string, text string, n int, id string").repartition(5)
    got = collocations.collocations(docs, top=40, least=6, limit=limit)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, 6, 40)


def test_collocations_of_odd_tables(llm, messy, nothing):
    from pyspark.sql import functions as F

    assert collocations.collocations(messy.withColumn("lang", F.lit(None).cast("string"))).count() == 0
    assert collocations.collocations(nothing.withColumn("lang", F.lit("en"))).count() == 0
    same = messy.withColumn("lang", F.lit("en"))
    assert collocations.collocations(same, least=2).collect() == collocations.collocations(same.repartition(4), least=2).collect()


def test_tiles_count_like_a_dictionary(monkeypatch):
    monkeypatch.setattr(collocations, "DENSE_PAIRS", 50)
    monkeypatch.setattr(collocations, "HELD_PAIRS", 300)
    rng = np.random.default_rng(1)
    tiles, want, got = collocations.Tiles(2000), Counter(), Counter()
    for _ in range(20):
        left, right = (rng.zipf(1.3, 400) % 2000 for _ in range(2))
        want.update(zip(left.tolist(), right.tolist()))
        tiles.add(left, right)
        if tiles.full:
            for x in tiles.take().to_pylist():
                got[x["l"], x["r"]] += x["a"]
    for x in tiles.take().to_pylist():
        got[x["l"], x["r"]] += x["a"]
    assert got == want


# --- conversation repair --------------------------------------------------------


def plain_repair(turns, longest=9):
    """By trying grammar strings and all alignments: (cost, audit, text)."""
    faults, seen = [], set()
    for role, text in turns:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        faults.append("b" if blank else "d" if (role, text) in seen else "" if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else "t")
        seen.add((role, text))
    aims = [""] + [s + "ua" * m for m in range(1, longest) for s in ("", "s")]
    best = None
    for aim in aims:
        cells = {(0, 0): (0, "", ())}
        for i, j in itertools.product(range(len(turns) + 1), range(len(aim) + 1)):
            offers = [cells[i, j]] if (i, j) == (0, 0) else []
            if i:
                c, a, t = cells[i - 1, j]
                offers.append((c + 4, a + "D", t))
            if j and aim[j - 1] != "s":
                c, a, t = cells[i, j - 1]
                offers.append((c + 3, a + "I", (*t, {"u": "user:", "a": "assistant:"}[aim[j - 1]])))
            if i and j and faults[i - 1] not in ("b", "d"):
                c, a, t = cells[i - 1, j - 1]
                role, text = turns[i - 1]
                mend = 3 * (faults[i - 1] == "t")
                if role[:1] == aim[j - 1]:
                    offers.append((c + mend, a + "K", (*t, f"{role}:{text}")))
                if aim[j - 1] != "s":
                    offers.append((c + 3 + mend, a + "R", (*t, f"{ {'u': 'user', 'a': 'assistant'}[aim[j - 1]] }:{text}")))
            cells[i, j] = min(offers) if offers else (10**9, "", ())
        if best is None or cells[len(turns), len(aim)] < best:
            best = cells[len(turns), len(aim)]
    return best, Counter(faults)


def talk(seed, n):
    r = random.Random(seed)
    return [(r.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), r.choice(["Yes.", "No!", "cut", " ", "", f"Number {i}.", "Why?\n"])) for i in range(n)]


def as_rows(talks):
    return [(c, t, role, text, False, 0) for c, turns in talks.items() for t, (role, text) in enumerate(turns)]


ROWS = "conv_id long, turn long, role string, text string, gone boolean, copy int"


@pytest.mark.parametrize("segment", [512, 3])
def test_repairs_match_plain_python(llm, monkeypatch, segment):
    monkeypatch.setattr(conversation_repair, "SEGMENT", segment)
    talks = {i: talk(i, i % 11) for i in range(60)}
    rows = as_rows(talks) + [(i, 0, "", "", True, 0) for i, turns in talks.items() if not turns]
    docs = llm.createDataFrame(rows, ROWS)
    # The workers import their own module, so the segment length travels as a value.
    segments = []
    for c, turns in talks.items():
        seen, s = set(), None
        out = []
        for role, text in turns:
            if s is None or len(s.roles) >= segment:
                s = conversation_repair.Segment(c)
                out.append(s)
            blank = not re.search(r"[^\x20\x09-\x0D]", text)
            fault = 1 if blank else 2 if (role, text) in seen else 0 if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else 3
            seen.add((role, text))
            s.roles.append(role)
            s.texts.append(text)
            s.faults.append(fault)
            s.turns.append(len(s.turns))
        segments.append(out)
    for (c, turns), parts in zip(talks.items(), segments):
        (cost, audit, text), _ = plain_repair(turns)
        ways = {0: (0, b"", [])}
        for s, moves in zip(parts, conversation_repair.align_segments(parts, conversation_repair.ALL_PAIRS, 4)):
            after = {}
            for (a, b), (extra, piece) in moves.items():
                if a in ways:
                    offer = (ways[a][0] + extra, ways[a][1] + piece, ways[a][2] + conversation_repair.replay(piece, s.roles, s.texts, a))
                    after[b] = min(after.get(b, offer), offer)
            ways = after
        assert min(ways[b] for b in (0, 3) if b in ways) == (cost, audit.encode(), list(text))
    if segment == 512:
        got = {r["conv_id"]: r for r in conversation_repair.repair(docs.repartition(3), with_text=True).collect()}
        assert len(got) == len(talks)
        for c, turns in talks.items():
            (cost, audit, text), faults = plain_repair(turns)
            r = got[c]
            assert (r["cost"], r["audit"], r["repaired"]) == (cost, audit, "\n".join(text))
            assert r["repaired_sha256"] == hashlib.sha256("\n".join(text).encode()).hexdigest()
            assert (r["blank"], r["duplicate"], r["truncated"], r["gaps"]) == (faults["b"], faults["d"], faults["t"], 0)
            assert r["illegal"] == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))


def test_long_conversations_are_folded(llm):
    """Turns of one conversation over many ranges and segments: the same as in one table."""
    turns = [(("user", "assistant")[i % 2] if i % 7 else "system", f"Turn {i}{'.' if i % 5 else ''}" if i % 11 else "") for i in range(1500)]
    docs = llm.createDataFrame(as_rows({1: turns, 2: turns[:3], None: turns[:4]}), ROWS)
    got = {r["conv_id"]: r for r in conversation_repair.repair(docs.repartition(6), with_text=True).collect()}
    role = np.array([[conversation_repair.CODES.get(a[:1], 0) for a, _ in turns]])
    dead = np.array([[not t for _, t in turns]])
    cut = np.array([[bool(t) and t[-1] != "." for _, t in turns]])
    found = conversation_repair.align(conversation_repair.Turns.of(role, dead, cut), conversation_repair.WHOLE)
    cost, audit = min(b[0] for b in found.values() if b[0] is not None)
    text = "\n".join(conversation_repair.replay(audit, [a for a, _ in turns], [t for _, t in turns], 0))
    assert (got[1]["cost"], got[1]["audit"], got[1]["repaired"]) == (cost, audit.decode(), text)
    assert got[1]["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest() and got[1]["gaps"] == 0
    assert got[1]["illegal"] == sum(a[0][0] + b[0][0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    assert got[None]["audit"] == got[2]["audit"][:0] + plain_repair(turns[:4])[0][1]


def test_damage_and_repair_of_odd_tables(llm):
    rows = [(1, None, "user", None), (1, 5, None, "x"), (None, 3, "user", "Hi."), (1, 5, None, "x"), (2, 2**40, "system", "A."), (2, 1, "user", "B."), (3, None, None, None)]
    table = llm.createDataFrame([(*r, "z", 4) for r in rows], "conv_id long, turn long, role string, text string, gone string, copy int")
    hurt = conversation_repair.damage(table)
    for r in hurt.collect():
        fate = zlib.crc32(f"{' ' if r['conv_id'] is None else r['conv_id']}:{' ' if r['turn'] is None else r['turn']}".encode()) % 20
        assert r["gone"] == (fate == 0) and (fate != 1 or r["text"] == "") and (fate != 4 or r["role"] == "user")
    got = {r["conv_id"]: r for r in conversation_repair.repair(hurt).collect()}
    assert set(got) == {1, 2, 3, None} and got[3]["gaps"] == 0
    assert conversation_repair.repair(hurt.limit(0)).count() == 0
    gone = llm.createDataFrame([(9, 1, "user", "a", True, 0)], ROWS)
    assert tuple(conversation_repair.repair(gone).first())[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# --- html -----------------------------------------------------------------------


def test_blocks_of_malformed_pages():
    def texts(html):
        return [b.text for b in html_blocks.blocks_of(html)]

    assert texts(None) == texts("") == texts("<div> \n </div><script>x</p></script>") == []
    assert texts("a &lt;b&gt; &amp;amp; <!-- <p>no --> c\xa0&nbsp; d") == ["a <b> &amp; c d"]
    assert texts("<p>one<p>two <b>bo<i>ld</b> x</i><br>three</div><ul><li>4<li>5</ul>6 < 7 <b") == ["one", "two bold x three", "4", "5", "6 < 7"]
    assert texts('<div title="a > b" class=\'x\'>in</div><p class="y>open<p>z') == ["in", "open", "z"]
    assert texts("<style>p{}</style><title>t</title>x<script>unclosed <p>y") == ["x"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    deep = "<div class=q>" * 20_000 + "x" + "</div>" * 20_000
    assert texts(deep) == ["x"] and len(texts("<p>x " * 30_000)) == 30_000


def test_gradient_of_the_labeller():
    r = np.random.default_rng(0)
    pages = ["<nav><a href=1>Home you</a> more</nav><p>Some words, here. And more.</p><footer>End</footer>", "<p>One</p>", "<div class=ad>Buy</div><p>Two two</p>"]
    x = html_extract.encode([html_blocks.blocks_of(p) for p in pages])
    y, w = r.integers(0, 2, int(x.rows[-1])).astype(float), np.array([1.0, 0, 1, 1, 1, 1])[: int(x.rows[-1])]
    model = html_extract.Labeller.start(r, 5, 3)

    def loss():
        s = model.forward(x)[0]
        return -(w * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum() / w.sum()

    for name, g in model.gradient(x, y, w).items():
        v = model.weights[name]
        for at in sorted(np.ndindex(v.shape), key=lambda i: -abs(g[i]))[:5]:
            old = v[at]
            v[at] = old + 1e-6
            up = loss()
            v[at] = old - 1e-6
            down = loss()
            v[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-6)


LINES = (
    "The river rose slowly over the winter, and the old mill was the first house to see water at its door.",
    "Nobody in the village remembered such a flood, though the stones by the church carried older marks.",
    "When the water fell again, the miller counted his sacks, found two missing, and thought himself lucky.",
)
A, B, C = (f"<p>{x}</p>" for x in LINES)
FOREIGN = [
    f'<body><div id="page"><header class="site-header"><p><a href="/">Valley News</a></p><nav><ul><li><a href="/">Home</a></li></ul></nav></header><main><article class="hentry">'
    f'<h1>The flood</h1>{A}{B}<div class="sharedaddy"><ul><li><a href="#">Share</a></li></ul></div>{C}</article><div id="comments" class="comments-area"><h2>2 thoughts</h2>'
    "<ol class=comment-list><li><p>I remember the flood very well, it was cold and the cellar was full of mud.</p></li></ol></div></main>"
    '<aside class="widget-area"><h2>Recent</h2><ul><li><a>Post one</a></li></ul></aside></div><footer class="site-footer">Made in the valley. All rights reserved.</footer></body>',
    f'<body><div class="navbar"><a href=1>World</a> <a href=2>Sport</a></div><div class="cookiebar">We use cookies to make this site better for you. <button>OK</button></div>'
    f'<div class="storytext"><h1>The flood</h1>{A}<p>{LINES[1]}<div class="advertbox">Buy a boat today, while the prices are still low, and be safe.</div>{C}</div>'
    '<div class="usercomments"><h3>Readers say</h3><p>What a story, I could not stop to read it, thank you for writing it down.</p></div>'
    '<div id="foot">Copyright 2020 Paper Ltd. <a href=t>Terms</a></div></body>',
]


@pytest.fixture(scope="module")
def labeller(llm):
    return html_extract.learn(llm.read.parquet(f"{SF}/pages.parquet"))


def test_pages_give_their_articles(llm, labeller):
    import html

    pages = llm.read.parquet(f"{SF}/pages.parquet")
    got = html_extract.extract(pages, labeller).collect()
    assert len(got) == pages.count() and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars", "n_blocks", "n_kept"}
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    right = 0
    for r in got:
        inner = re.search(r"<article>(.*)</article>", source[r["page_id"]], re.S)[1]
        inner = re.sub(r"</?(?:p|h1)>|<br>", " ", re.sub(r"</?b>", "", inner))
        right += r["text"] == " ".join(html.unescape(inner).split()) and r["n_chars"] == len(r["text"])
    assert right >= 0.99 * len(got)


def test_pages_of_layouts_not_seen(llm, labeller):
    rows = [(i, h, "v") for i, h in enumerate(FOREIGN)]
    for r in html_extract.extract(llm.createDataFrame(rows, "page_id int, html string, node string"), labeller).collect():
        assert r["text"] == " ".join(["The flood", *LINES]) and r["node"] == "v"


def test_html_of_odd_tables(llm, labeller):
    rows = [(1, None, None), (1, None, None), (None, "u", ""), (2, "u", "<p>"), (3, "u", "plain text"), (4, "u", "<div>" + "<p>word, and word.</p>" * 20_000)]
    pages = llm.createDataFrame(rows, "page_id long, url string, html string")
    got = html_extract.extract(pages, labeller).collect()
    assert len(got) == 6 and [r["text"] for r in got if r["page_id"] in (1, 2) or r["page_id"] is None] == [""] * 4
    assert html_extract.learn(pages.limit(0)) is None and html_extract.learn(pages.where("html IS NULL")) is None
    assert [r["text"] for r in html_extract.extract(pages.where("page_id = 3"), None).collect()] == ["plain text"]
    assert html_extract.extract(pages.limit(0), labeller).count() == 0
    clashing = html_extract.extract(pages.withColumnRenamed("url", "text").withColumn("a.b", pages["page_id"]), labeller)
    assert clashing.columns == ["page_id", "a.b", "text", "n_chars", "n_blocks", "n_kept"]
    assert sorted(r[2] for r in clashing.collect()) == sorted(r["text"] for r in got)
    small = html_extract.learn(pages)
    assert html_extract.extract(pages, small).count() == 6
