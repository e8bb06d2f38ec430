"""Normalised words with offsets, and leaked passages, against plain code."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from emberline.llm import leakage
from emberline.llm.leakage import PassageAutomaton, leaked_passages
from emberline.llm.words import words_of

CASES = {
    "Héllo, WORLD!": ["hello", "world"],
    "ｔｈｅ ｃｒｅｄｉｔ": ["the", "credit"],
    "Be​rsa nu­rsery": ["bersa", "nursery"],
    "dra-\nwings sev-\r\n  enteen": ["drawings", "seventeen"],
    "cart<br/>wheel <p>one</p>two w<b>or</b>d": ["cart", "wheel", "one", "two", "word"],
    "caf&eacute; &#116;&#104;e &amp; a&nbsp;b &amp;#116;o": ["cafe", "the", "a", "b", "to"],
    "ﬁsh ⅷ Straße": ["fish", "viii", "strasse"],
    "été": ["ete"],
    "well-known left - right": ["well", "known", "left", "right"],
    "a_b < c > d": ["a", "b", "c", "d"],
    "1,234.5 x²": ["1", "234", "5", "x2"],
    "": [], "   \n\t": [], "★★★": [],
}


@pytest.mark.parametrize("text", CASES)
def test_words(text):
    words, spans = words_of(text)
    assert words == CASES[text]
    assert all(0 <= a < b <= len(text) for a, b in spans)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é-\n<>b/&;#1​­ｔ_.", max_size=60))
def test_words_offsets_hold(text):
    words, spans = words_of(text)
    assert len(words) == len(spans)
    for (a, b), w in zip(spans, words, strict=True):
        assert 0 <= a < b <= len(text) and w


def test_offsets_give_back_the_passage():
    text = "Intro. <b>Th­e</b> ｑｕｉｃｋ br&#111;wn fo-\nx jumps; over the end."
    (item, a, b, n), = PassageAutomaton([(7, [["the", "quick", "brown", "fox", "jumps", "over"]])], 6).spans(text)
    assert (item, n) == (7, 6) and text[a:b] == "Th­e</b> ｑｕｉｃｋ br&#111;wn fo-\nx jumps; over"


def test_leaked_passages(spark, monkeypatch):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([5, 12, 13, 40]))), rng.choice(["A", None, " ".join(rng.choices(vocab, k=14))])) for i in range(40)]
    items += [(100, items[3][1], None), (101, None, None), (102, "", "x"), (None, items[3][1], "A")]
    docs = []
    for d in range(120):
        words = rng.choices(vocab, k=rng.randrange(0, 60))
        if rng.random() < 0.6:
            src = rng.choice(items)[rng.choice([1, 2])] or ""
            cut = src.split()
            a = rng.randrange(0, max(1, len(cut) - 10))
            words[5:5] = cut[a : a + rng.randrange(8, 20)]
        docs.append((d, " ".join(words), "z"))
    docs += [(500, None, "z"), (501, "", "z"), (None, items[3][1], "z"), (502, "word " * 60_000, "z"), (0, docs[0][1], "z")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item string").selectExpr("*", "item AS doc", "item AS start")
    it = spark.createDataFrame(items, "item_id int, q string, a string")
    want = set()
    for d, t, _ in docs:
        w = (t or "").split()
        grams = {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
        for i, *texts in items:
            for x in texts:
                s = (x or "").split()
                if d is not None and i is not None and any(tuple(s[k : k + 12]) in grams for k in range(len(s) - 11)):
                    want.add((d, i))
    assert want
    for most in (4_000_000, 600, 60):  # one automaton; first a pass that rules items out; and then still several passes
        monkeypatch.setattr(leakage, "AUTOMATON_WORDS", most)
        rows = leaked_passages(df, "doc_id", "text", it, "item_id", ["q", "a"]).collect()
        assert {(r["doc_id"], r["item_id"]) for r in rows} == want
        assert all(r["n_words"] >= 12 and len(words_of(dict((d, t) for d, t, _ in docs)[r["doc_id"]][r["start"] : r["end"]])[0]) == r["n_words"] for r in rows)
    assert leaked_passages(df.limit(0), "doc_id", "text", it, "item_id", ["q"]).collect() == []
    assert leaked_passages(df, "doc_id", "text", it.limit(0), "item_id", ["q"]).collect() == []


def test_short_items_stand_whole_and_runs_go_on():
    found = PassageAutomaton([(1, [["a", "b", "c", "d", "e"]]), (2, [["x"]]), (3, [["p", "q", "r"] * 8, ["k", "l", "m"]])], 12, 3)
    assert found.spans("z a b c d e z, a b c d") == [(1, 2, 11, 5)]
    assert found.spans("x x") == [] and found.spans("k l m") == [(3, 0, 5, 3)] and found.spans("k l") == []
    text = " ".join(["p", "q", "r"] * 8)
    assert max(found.spans("o " + text + " o"), key=lambda s: s[3]) == (3, 2, 2 + len(text), 24)
    assert {s[3] for s in found.spans("q r " + " ".join(["p", "q", "r"] * 3) + " p")} == {12}
    assert PassageAutomaton([(1, [["a"] * 5])], 12).spans("a a a a a") == []


def test_ruled_out_items(spark, monkeypatch):
    words = [f"v{i}" for i in range(4000)]
    items = [(i, " ".join(words[i * 20 : i * 20 + 20])) for i in range(200)] + [(900, "one two three four five")]
    docs = spark.createDataFrame([(1, "so " + " ".join(words[100:113])), (2, " ".join(words[65:72]) + " no"), (3, "well one two three four five.")], "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, q string")
    plain = it.selectExpr("item_id AS item", "q AS t0")
    left = {r["item"] for r in leakage._items_to_look_for(docs.select("text"), plain, 12, 5, 1).collect()}
    assert left == {3, 5, 900}  # seven words of item 3 aren't enough for the result, but for a look
    monkeypatch.setattr(leakage, "AUTOMATON_WORDS", 100)
    rows = leaked_passages(docs, "doc_id", "text", it, "item_id", ["q"], whole=5).collect()
    assert {(r["doc_id"], r["item_id"], r["n_words"]) for r in rows} == {(1, 5, 13), (3, 900, 5)}
