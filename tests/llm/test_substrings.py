from __future__ import annotations

import hashlib
import random
import re

import pytest

from tests.llm.helpers import clashing, corpus, frame, words
from waymark.llm import substrings as s


def brute(rows, window=50):
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    low: dict = {}
    for i, w in texts:
        for k in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[k : k + window])
            low[key] = min(low.get(key, i), i)
    out = []
    for i, w in texts:
        off = [False] * len(w)
        for k in range(len(w) - window + 1) if i is not None else ():
            if low[tuple(w[k : k + window])] < i:
                off[k : k + window] = [True] * window
        kept = " ".join(x for x, o in zip(w, off) if not o)
        out.append((i, len(w), sum(off), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in s.digest(df).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    want = brute(rows)
    assert got(frame(spark, rows).repartition(5)) == want and sum(r[2] for r in want) > 500


def test_repetitive_words(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("ab") if rng.random() < 0.97 else str(rng.randint(0, 5)) for _ in range(rng.randint(40, 250)))) for i in range(60)]
    rows += [(100 + i, "a " * n) for i, n in enumerate((10, 49, 50, 51, 300, 120))]
    assert got(frame(spark, rows)) == brute(rows)


def test_common_passage(spark):
    """A passage in every document, in different surroundings, and many near copies of one text."""
    rng = random.Random(9)
    passage, base = words(rng, 80), words(rng, 160)
    rows = []
    for i in range(80):
        own = words(rng, 60)
        at = rng.randint(0, 60)
        rows.append((i, " ".join(own[:at] + passage + own[at:])))
        copy = list(base)
        copy[rng.randrange(160)] = f"e{i}"
        rows.append((200 - i, " ".join(copy)))
    assert got(frame(spark, rows)) == brute(rows)


def test_chance_bits_change_nothing(spark, monkeypatch):
    """Maps of a few bits let everything through."""
    monkeypatch.setattr(s, "MAP_BITS", 7)
    rows = corpus(4, 25)
    assert got(frame(spark, rows)) == brute(rows)


def test_shards_may_be_small(spark, monkeypatch):
    monkeypatch.setattr(s, "SHARD_WORDS", 200)
    rows = corpus(6, 25)
    assert got(frame(spark, rows)) == brute(rows)


@pytest.mark.parametrize("most", [0, 300])
def test_crowded_anchors(spark, monkeypatch, most):
    """Anchors whose windows are compared one by one."""
    monkeypatch.setattr(s, "CROWDED_WORDS", most)
    rng = random.Random(5)
    base = words(rng, 200)
    rows = corpus(9, 25)
    for i in range(60):
        copy = list(base)
        copy[rng.randrange(200)] = f"e{i % 20}"
        rows.append((2000 - i, " ".join(copy)))
    assert got(frame(spark, rows)) == brute(rows)


def test_automaton():
    rng = random.Random(3)
    sequences = [[rng.choice("abc") for _ in range(rng.randint(0, 40))] for _ in range(6)]
    automaton = s.SuffixAutomaton()
    for x in sequences:
        automaton.add(x)
    inside = {tuple(x[a:b]) for x in sequences for a in range(len(x)) for b in range(a, len(x) + 1)}
    for _ in range(20):
        text = [rng.choice("abcd") for _ in range(30)]
        want = [max(n for n in range(i + 2) if tuple(text[i + 1 - n : i + 1]) in inside) for i in range(30)]
        assert automaton.matching(text) == want


def test_passages_that_differ_in_one_regular_word(spark):
    """Words that a polynomial hash modulo 2**64 cannot tell apart."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    other = one.translate(str.maketrans("ab", "ba"))
    around = [f"w{i}" for i in range(50)]
    texts = [" ".join(around[:25] + [x] + around[25:]) for x in (one, other, one)]
    rows = list(enumerate(texts))
    assert got(frame(spark, rows)) == brute(rows) and [r[2] for r in got(frame(spark, rows))] == [0, 0, 51]
    assert {r.doc_id: r.text for r in s.remove(frame(spark, rows)).collect()} == {0: texts[0], 1: texts[1], 2: ""}


def test_anchors_of_one_rule(monkeypatch):
    """Spans of any length give the same anchors."""
    rng = random.Random(2)
    text = " ".join(rng.choice("abcde") for _ in range(3000)).encode()
    want = s.Windows(s.Words([text]))
    monkeypatch.setattr(s, "SPAN", 7)
    found = s.Windows(s.Words([text]))
    assert (found.anchor == want.anchor).all() and (found.hash == want.hash).all() and len(want.start) == 2951


def test_odd_tables(spark):
    assert got(frame(spark, [])) == []
    rows = corpus(8, 20)
    docs = clashing(spark, rows)
    assert got(docs) == brute(rows)
    kept = s.remove(docs).collect()
    assert [f.name for f in s.remove(docs).schema] == docs.columns and len(kept) == len(rows)
    assert sorted(((r.doc_id, " ".join((r.text or "").split())) for r in kept), key=repr) == sorted(((i, t) for i, t in kept_texts(rows)), key=repr)
    assert all(r.id == 7 and r.row == "r" and r._mark == 2 + 1 for r in kept)
    assert all(r.n_chars == len(r.text) for r in kept if r.text is not None)
    assert s.remove(docs.limit(0)).collect() == []


def kept_texts(rows):
    texts = [(i, (t or "").split()) for i, t in rows]
    low: dict = {}
    for i, w in texts:
        for k in range(len(w) - 49) if i is not None else ():
            key = tuple(w[k : k + 50])
            low[key] = min(low.get(key, i), i)
    for i, w in texts:
        off = [False] * len(w)
        for k in range(len(w) - 49) if i is not None else ():
            if low[tuple(w[k : k + 50])] < i:
                off[k : k + 50] = [True] * 50
        yield i, " ".join(x for x, o in zip(w, off) if not o)


def test_clean_texts_stay_byte_for_byte(spark):
    text = "  odd\n\n spacing\tstays " + " ".join(f"x{i}" for i in range(70)) + " \n"
    df = frame(spark, [(1, text), (2, "other " + " ".join(f"y{i}" for i in range(80)))])
    assert {r.doc_id: r.text for r in s.remove(df).collect()}[1] == text
    assert s.cut(b"a  b c\n", [1, 1]) == b"a  c\n" and s.cut(b"a b", [0, 1]) == b""
