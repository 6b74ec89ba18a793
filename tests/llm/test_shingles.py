from __future__ import annotations

import random
import re

import pytest

from tests.conftest import DATA
from tests.llm.helpers import clashing, corpus, frame, words
from waymark.llm import shingles

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def plain_set(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return a == b or 9 * len(a & b) >= 4 * (len(a) + len(b)) > 0


def names(rows):
    """Least id of the group of each row, by all pairs."""
    sets = [plain_set(t) for _, t in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if part[i] != part[j] and similar(sets[i], sets[j]):
                part = [part[j] if p == part[i] else p for p in part]
    low: dict = {}
    for (i, _), p in zip(rows, part):
        if i is not None:
            low[p] = min(low.get(p, i), i)
    return sorted(((i, low.get(p)) for (i, _), p in zip(rows, part)), key=repr)


def edited(seed=3):
    """Texts with copies that have some words replaced: similarities around and above the threshold, chains, one large group."""
    rng = random.Random(seed)
    rows = corpus(seed, 30)
    for i in range(40):
        own = words(rng, rng.randint(150, 400))
        rows.append((10_000 + 10 * i, " ".join(own)))
        for k in range(1, 4):
            copy = list(own)
            for _ in range(rng.randint(1, max(1, len(own) // 40))):
                copy[rng.randrange(len(copy))] = "other"
            rows.append((10_000 + 10 * i + k, " ".join(copy)))
    own = words(rng, 300)
    for i in range(60):
        copy = list(own)
        for _ in range(rng.randint(0, 7)):
            copy[rng.randrange(len(copy))] = f"x{i}"
        rows.append((20_000 + i, " ".join(copy)))
    return rows + [(30_000, "Ab"), (30_001, "ab\n"), (30_002, "AB c")]


def test_against_all_pairs(spark):
    rows = edited()
    found = shingles.groups(frame(spark, rows).repartition(5)).collect()
    assert sorted(((r.id, r.component_id) for r in found), key=repr) == names(rows)


def test_pipeline_stage_drops_similar_documents(spark):
    rows = edited(5)
    rows = [(i, t) for i, t in rows if i is not None]
    docs = clashing(spark, rows)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, DATA)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {low for _, low in names(rows)}


def test_odd_tables(spark):
    assert shingles.representatives(frame(spark, [])).collect() == []
    rows = [(1, "a b c"), (2, None), (3, ""), (None, None), (4, "d")]
    assert sorted((r.doc_id for r in shingles.representatives(frame(spark, rows)).collect()), key=repr) == [1, 2, 4, None]


def test_tries_propose_links_and_the_sets_decide(spark, monkeypatch):
    """Without the bands: near copies whose fingerprints are equal or linked are found by the trie join alone. Texts with
    equal fingerprints but different sets are not linked."""
    import numpy as np
    import pandas as pd

    from waymark.llm import simhash

    rng = random.Random(9)
    rows = []
    for i in range(30):
        own = words(rng, 1200)
        rows += [(10 * i, " ".join(own)), (10 * i + 1, " ".join([*own[:-1], "other"]))]
    rows += [(900 + k, "p q r " * 200 + " ".join(f"w{k}x{i}" for i in range(100))) for k in range(2)]
    fp = simhash.fingerprint_texts([t.encode() for _, t in rows])
    apart = np.bitwise_count(fp[0:60:2] ^ fp[1:60:2])
    near = {10 * i for i in np.flatnonzero(apart <= simhash.RADIUS).tolist()}
    assert len(near) > 20 and 0 in apart and apart.max() > 0 and fp[-1] == fp[-2]
    monkeypatch.setattr(shingles, "proposed", lambda pdf: pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)}))
    found = {r.id: r.component_id for r in shingles.groups(frame(spark, rows)).collect()}
    assert {i: i - (i % 10 == 1 and i - 1 in near) if i < 900 else i for i, _ in rows} == found
