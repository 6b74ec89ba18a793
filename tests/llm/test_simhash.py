from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from tests.llm.helpers import clashing, corpus, frame
from waymark.llm import simhash as s


def fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows):
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    low: dict = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, fps[k], low.get(find(k))) for k, (i, _) in enumerate(rows)), key=repr)


def got(df):
    return sorted(((r.id, r.fp % 2**64, r.component_id) for r in s.near_duplicates(df).collect()), key=repr)


def test_against_brute_force(spark):
    rows = corpus(1, 60) + [(5000, "Ab"), (5001, "ab\n"), (5002, "AB c"), (5003, "É é"), (5004, "x" * 5000)]
    assert got(frame(spark, rows).repartition(6)) == components(rows)


@pytest.mark.parametrize("seed", range(4))
def test_trie_join_on_dense_clusters(spark, seed, monkeypatch):
    rng = np.random.default_rng(seed)
    centers = rng.integers(0, 2**64, 30, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in range(900)]
    v = np.unique(np.array([int(centers[rng.integers(30)]) ^ f for f in flips] + [0, 1, 2**64 - 1, 2**63], np.uint64))
    monkeypatch.setattr(s, "FRONT", 64 if seed else 1 << 19)
    i, j = np.nonzero(np.triu(np.bitwise_count(v[:, None] ^ v[None]) <= 3, 1))
    want = s._roots(len(v), i, j)
    a, b = s.trie_links(v, None)
    assert len(a) < len(v)
    assert np.array_equal(s._roots(len(v), np.searchsorted(v, a), np.searchsorted(v, b)), want)
    links = s.near_links(spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long"), leaves=40).toPandas().to_numpy(np.int64).view(np.uint64)
    assert np.array_equal(s._roots(len(v), np.searchsorted(v, links[:, 0]), np.searchsorted(v, links[:, 1])), want)


def test_whole_subtries_are_linked_at_once():
    v = np.arange(64, dtype=np.uint64)
    a, b = s.trie_links(v, None, 6)
    assert len(np.unique(s._roots(64, a.astype(int), b.astype(int)))) == 1
    assert [len(x) for x in s.trie_links(v[:1], None)] == [0, 0] == [len(x) for x in s.trie_links(v[:0], v[:3])]


def test_representatives(spark):
    rows = corpus(2, 40)
    docs = clashing(spark, rows)
    kept = s.representatives(docs)
    assert kept.columns == docs.columns
    found = kept.collect()
    by_fp = components(rows)
    groups = {c for _, _, c in by_fp if c is not None}
    assert sorted(r.doc_id for r in found if r.doc_id is not None) == sorted(
        c for c, n in ((c, len({k for k in _components_of(rows, c)})) for c in groups) for _ in range(n)
    )
    assert sum(r.doc_id is None for r in found) == sum(i is None for i, _ in rows)
    assert all(r._id == 2 and r._mark == 3 for r in found)


def _components_of(rows, name):
    """Different groups whose least id is ``name`` (an id may repeat in several)."""
    fps = [fingerprint(t) for _, t in rows]
    seen: dict = {}
    for k in range(len(rows)):
        front, own = [k], {k}
        while front:
            x = front.pop()
            for y in range(len(rows)):
                if y not in own and (fps[x] ^ fps[y]).bit_count() <= 3:
                    own.add(y)
                    front.append(y)
        ids = [rows[x][0] for x in own if rows[x][0] is not None]
        if ids and min(ids) == name:
            seen[min(own)] = 1
    return seen


def test_odd_tables(spark):
    assert got(frame(spark, [])) == []
    assert got(frame(spark, [(None, "a b c")])) == [(None, fingerprint("a b c"), None)]
    rows = [(i, "same text here") for i in range(50)] + [(3, "same text here"), (7, None), (8, "")]
    random.Random(1).shuffle(rows)
    assert got(frame(spark, rows)) == components(rows)
    assert got(clashing(spark, rows)) == components(rows)
