from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import ann

def query():
    return F.col("vec_id") % 100 == 0


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def exact(rows, k=10):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q in sorted({i for i in ids.tolist() if i % 100 == 0}):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        other = np.flatnonzero(ids != q)
        out[q] = [(int(ids[j]), d[j]) for j in other[np.lexsort((ids[other], d[other]))][:k]]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(20, 16))
    rows = [(i, (centers[rng.integers(20)] + rng.normal(0, 0.3, 16)).astype(np.float32).astype(float).tolist()) for i in range(3000)]
    rows += [(3000 + i, rows[0][1]) for i in range(900)]  # one vector in a fifth of all rows
    found: dict = {}
    for r in ann.search(vectors(spark, rows), query()).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = exact(rows)
    assert set(found) == set(want)
    hit = sum(len({v for _, v, _ in found[q]} & {v for v, _ in want[q]}) for q in want)
    assert hit >= 0.9 * sum(len(v) for v in want.values())
    by_id = dict(rows)
    for q, got in found.items():
        got.sort()
        assert [n for n, *_ in got] == list(range(1, 11))
        assert [(s, v) for _, v, s in got] == sorted((s, v) for _, v, s in got)
        assert all(abs(s - np.linalg.norm(np.subtract(by_id[v], by_id[q]))) < 1e-9 for _, v, s in got)
    assert [v for _, v, _ in found[0]] == list(range(3000, 3010))


def test_unusable_rows_take_no_part(spark):
    rows = [
        (0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, 0.0]), (5, [1.0, None]), (6, [float("inf"), 1.0]), (100, [0.0, 1.0]),
        (None, [1.0, 1.0]), (7, [1.0]), (200, None), (4, [1.0, 0.0]),
    ]
    got = [tuple(r) for r in ann.search(vectors(spark, rows, "double").withColumn("id", F.lit(1)).withColumn("part", F.lit("x")), query()).orderBy("query_id", "rank").collect()]
    assert [r[:3] for r in got] == [(0, 1, 4), (0, 2, 4), (0, 3, 100), (100, 1, 0), (100, 2, 4), (100, 3, 4)]


def test_any_magnitude(spark):
    """Finite vectors whose squares overflow or vanish take part like any other."""
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.choice([-250, -170, 0, 160, 200])).tolist()) for i in range(1500)]
    rows += [(5000, [1e200, 0.0, 0.0, 0.0]), (5001, [1.5e308, 0.0, 0.0, 0.0]), (5002, [5e-324, 0.0, 0.0, 0.0])]
    found: dict = {}
    for r in ann.search(vectors(spark, rows, "double"), query()).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    by_id = dict(rows)
    assert set(found) == {i for i, _ in rows if i % 100 == 0} and all(len(v) == 10 for v in found.values())
    assert all(s == pytest.approx(math.hypot(*np.subtract(by_id[v], by_id[q])), rel=1e-12, abs=0) for q, got in found.items() for _, v, s in got)
    assert ann.distances(np.array([[3e200, 4e200], [3e-200, 4e-200], [0, 0]]), np.zeros(2)) == pytest.approx([5e200, 5e-200, 0], rel=1e-12, abs=0)


def test_few_rows_in_the_probed_partitions(spark, monkeypatch):
    """Queries filed apart from all other rows still find ten."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(2000)]
    monkeypatch.setattr(ann, "fit", lambda sample, n: ann.Router(9.0, np.zeros(8), np.ones(8), np.eye(8)[:, :1], np.zeros(1), np.array([[1.0, -1.0]]), np.array([-3.0, 0.0]), 1))
    found = ann.search(vectors(spark, rows, "double"), query()).collect()
    want = exact(rows)
    one = next(i for i, v in rows if v[0] > 2.2)
    assert one is not None and len(found) == 10 * len(want)
    far = [(i if i != one else 100_000, v) for i, v in rows if v[0] <= 1.5 or i == one]
    got = sorted((r.rank, r.vec_id) for r in ann.search(vectors(spark, far, "double"), query()).where("query_id = 100000").collect())
    assert [v for _, v in got] == [v for v, _ in exact(far)[100_000]]


def test_an_id_with_several_vectors(spark):
    """Each vector is a candidate; of a query's the least asks."""
    rows = [(0, [5.0, 5.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [2.0, 0.0]), (2, [5.0, 6.0])]
    got = [tuple(r) for r in ann.search(vectors(spark, rows), query()).orderBy("rank").collect()]
    assert [r[:3] for r in got] == [(0, 1, 1), (0, 2, 1), (0, 3, 2)] and [r[3] for r in got] == pytest.approx([1, 1, 52**0.5])


def test_empty_tables(spark):
    assert ann.search(vectors(spark, []), query()).collect() == []
    assert ann.search(vectors(spark, [(1, [1.0, 2.0])]), query()).collect() == []
    assert ann.search(vectors(spark, [(0, [1.0, 2.0])]), query()).collect() == []


def test_partition_is_balanced_and_cuts_few_edges():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(m, 0.2, (100, 8)) for m in rng.normal(0, 3, (8, 8))])
    near = ann._nearest(x, 5)
    part = ann.balanced_partition(x, near, 3)
    sizes = np.bincount(part, minlength=8)
    assert sizes.min() >= 94 and sizes.max() <= 106
    assert (part[near] == part[:, None]).mean() > 0.9


def test_best_is_exact_on_ties():
    rows = np.array([[0.0, 1.0], [1.0, 0.0], [0.0, 1.0], [5.0, 5.0]])
    q, i, s = ann.best(np.array([9, 3, 7, 1]), rows, np.array([3]), np.array([[0.0, 0.0]]), 2)
    assert i.tolist() == [7, 9] and s.tolist() == [1, 1] and q.tolist() == [3, 3]
