from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
import zstandard

from tests.llm.helpers import clashing, corpus, frame, words
from waymark.llm import labelled, quality


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(700):
        own = words(rng, rng.randint(30, 400))
        bad = i % 5 == 2
        if bad:
            own = [rng.choice(["%%%", "###", "$$$", "&&&"]) + w.upper() + "!!" for w in own] if i % 2 else [own[0]] * len(own)
        docs.append((i, " ".join(own)))
        if i % 3:
            labels.append((i, int(not bad)))
    docs += [(3000, None), (3001, ""), (3002, docs[4][1]), (None, "x"), (3003, " ".join(words(rng, 30_000)))]
    return docs, labels, frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy(tables):
    docs, labels, df, table = tables
    truth = {i: int(i % 5 != 2) for i, _ in docs if i is not None and i < 700}
    rows = quality.quality(df, table).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    by_id = {r.doc_id: r.score for r in rows}
    assert by_id[3000] == by_id[3001] and by_id[3002] == by_id[4] and by_id[3003] > 0.3


def test_held_out_labels_are_not_read(spark, tables):
    docs, labels, df, table = tables
    flipped = spark.createDataFrame([(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels], "doc_id long, quality int")
    get = lambda t: sorted((r.doc_id, r.score) for r in quality.quality(df.where("doc_id is not null"), t).collect())
    assert get(table) == get(flipped)


def test_sizes_cover_the_whole_text():
    good, bad = quality._compressor(b"abcdefgh" * 50), quality._compressor(b"12345678" * 50)
    rng = np.random.default_rng(0)
    noise = rng.bytes(3 * quality.BLOCK + 5)
    g, b = quality.sizes(noise, good, bad)
    assert g >= len(noise) and b >= len(noise) and quality.sizes(b"", good, bad) == (0, 0)
    assert b"".join(quality._blocks(noise)) == noise and len(quality._blocks(noise)) == 4


def test_against_plain_version(tables):
    """Dictionaries, sizes, features and calibration written out again, on whole texts."""
    docs, labels, df, table = tables
    truth, text = dict(labels), {i: (t or "").encode() for i, t in docs if i is not None}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in truth}
    cut = lambda t: [t[i : i + 2048] for i in range(0, len(t), 2048)]
    dictionary = [zstandard.train_dictionary(65_536, sorted(b for i in truth if truth[i] == k and fold[i] in (1, 2, 3) for b in cut(text[i])), k=200, d=8).as_bytes() for k in (0, 1)]

    def row(t):
        bad, good = (
            sum(len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress(b)) for b in cut(t))
            for d in dictionary
        )
        diff, share = ((bad - good) / (bad + good), min((bad + good) / 2 / len(t), 1.5)) if t else (0.0, 1.0)
        low, size = max(0.45 - share, 0.0), math.log2(1 + len(t)) / 16
        return [diff, math.tanh(20 * diff), share, low, low * low, diff * share, size, math.tanh(20 * diff) * size]

    known = [i for i in truth if fold[i] == 4]
    x, y = np.array([row(text[i]) for i in known]), np.array([truth[i] for i in known], float)
    mean, scale = x.mean(axis=0), np.where(x.std(axis=0) > 1e-12, x.std(axis=0), 1.0)
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    w, ridge = np.zeros(9), np.array([1.0] * 8 + [0.0])
    for _ in range(20_000):  # plain gradient descent
        w -= 0.02 * (z.T @ (1 / (1 + np.exp(-z @ w)) - y) + ridge * w) / len(z) ** 0.5
    want = {}
    for i, t in docs:
        v = np.append((np.array(row((t or "").encode())) - mean) / scale, 1.0)
        want.setdefault(i, []).append(1 / (1 + math.exp(-v @ w)))
    assert all(any(abs(r.score - p) < 1e-4 for p in want[r.doc_id]) for r in quality.quality(df, table).collect())


def test_odd_tables(spark):
    docs = clashing(spark, corpus(3, 30))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality(docs, none).count() == docs.count()
    one = spark.createDataFrame([(1, 1), (2, 1), (3, None), (None, 0), (4, 1), (4, 0), (6, 9)], "doc_id long, quality int")
    assert quality.quality(docs, one).count() == docs.count()
    assert quality.quality(docs.limit(0), one).collect() == []
    scored = quality.score(docs, quality.fit(docs, one))
    assert scored.columns == [c for c in docs.columns if c != "score"] + ["score"]
    assert all(r.id == 7 and 0 <= r.score <= 1 for r in scored.collect())


def test_logistic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 2))
    y = (rng.uniform(size=800) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1)))).astype(float)
    model = labelled.fit_logistic(x, y)
    p = labelled.predict(model, x)
    assert abs(p.mean() - y.mean()) < 1e-3 and np.corrcoef(p, 1 / (1 + np.exp(-(2 * x[:, 0] - 1))))[0, 1] > 0.98
    assert labelled.predict(labelled.fit_logistic(np.zeros((0, 2)), np.zeros(0)), np.zeros((1, 2)))[0] == 0.5
    assert labelled.predict(labelled.fit_logistic(x, np.ones(800)), x).min() > 0.9


def test_folds(spark):
    ids = [0, 1, 17, -5, None]
    df = spark.createDataFrame([(i,) for i in ids], "i long")
    got = [r[0] for r in df.select(labelled.fold(df.i)).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 5 if i is not None else 0 for i in ids]
