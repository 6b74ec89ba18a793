from __future__ import annotations

import hashlib

import numpy as np

from tests.llm.helpers import clashing, corpus, frame
from waymark.llm import fingerprint as f


def brute_digest(text: bytes) -> bytes:
    """One byte after another."""
    counts = [0] * 256
    padded = text + bytes(7)
    for i in range(len(text)):
        h = padded[i] | padded[i + 3] << 8 | padded[i + 7] << 16
        h = h * 0x9E3779B1 & 0xFFFFFFFF
        h ^= h >> 15
        h = h * 0x85EBCA6B & 0xFFFFFFFF
        counts[h >> 24] += 1
    ranked = sorted(counts)
    codes = [sum(c > ranked[256 * k // 4 - 1] for k in (1, 2, 3)) for c in counts]
    body = bytes(codes[i] | codes[i + 1] << 2 | codes[i + 2] << 4 | codes[i + 3] << 6 for i in range(0, 256, 4))
    return bytes([min(255, round(8 * np.log2(1 + len(text))))]) + hashlib.blake2b(text, digest_size=1).digest() + body


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    out = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        edited = f.edit(text, following)
        a, b, c = (brute_digest(t.encode()) for t in (text, edited, following))
        near = lambda x, y: float(f.likeness(np.frombuffer(x, np.uint8)[None], np.frombuffer(y, np.uint8)[None])[0])
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a.hex(), b.hex(), near(a, b), near(a, c)))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rows = [r for r in corpus(3, 40)] + [(-4, "é日🙂" * 9), (7, "short"), (10**15, "x")]
    got = sorted((tuple(r) for r in f.compare_with_next(frame(spark, rows).repartition(7)).collect()), key=repr)
    assert got == brute(rows)


def test_more_rows_than_a_range(spark):
    rows = [(i * 3, f"text number {i} " * (i % 9)) for i in range(1500)]
    got = sorted((tuple(r) for r in f.compare_with_next(frame(spark, rows)).collect()), key=repr)
    assert got == brute(rows)


def test_one_id_on_most_rows(spark):
    rows = [(5, f"copy {i % 700} of a text") for i in range(2000)] + [(i, f"own text {i}") for i in range(40)]
    got = sorted((tuple(r) for r in f.compare_with_next(frame(spark, rows).repartition(6)).collect()), key=repr)
    assert got == brute(rows)


def test_odd_tables(spark):
    for rows in ([], [(1, None)], [(1, "abc")], [(None, "a"), (None, "b"), (None, None)], [(1, "same")] * 4):
        assert sorted((tuple(r) for r in f.compare_with_next(frame(spark, rows)).collect()), key=repr) == brute(rows)
    docs = clashing(spark, corpus(5, 20))
    assert f.compare_with_next(docs).count() == docs.count()


def test_fingerprints(spark):
    got = {r.id: r.fingerprint for r in f.fingerprints(frame(spark, [(1, "abc def"), (2, "abc def"), (3, ""), (4, None)])).collect()}
    assert got[1] == got[2] == brute_digest(b"abc def").hex() and got[3] == got[4] != got[1]
    assert f.hex_digests(f.from_hex(list(got.values()))) == list(got.values())


def test_likeness_is_bounded_and_tells_texts_apart():
    base = " ".join(f"word{i * i % 977}" for i in range(900))
    other = " ".join(f"term{i * 7 % 911}" for i in range(900))
    d = f.digests([base.encode(), f.edit(base, other).encode(), other.encode(), b"", b"a", b"b"])
    same, edited, far = (f.likeness(d[:1], d[i : i + 1])[0] for i in (0, 1, 2))
    assert same == 1 > edited > far >= 0
    assert f.likeness(d[4:5], d[5:6])[0] < 1
