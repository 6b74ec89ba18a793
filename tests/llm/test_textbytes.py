from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.llm import textbytes as tb

TEXTS = st.lists(st.text(alphabet=st.sampled_from("ab \n\té日🙂\x0b\x0c\r\xa0")), max_size=6)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words(texts):
    raw = [t.encode() for t in texts]
    if not raw:
        return
    w = tb.Words(raw)
    want = [re.findall(rb"[^\x20\x09-\x0D]+", t) for t in raw]
    assert [w.buf[a:b].tobytes() for a, b in zip(w.start, w.end)] == [x for t in want for x in t]
    assert w.count.tolist() == [len(t) for t in want]
    h = w.hashes().tolist()
    flat = [x for t in want for x in t]
    assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(h)) for j in range(i))


def test_xxh64_of_any_length():
    rng = np.random.default_rng(1)
    buf = rng.integers(0, 256, 4000, dtype=np.uint8)
    start = rng.integers(0, 3000, 400)
    end = start + np.concatenate((np.arange(120), rng.integers(0, 900, 280)))
    want = [xxhash.xxh64_intdigest(buf[a:b].tobytes(), 42) for a, b in zip(start, end)]
    assert tb.xxh64(buf, start, end).tolist() == want


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


def test_window_hashes_and_sliding():
    h = np.array([1, 2, 3, 1, 2, 3, 4] * 12, np.uint64)
    widths = [1, 2, 3, 5, 12, 50, 64, 83, 84, 85, 99]
    for width, w in zip(widths, tb.window_hashes(h, *widths)):
        runs = [tuple(h[i : i + width].tolist()) for i in range(len(h) - width + 1)]
        assert len(w) == len(runs) and len(set(zip(runs, w.tolist()))) == len(set(runs)) == len(set(w.tolist()))
    assert len(tb.window_hashes(h[:0], 9)[0]) == 0
    for width in range(1, 8):
        assert tb.sliding(h, width, np.minimum).tolist() == [min(h[i : i + width]) for i in range(len(h) - width + 1)]


def test_regular_sequences_do_not_collide():
    one = thue_morse(2048)
    other = one.translate(str.maketrans("ab", "ba"))
    assert len(set(tb.Words([one.encode(), other.encode()]).hashes().tolist())) == 2
    h = [tb.Words([" ".join(x).encode()]).hashes() for x in (one, other)]
    assert tb.window_hashes(h[0], 2048)[0] != tb.window_hashes(h[1], 2048)[0]


def test_pieces_cover_all_rows():
    column = pa.array(["a" * n for n in (0, 5, 100, 1, 0)] + [None])
    got = list(tb.text_pieces(column, 20))
    assert [t for _, _, part in got for t in part] == tb.text_bytes(column)
    assert [(a, b) for a, b, _ in got][0][0] == 0 and got[-1][1] == 6
    assert list(tb.text_pieces(pa.array([], pa.string()))) == []
