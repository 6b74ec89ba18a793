"""Vectorised word handling over the UTF-8 bytes of many texts at once (numpy, inside Arrow batches).

Texts are laid out in one byte buffer, each followed by a space, so that no word spans two texts. Work is cut into
pieces of about ``PIECE`` bytes: memory does not follow the size of an Arrow batch, and one text is never split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PIECE = 2 << 20
#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SEPARATOR = np.isin(np.arange(256), SEPARATORS)
#: The same with all ASCII bytes that are neither letters nor digits.
IS_PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Spans of more bytes than this are hashed one by one, by the library.
LONG_SPAN = 256


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(texts: list[bytes], limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` bytes each."""
    first = total = 0
    for i, text in enumerate(texts):
        total += len(text) + 1
        if total >= limit:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def text_pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges of rows with about ``limit`` bytes of text each, and their texts; only one range is copied at a time."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    ends, first = np.cumsum(size), 0
    while first < len(size):
        done = ends[first - 1] if first else 0
        last = min(len(size), int(np.searchsorted(ends, done + limit)) + 1)
        yield first, last, text_bytes(column.slice(first, last - first))
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of some texts: ``start``/``end`` in ``buf``, ``doc`` (index of the text), ``first`` (word range by text)."""

    def __init__(self, texts: list[bytes], lower: bool = False, separator: np.ndarray = IS_SEPARATOR):
        self.buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        if lower:
            self.buf = LOWER[self.buf]
        sep = separator[self.buf]
        edges = np.flatnonzero(sep[1:] != sep[:-1]) + 1
        if not sep[0]:
            edges = np.concatenate(([0], edges))
        self.start, self.end = edges[0::2], edges[1::2]
        self.offset = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        self.first = np.searchsorted(self.start, self.offset)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def line(self) -> tuple[np.ndarray, np.ndarray]:
        """``(bytes, to)``: the words in a row, one space behind each; word ``i`` is ``bytes[to[i] : to[i + 1] - 1]``."""
        to = np.concatenate(([0], np.cumsum(self.end - self.start + 1)))
        line = np.full(to[-1], 0x20, np.uint8)
        keep = np.ones(to[-1], bool)
        keep[to[1:] - 1] = False
        inside = np.zeros(len(self.buf) + 1, np.int8)
        inside[self.start] += 1
        inside[self.end] -= 1
        line[keep] = self.buf[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
        return line, to

    def hashes(self) -> np.ndarray:
        """XXH64 of each word's bytes."""
        return xxh64(self.buf, self.start, self.end)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a run of values whose two parts have hashes ``a`` and ``b``: neither symmetric nor linear."""
    return mix((a * P1) ^ b)


def window_hashes(h: np.ndarray, *widths: int) -> list[np.ndarray]:
    """For each width, the hash of each run of so many consecutive values (``len(h) - width + 1`` of them).

    Runs of 1, 2, 4 ... values are hashed from two halves each, and a run of any width from such runs, the shortest
    first. (A polynomial modulo 2**64 would let long regular sequences collide, whatever its base.)
    """
    out = [h[: max(len(h) - width + 1, 0)] if width & 1 else None for width in widths]
    reach = [width & 1 for width in widths]
    level, size = h, 1
    while 2 * size <= max(widths):
        level, size = joined(level[: max(len(level) - size, 0)], level[size:]), 2 * size
        for i, width in enumerate(widths):
            if width & size:
                n = max(len(h) - width + 1, 0)
                own = level[reach[i] : reach[i] + n]
                out[i] = own if out[i] is None else joined(out[i][:n], own)
                reach[i] += size
    return out


def sliding(values: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """``op`` (minimum or maximum) over each run of ``width`` values, by doubling."""
    out, reach = values, 1
    while reach * 2 <= width:
        out = op(out[:-reach], out[reach:])
        reach *= 2
    return op(out[: len(values) - width + 1], out[width - reach : width - reach + len(values) - width + 1])


P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _lane(x: np.ndarray, h: np.ndarray | np.uint64) -> np.ndarray:
    return _rotl(h + x * P2, 31) * P1


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each span ``buf[start:end]``; spans of equal length advance together."""
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    at8 = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    at4 = np.ndarray((len(padded) - 3,), "<u4", padded, strides=(1,))
    lengths = end - start
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    out = np.empty(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for own in np.split(order, cuts):
            if not len(own):
                continue
            n, s = int(lengths[own[0]]), start[own]
            if n > LONG_SPAN:
                out[own] = [xxhash.xxh64_intdigest(buf[a : a + n].tobytes(), seed) for a in s.tolist()]
                continue
            at = 0
            if n >= 32:
                one = np.ones(len(s), np.uint64) * np.uint64(seed)
                v = [one + P1 + P2, one + P2, one.copy(), one - P1]
                while at + 32 <= n:
                    v = [_lane(at8[s + (at + 8 * i)], x) for i, x in enumerate(v)]
                    at += 32
                h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
                for x in v:
                    h = (h ^ _lane(x, np.uint64(0))) * P1 + P4
            else:
                h = np.full(len(s), np.uint64(seed) + P5)
            h = h + np.uint64(n)
            while at + 8 <= n:
                h = _rotl(h ^ _lane(at8[s + at], np.uint64(0)), 27) * P1 + P4
                at += 8
            if at + 4 <= n:
                h = _rotl(h ^ (at4[s + at].astype(np.uint64) * P1), 23) * P2 + P3
                at += 4
            while at < n:
                h = _rotl(h ^ (padded[s + at].astype(np.uint64) * P5), 11) * P1
                at += 1
            h = (h ^ (h >> np.uint64(33))) * P2
            h = (h ^ (h >> np.uint64(29))) * P3
            out[own] = h ^ (h >> np.uint64(32))
    return out
