"""SentencePiece encoding and decoding with batched numpy Viterbi.

Texts become code points and are cut into segments that no piece can span: before a space mark that follows another
character, and around characters that occur in no piece of several characters. Distinct segments of equal length
advance together, one position at a time: hashes of the substrings that end there probe the sorted piece keys, the
best candidate of each segment is kept, and its length is stored as a backpointer. Hashes only propose: where a piece
or a segment met before is found by one, its code points are compared.

What is best depends on the model. A unigram model maximises the sum of piece scores. A BPE model has no scores to
add, but its result is a Viterbi path all the same: each prefix of a BPE encoding ending at a piece border is itself
the BPE encoding of that prefix, so a piece may end a prefix only if BPE would leave the border to the piece before it
in place, and exactly one piece can. That test of two pieces walks back through their merges.

Models with byte fallback and the identity normaliser are supported, as the tests compare them with the library.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructType

from waymark.llm.textbytes import mix, text_pieces, window_hashes, xxh64

MARK = "▁"
#: Bytes of text that are handled at once.
PIECE_BYTES = 1 << 20
#: Segments longer than this are walked one by one.
LONG = 64
#: Segments whose pieces a task remembers, and code points of all of them.
REMEMBERED = 1 << 19
REMEMBERED_POINTS = 1 << 23
#: Code points of new segments that are looked up at once.
LOOKED_UP = 1 << 17
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
FAR = np.int32(2**31 - 1)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


@dataclass(frozen=True)
class Vocabulary:
    """Pieces, scores and kinds of a model file (fields as in its published message format)."""

    pieces: tuple[str, ...]
    scores: np.ndarray
    kinds: np.ndarray
    model: int
    dummy_prefix: bool

    @staticmethod
    def parse(data: bytes) -> Vocabulary:
        pieces, scores, kinds, model, dummy, plain = [], [], [], UNIGRAM, True, True
        for field, value in _fields(data):
            if field == 1:
                own = dict(_fields(value))
                pieces.append(own.get(1, b"").decode("utf-8"))
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, NORMAL))
            elif field == 2:
                model = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                own = dict(_fields(value))
                dummy = bool(own.get(3, 1))
                plain = not own.get(2, b"") and not own.get(4, 1) and bool(own.get(5, 1))
        kinds = np.array(kinds, np.int8)
        if model not in (UNIGRAM, BPE) or not plain or (kinds == BYTE).sum() != 256:
            raise ValueError("only unigram and BPE models with byte fallback and the identity normaliser are supported")
        return Vocabulary(tuple(pieces), np.array(scores), kinds, model, dummy)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _ramps(sizes: np.ndarray) -> np.ndarray:
    """0, 1 ... size - 1 for each size, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _same_runs(one: np.ndarray, start: np.ndarray, size: np.ndarray, other: np.ndarray, other_start: np.ndarray, other_size: np.ndarray) -> np.ndarray:
    """Whether each run of ``one`` equals its run of ``other``."""
    out = size == other_size
    at = np.flatnonzero(out & (size > 0))
    if len(at):
        step, n = _ramps(size[at]), size[at]
        equal = one[np.repeat(start[at], n) + step] == other[np.repeat(other_start[at], n) + step]
        out[at] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    return out


class Encoder:
    """Tables of a vocabulary (their size follows the vocabulary's alone) and the encoding of texts with them."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = v = vocabulary
        self.size = len(v.pieces)
        usable = [i for i in range(self.size) if v.kinds[i] in (NORMAL, USER_DEFINED) and v.pieces[i]]
        self.ids = {v.pieces[i]: i for i in usable}
        self.longest = max((len(v.pieces[i]) for i in usable), default=1)
        self.points = _points("".join(v.pieces[i] for i in usable))
        self.width = np.zeros(self.size, np.int64)
        self.width[usable] = [len(v.pieces[i]) for i in usable]
        self.first = np.cumsum(self.width) - self.width
        keys = np.zeros(self.size, np.uint64)
        for n in range(1, self.longest + 1):
            own = np.flatnonzero(self.width == n)
            keys[own] = self._runs(self.points[(self.first[own][:, None] + np.arange(n)).ravel()], n)[::n] if len(own) else 0
        order = np.array(usable, np.int32)[np.argsort(keys[usable])] if usable else np.zeros(0, np.int32)
        self.keys, self.key_ids = keys[order], order
        if len(np.unique(self.keys)) < len(usable):
            raise ValueError("two pieces share a key")
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        # 0: stands in pieces of several characters, 1: alone or unknown, 2: space mark
        self.classes = np.ones(0x110000, np.uint8)
        for i in usable:
            if len(v.pieces[i]) > 1:
                self.classes[_points(v.pieces[i])] = 0
        # a mark ends a segment only if no piece holds one behind another character
        inner = any(MARK in v.pieces[i].lstrip(MARK) for i in usable)
        self.classes[ord(MARK)] = 0 if inner else 2
        self.bytes = np.zeros(256, np.int32)
        for i in np.flatnonzero(v.kinds == BYTE):
            self.bytes[int(v.pieces[i][1:-1], 16)] = i
        if v.model == BPE:
            self._merges()
        self.unknown_score = float(v.scores[usable].min()) - UNKNOWN_PENALTY if usable else -UNKNOWN_PENALTY

    @staticmethod
    def _runs(points: np.ndarray, *sizes: int) -> np.ndarray | list[np.ndarray]:
        """Hashes of the runs of code points of each size."""
        found = window_hashes(mix(points.astype(np.uint64) + np.uint64(1)), *sizes)
        return found[0] if len(sizes) == 1 else found

    # -- BPE ------------------------------------------------------------------------------------------------------

    def _merges(self) -> None:
        """How each piece is built: its two parts, and the time (rank of the latest merge) from which it stands."""
        pieces, rank = self.v.pieces, -self.v.scores.astype(np.int64)
        n = self.size + 1
        self.left, self.right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        self.birth = np.full(n, -1, np.int32)
        pairs = {}
        for text, i in self.ids.items():
            for cut in range(1, len(text)):
                a, b = self.ids.get(text[:cut]), self.ids.get(text[cut:])
                if a is not None and b is not None:
                    pairs[a * n + b] = i
        for text, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            if len(text) < 2:
                continue
            parts = [self.ids.get(c, self.size) for c in text]
            while len(parts) > 1:
                found = [(rank[z], k, z) for k in range(len(parts) - 1) if (z := pairs.get(parts[k] * n + parts[k + 1])) is not None]
                if not found:
                    break
                _, k, z = min(found)
                if len(parts) == 2:
                    self.left[i], self.right[i] = parts
                    self.birth[i] = max(rank[i], self.birth[parts[0]], self.birth[parts[1]])
                parts[k : k + 2] = [z]
            if len(parts) > 1 or parts[0] != i:
                self.birth[i] = FAR  # never built from its characters
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys, self.pair_rank = keys, np.array([rank[pairs[k]] for k in keys.tolist()], np.int64)
        self.pairs = {k: int(rank[z]) for k, z in pairs.items()}
        self.memo_key, self.memo = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        self.scalar_memo: dict[int, bool] = {}

    def _borders_hold(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves pieces ``a`` and ``b`` apart where they meet (``self.size`` stands for an unknown character)."""
        key = a.astype(np.int64) * (self.size + 1) + b
        at = (mix(key.view(np.uint64)) >> np.uint64(44)).astype(np.int64)
        fresh = np.flatnonzero(self.memo_key[at] != key)
        if len(fresh):
            distinct, of = np.unique(key[fresh], return_inverse=True)
            value = self._walk(distinct // (self.size + 1), distinct % (self.size + 1))
            to = (mix(distinct.view(np.uint64)) >> np.uint64(44)).astype(np.int64)
            out = np.empty(len(key), bool)
            known = np.ones(len(key), bool)
            known[fresh] = False
            out[known] = self.memo[at[known]]
            out[fresh] = value[of]
            _, one = np.unique(to, return_index=True)  # one key a place
            self.memo_key[to[one]], self.memo[to[one]] = distinct[one], value[one]
            return out
        return self.memo[at]

    def _walk(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        hold = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        dies_x, dies_y = np.full(len(a), FAR, np.int64), np.full(len(a), FAR, np.int64)
        while len(live):
            key = x * (self.size + 1) + y
            at = np.searchsorted(self.pair_keys, key) if len(self.pair_keys) else np.zeros(len(key), np.int64)
            at[at == len(self.pair_keys)] = 0
            merges = (self.pair_keys[at] == key) if len(self.pair_keys) else np.zeros(len(key), bool)
            rank = np.where(merges, self.pair_rank[at] if len(self.pair_rank) else 0, FAR)
            broken = merges & (rank < dies_x) & (rank <= dies_y)
            hold[live[broken]] = False
            split_x = self.birth[x] > self.birth[y]
            whole = np.where(split_x, self.left[x] < 0, self.left[y] < 0)
            go = ~broken & ~whole
            live, x, y, dies_x, dies_y, split_x = (z[go] for z in (live, x, y, dies_x, dies_y, split_x))
            dies_x = np.where(split_x, self.birth[x], dies_x)
            dies_y = np.where(split_x, dies_y, self.birth[y])
            x, y = np.where(split_x, self.right[x], x), np.where(split_x, y, self.left[y])
        return hold

    # -- Viterbi --------------------------------------------------------------------------------------------------

    def _lookup(self, points: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Ids of the pieces that start at each code point, one row a size; -1 where there is none of that size.

        ``left``: how many code points there are from each on to the end of its segment.
        """
        out = np.full((self.longest + 1, len(points)), -1, np.int32)
        for size, h in enumerate(self._runs(points, *range(1, self.longest + 1)) if self.longest > 1 else [self._runs(points, 1)], 1):
            at = np.flatnonzero(self.filter[(h >> np.uint64(44)).astype(np.int64)] & (left[: len(h)] >= size))
            place = np.searchsorted(self.keys, h[at])
            place[place == len(self.keys)] = 0
            hit = np.flatnonzero(self.keys[place] == h[at]) if len(self.keys) else place[:0]
            at, piece = at[hit], self.key_ids[place[hit]]
            same = self.width[piece] == size
            for k in range(size):
                same &= self.points[np.minimum(self.first[piece] + k, len(self.points) - 1)] == points[np.minimum(at + k, len(points) - 1)]
            out[size, at[same]] = piece[same]
        return out

    def _advance(self, pieces: np.ndarray, start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Last piece and its length for each prefix of segments of ``n`` characters: arrays (n + 1, segments).

        ``pieces``: what ``_lookup`` found, ``start`` the columns of the segments in it.
        """
        m = len(start)
        last, back = np.full((n + 1, m), self.size, np.int32), np.ones((n + 1, m), np.int8)
        best = np.zeros((n + 1, m)) if self.v.model == UNIGRAM else None
        for i in range(1, n + 1):
            if best is not None:
                best[i] = best[i - 1] + self.unknown_score
            open_ = np.arange(m)
            for size in range(min(i, self.longest), 0, -1):
                piece = pieces[size, start[open_] + (i - size)]
                found = np.flatnonzero(piece >= 0)
                if not len(found):
                    continue
                who, piece = open_[found], piece[found]
                if best is not None:
                    total = best[i - size, who] + self.v.scores[piece]
                    better = total > best[i, who] if size > 1 else (total > best[i, who]) | (last[i, who] == self.size)
                    who, piece = who[better], piece[better]
                    best[i, who] = total[better]
                    last[i, who], back[i, who] = piece, size
                    continue
                if i > size:
                    ok = self._borders_hold(last[i - size, who], piece)
                else:
                    ok = np.ones(len(who), bool)
                if size > 1:
                    ok &= self.birth[piece] < FAR
                last[i, who[ok]], back[i, who[ok]] = piece[ok], size
                shut = np.zeros(len(open_), bool)
                shut[found[ok]] = True
                open_ = open_[~shut]
                if not len(open_):
                    break
        return last, back

    def _long(self, points: np.ndarray) -> list[int]:
        """Pieces of one long segment, by the same recurrence (an unknown character gives ``size`` + its code point)."""
        text = points.tobytes().decode("utf-32-le", "surrogatepass")
        n = len(text)
        last, back, best = [self.size] * (n + 1), [1] * (n + 1), [0.0] * (n + 1)
        for i in range(1, n + 1):
            best[i] = best[i - 1] + self.unknown_score
            for size in range(min(i, self.longest), 0, -1):
                piece = self.ids.get(text[i - size : i])
                if piece is None:
                    continue
                if self.v.model == UNIGRAM:
                    total = best[i - size] + self.v.scores[piece]
                    if total > best[i] or (size == 1 and last[i] == self.size):
                        best[i], last[i], back[i] = total, piece, size
                    continue
                if size > 1 and self.birth[piece] == FAR:
                    continue
                if i > size:
                    key = last[i - size] * (self.size + 1) + piece
                    hold = self.scalar_memo.get(key)
                    if hold is None:
                        hold = self.scalar_memo[key] = bool(self._walk(np.array([last[i - size]], np.int64), np.array([piece], np.int64))[0])
                    if not hold:
                        continue
                last[i], back[i] = piece, size
                break
        out, i = [], n
        while i:
            out.append(last[i] if last[i] < self.size else self.size + ord(text[i - 1]))
            i -= back[i]
        return out[::-1]

    def segments(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some segments, one after another, and how many each has."""
        size = end - start
        chunks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # segment, place from its end, id
        for k in np.flatnonzero(size > LONG).tolist():
            ids = np.array(self._long(points[start[k] : end[k]])[::-1], np.int64)
            chunks.append((np.full(len(ids), k), np.arange(len(ids)), ids))
        order = np.argsort(size, kind="stable")
        order = order[(size[order] > 0) & (size[order] <= LONG)]
        ends = np.cumsum(size[order])
        for part in np.split(order, np.flatnonzero(np.diff(ends // LOOKED_UP)) + 1):
            if not len(part):
                continue
            n = size[part]
            step = _ramps(n)
            own = points[np.repeat(start[part], n) + step]
            pieces, first = self._lookup(own, np.repeat(n, n) - step), np.cumsum(n) - n
            for same in np.split(np.arange(len(part)), np.flatnonzero(np.diff(n)) + 1):
                self._together(pieces, own, first[same], part[same], int(n[same[0]]), chunks)
        if not chunks:
            return np.zeros(0, np.int32), np.zeros(len(start), np.int64)
        seg, place, ids = (np.concatenate(x) for x in zip(*chunks))
        by = np.lexsort((-place, seg))
        seg, ids = seg[by], ids[by]
        return self._spell(seg, ids, len(start))

    def _together(self, pieces: np.ndarray, points: np.ndarray, first: np.ndarray, names: np.ndarray, n: int, chunks: list) -> None:
        """The pieces of segments of ``n`` characters each, walked back from their ends, into ``chunks``."""
        last, back = self._advance(pieces, first, n)
        at, who, step = np.full(len(first), n), np.arange(len(first)), 0
        while len(who):
            ids = last[at, who].astype(np.int64)
            unknown = ids == self.size
            if unknown.any():
                ids[unknown] += points[first[who[unknown]] + at[unknown] - 1]
            chunks.append((names[who], np.full(len(who), step), ids))
            at = at - back[at, who]
            who, at = who[at > 0], at[at > 0]
            step += 1

    def _spell(self, seg: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters become the byte pieces of their UTF-8."""
        point = ids - self.size
        width = np.where(point < 0, 1, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000))
        if (point >= 0).any():
            first = np.concatenate(([0], np.cumsum(width)[:-1]))
            out = np.repeat(ids, width)
            for at in np.flatnonzero(point >= 0):
                raw = chr(point[at]).encode("utf-8", "surrogatepass")
                out[first[at] : first[at] + len(raw)] = self.bytes[np.frombuffer(raw, np.uint8)]
            ids, seg = out, np.repeat(seg, width)
        return ids.astype(np.int32), np.bincount(seg, minlength=n)


class Remembering:
    """Encodes texts and remembers up to ``REMEMBERED`` segments from one call to the next."""

    def __init__(self, encoder: Encoder):
        self.e = encoder
        self._forget()

    def _forget(self) -> None:
        self.keys, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.at, self.size, self.points = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        decoded = [t.decode("utf-8", "replace").replace(" ", MARK) for t in texts]
        prefix = MARK if self.e.v.dummy_prefix else ""
        lines = [prefix + t if t else "" for t in decoded]
        points = _points("".join(lines))
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        sizes = np.array([len(x) for x in lines])
        ends = np.cumsum(sizes)
        kind = self.e.classes[points]
        border = np.empty(len(points), bool)
        border[1:] = (kind[1:] == 1) | (kind[:-1] == 1) | ((kind[1:] == 2) & (kind[:-1] != 2))
        border[(ends - sizes)[sizes > 0]] = True
        start = np.flatnonzero(border)
        ids, count = self._segments(points, start, np.append(start[1:], len(points)))
        before = np.concatenate(([0], np.cumsum(count)))
        return ids, np.diff(before[np.searchsorted(start, np.concatenate(([0], ends)))])

    def _segments(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments as ``Encoder.segments`` has them; equal segments are worked out once."""
        size = end - start
        h = self._names(points, start, end)
        distinct, rep, of = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > REMEMBERED or len(self.points) + int(size[rep].sum()) > REMEMBERED_POINTS:
            self._forget()
        place = np.searchsorted(self.keys, distinct)
        place[place == len(self.keys)] = 0
        new = np.flatnonzero(self.keys[place] != distinct) if len(self.keys) else np.arange(len(distinct))
        if len(new):
            own = rep[new]
            ids, count = self.e.segments(points, start[own], end[own])
            first = len(self.ids) + np.cumsum(count) - count
            at = len(self.points) + np.cumsum(size[own]) - size[own]
            to = np.searchsorted(self.keys, distinct[new])
            self.keys, self.first, self.count, self.at, self.size = (
                np.insert(x, to, y) for x, y in ((self.keys, distinct[new]), (self.first, first), (self.count, count), (self.at, at), (self.size, size[own]))
            )
            self.ids = np.concatenate((self.ids, ids))
            self.points = np.concatenate((self.points, points[np.repeat(start[own], size[own]) + _ramps(size[own])]))
            place = np.searchsorted(self.keys, distinct)
        place = place[of]
        pool, first, count = self.ids, self.first[place], self.count[place]
        # a segment with the hash of another one is worked out by itself
        odd = np.flatnonzero(~_same_runs(points, start, size, self.points, self.at[place], self.size[place]))
        if len(odd):
            ids, count[odd] = self.e.segments(points, start[odd], end[odd])
            first[odd] = len(pool) + np.cumsum(count[odd]) - count[odd]
            pool = np.concatenate((pool, ids))
        return pool[np.repeat(first, count) + _ramps(count)], count

    def _names(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the segments."""
        return xxh64(points.view(np.uint8), 4 * start, 4 * end)


class Decoder:
    """Turns ids back into text."""

    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        raw = [
            bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode()
            for p, k in zip(v.pieces, v.kinds)
        ]
        self.size = np.array([len(x) for x in raw] + [0])
        self.first = np.concatenate(([0], np.cumsum(self.size[:-1])))
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.dummy = v.dummy_prefix

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of runs of ids; ids outside the vocabulary stand for nothing."""
        known = np.where((ids >= 0) & (ids < len(self.size) - 1), ids, len(self.size) - 1)
        size = self.size[known]
        ends = np.concatenate(([0], np.cumsum(size)))
        line = self.raw[np.repeat(self.first[known] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        cut = ends[np.concatenate(([0], np.cumsum(counts)))].tolist()
        texts = (line[a:b] for a, b in zip(cut, cut[1:]))
        return [(t[1:] if self.dummy and t[:1] == b" " else t).decode("utf-8", "replace") for t in texts]


@lru_cache(maxsize=2)
def _encoder(model: bytes) -> Encoder:
    return Encoder(Vocabulary.parse(model))


@lru_cache(maxsize=2)
def _decoder(model: bytes) -> Decoder:
    return Decoder(Vocabulary.parse(model))


def _with(schema: StructType, name: str, kind: object) -> StructType:
    return StructType([f for f in schema.fields if f.name != name]).add(name, kind)


def encode(docs: DataFrame, model: bytes, text_col: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with an array of piece ids of every whole text, without a shuffle.

    Null and empty texts give an empty array; repeated rows keep a row each; a column of the name ``into`` is replaced;
    an empty table gives an empty table. ``model``: contents of a model file (broadcast; its size is the vocabulary's).
    """
    Vocabulary.parse(model)
    kept = docs.drop(into)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Remembering(_encoder(shared.value))
        for batch in batches:
            for a, b, texts in text_pieces(batch.column(at), PIECE_BYTES):
                ids, counts = own.encode(texts)
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*rows.columns, _lists(ids, counts)], names=[*rows.schema.names, into])

    return kept.mapInArrow(run, _with(docs.schema, into, ArrayType(IntegerType(), False)))


def decode(rows: DataFrame, model: bytes, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the text of each array of ids; a null array gives an empty text, as an empty one does."""
    kept = rows.drop(into)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    at = kept.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _decoder(shared.value)
        for batch in batches:
            column = batch.column(at)
            counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ids = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.decode(ids, counts), pa.string())], names=[*batch.schema.names, into])

    return kept.mapInArrow(run, _with(rows.schema, into, StringType()))


def model_bytes(path: str) -> bytes:
    """Contents of a model file that the driver can read (the path is a parameter of the caller)."""
    with open(path, "rb") as file:
        return file.read()


def round_trip(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, n_tokens, ids, same)`` of every document: its ids, and whether decoding them gives the text back.

    ``keep``: columns to carry along, behind the id. Null and empty texts have no tokens and count as the same; repeated
    rows keep a row each, null ids stay, texts of any length are whole, and an empty table gives an empty table. A text
    that holds the space mark itself comes back with spaces: ``same`` is false.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col), *keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, back = Remembering(_encoder(shared.value)), _decoder(shared.value)
        for batch in batches:
            for a, b, texts in text_pieces(batch.column(0), PIECE_BYTES):
                ids, counts = own.encode(texts)
                same = [x.encode("utf-8") == y for x, y in zip(back.decode(ids, counts), texts)]
                columns = [*(c.slice(a, b - a) for c in batch.columns[1:]), pa.array(counts, pa.int64()), _lists(ids, counts), pa.array(same)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [id_col, *keep, "n_tokens", "ids", "same"]
    schema = StructType([docs.schema[c] for c in (id_col, *keep)]).add("n_tokens", LongType()).add("ids", ArrayType(IntegerType(), False)).add("same", BooleanType())
    return rows.mapInArrow(run, schema)


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(ids))
