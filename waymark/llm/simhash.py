"""SimHash near-duplicates: 64-bit fingerprints linked by a self-join of binary tries.

Fingerprints are made in Arrow batches (numpy, no shuffle of texts). Equal fingerprints are merged by an aggregation
first, so that a group of copies of any size is one leaf. The join cuts the trie at ``b`` top bits: a task holds the
subtries of one pair of prefixes at most ``radius`` bits apart, walks both level by level in pairs of nodes, adds up
the bits by which they differ and drops a pair once they exceed the radius. Each task returns a spanning forest of
the links it found (no more rows than leaves), and components come from star contractions over these forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.textbytes import Words, pieces, text_pieces, xxh64
from waymark.operators.components import connected_components
from waymark.session import cut_lineage

SHINGLE = 3
RADIUS = 3
#: Distinct fingerprints that a prefix of the trie should hold on average. Each more bit of prefix makes more pairs of
#: prefixes that a fingerprint goes to (8 at 3 bits, 64 at 7), so prefixes are kept as short as a task's memory allows.
LEAVES = 131_072
#: Times that number that one prefix may hold, and the longest prefix (2,048 pairs at 3 bits apart for each fingerprint).
CROWDED, MAX_PREFIX = 4, 23
#: Pairs of nodes that are advanced at once.
FRONT = 1 << 19


def fingerprint_texts(texts: list[bytes], width: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """SimHash of each text; 0 for a text without words. A text with fewer words than a shingle is one shingle."""
    out = np.zeros(len(texts), np.uint64)
    for a, b in pieces(texts):
        w = Words(texts[a:b], lower=True)
        if not len(w.start):
            continue
        line, to = w.line()
        docs = np.flatnonzero(w.count)
        shingles = np.maximum(w.count[docs] - width + 1, 1)
        base = np.concatenate(([0], np.cumsum(shingles)))
        first = np.repeat(w.first[:-1][docs] - base[:-1], shingles) + np.arange(base[-1])
        last = np.minimum(first + width - 1, np.repeat(w.first[1:][docs] - 1, shingles))
        h = xxh64(line, to[first], to[last + 1] - 1, seed)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, base[:-1], axis=0, dtype=np.int32)
        major = np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little")
        out[a + docs] = np.ascontiguousarray(major).view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, mark, fp)`` for every row; ``fp`` holds the 64 bits as a long, ``mark`` is xxhash64 of the text. Null text is
    empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.concatenate([np.zeros(0, np.uint64), *(fingerprint_texts(t) for _, _, t in text_pieces(batch.column(2)))]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["id", "mark", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col), F.xxhash64(text), text).mapInArrow(run, f"id {kind}, mark long, fp long")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index linked with each of ``n`` indices."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def trie_links(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the pairs at most ``radius`` bits apart between two sorted arrays of distinct uint64
    (``right`` None: within ``left``). ``skip``: top bits equal within each array. Returns two arrays of values."""
    own = right is None
    other = left if own else right
    values = left if own else np.concatenate((left, other))
    shift = 0 if own else len(left)
    if len(left) < 1 + own or not len(other):
        return values[:0], values[:0]
    err = 0 if own else int(np.bitwise_count(np.uint64((int(left[0]) ^ int(other[0])) >> (64 - skip)))) if skip else 0
    root = np.arange(len(values))
    start = np.array([[0], [len(left)], [0], [len(other)], [err]], np.int64)
    stack = [(skip, start)]
    while stack:
        depth, front = stack.pop()
        if front.shape[1] > FRONT:
            half = front.shape[1] // 2
            stack += [(depth, front[:, :half]), (depth, front[:, half:])]
            continue
        alo, ahi, blo, bhi, e = front
        # two leaves: the rest of the bits at once
        done = (ahi - alo == 1) & (bhi - blo == 1)
        near = done & (np.bitwise_count(left[alo] ^ other[blo]) <= radius)
        links_a, links_b = [alo[near]], [blo[near] + shift]
        front = front[:, ~done]
        alo, ahi, blo, bhi, e = front
        # the budget covers all bits that are left: every pair below is linked
        whole = e + (64 - depth) <= radius
        for lo, hi, at, off in ((alo, ahi, blo + shift, 0), (blo, bhi, alo, shift)):
            n = (hi - lo)[whole]
            if len(n):
                links_a.append(np.repeat(lo[whole] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) + off)
                links_b.append(np.repeat(at[whole], n))
        a, b = np.concatenate(links_a), np.concatenate(links_b)
        if len(a):
            fresh = root[a] != root[b]
            if fresh.any():
                root = _roots_of(root, a[fresh], b[fresh])
        front = front[:, ~whole]
        if not front.shape[1]:
            continue
        alo, ahi, blo, bhi, e = front
        low = np.uint64(63 - depth)
        cut = lambda v, lo, hi: np.clip(np.searchsorted(v, ((v[lo] >> low) | np.uint64(1)) << low), lo, hi)
        amid, bmid = cut(left, alo, ahi), cut(other, blo, bhi)
        same = (alo == blo) & (ahi == bhi) if own else np.zeros(len(alo), bool)
        kids = [(alo, amid, blo, bmid, e), (amid, ahi, bmid, bhi, e), (alo, amid, bmid, bhi, e + 1)]
        kids.append(tuple(x[~same] for x in (amid, ahi, blo, bmid, e + 1)))
        front = np.concatenate([np.stack(k) for k in kids], axis=1)
        alo, ahi, blo, bhi, e = front
        ok = (ahi > alo) & (bhi > blo) & (e <= radius)
        if own:  # a node paired with itself is worth a visit only with two leaves or more
            ok &= ~((alo == blo) & (ahi == bhi) & (ahi - alo < 2))
        if ok.any():
            stack.append((depth + 1, front[:, ok]))
    tied = np.flatnonzero(root != np.arange(len(root)))
    return values[tied], values[root[tied]]


def _roots_of(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    merged = _roots(len(root), root[a], root[b])
    return merged[root]


def near_links(nodes: DataFrame, radius: int = RADIUS, leaves: int = LEAVES, n: int | None = None) -> DataFrame:
    """Links ``(u, v)`` that span the pairs at most ``radius`` bits apart. ``nodes``: distinct longs in column ``fp``."""
    stats = nodes.agg(F.count("*").alias("n"), *(F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(64))).first()
    total = stats["n"] or 0
    # the most evenly split bits go on top, so that the prefixes hold about equally many leaves
    order = sorted(range(64), key=lambda i: (abs((stats[f"b{i}"] or 0) - total / 2), i))
    b = max(3, int(np.ceil(np.log2(max(total, 1) / leaves))))
    while True:
        top = order[:b]
        prefix = F.lit(0).cast("long")
        for k, i in enumerate(top):
            prefix = prefix.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1)), b - 1 - k))
        # a prefix that holds far more than the others is split by more bits, as far as it can be
        most = nodes.groupBy(prefix.alias("p")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= CROWDED * leaves or b >= MAX_PREFIX:
            break
        b += 1
    masks = [sum(1 << x for x in c) for r in range(min(radius, b) + 1) for c in combinations(range(b), r)]
    placed = nodes.select("fp", prefix.cast("int").alias("p"))
    pairs = placed.select("fp", "p", F.explode(F.array(*map(F.lit, masks))).alias("m")).select(
        "fp", "p", F.least("p", F.col("p").bitwiseXOR(F.col("m"))).alias("lo"), F.greatest("p", F.col("p").bitwiseXOR(F.col("m"))).alias("hi")
    )
    rest = top + [i for i in range(64) if i not in top]

    def permute(v: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, rest[::-1]]
        return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(np.uint64).ravel()

    back = np.argsort(rest[::-1])

    def restore(v: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(np.ascontiguousarray(v).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, back]
        return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(np.int64).ravel()

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = key
        v = permute(pdf["fp"].to_numpy(np.int64).view(np.uint64))
        p = pdf["p"].to_numpy()
        if lo == hi:
            u, w = trie_links(np.sort(v), None, radius, b)
        else:
            u, w = trie_links(np.sort(v[p == lo]), np.sort(v[p == hi]), radius, b)
        if not len(u):
            return pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
        return pd.DataFrame({"u": restore(u), "v": restore(w)})

    return pairs.groupBy("lo", "hi").applyInPandas(join, "u long, v long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``(id, mark, fp, component, component_id)`` for every row: ``component`` names the group, also one without ids."""
    fps = cut_lineage(fingerprints(docs, id_col, text_col))
    nodes = fps.groupBy("fp").agg(F.min("id").alias("low"))
    parts = connected_components(near_links(nodes.select("fp"), radius))
    named = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    of = named.join(lowest, "component").select("fp", "component", "component_id")
    return fps.join(of, "fp").select("id", "mark", "fp", "component", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``(id, fp, component_id)`` for every row; documents link when their fingerprints differ in ``radius`` bits or fewer.

    ``component_id`` is the smallest id reachable over links. Null and empty texts have fingerprint zero and link like
    any other. Rows that repeat an id keep a row each; a null id takes part but never names a component (null only if
    no row of its component has an id). An empty table gives an empty table; columns other than the two are not read.
    """
    return groups(docs, id_col, text_col, radius).select("id", "fp", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates: that of the smallest id, of rows that repeat it the one of
    the least hash of its text. Rows without an id stay. Null, empty and blank texts have fingerprint zero and group like
    any other. An empty table gives an empty table. The texts are shuffled once, to meet the rows to keep."""
    return keep_lowest(docs, groups(docs, id_col, text_col, radius), id_col, text_col)


def keep_lowest(docs: DataFrame, grouped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows that ``representatives`` keeps of the groups ``(id, mark, component, component_id)``."""
    kept = (
        grouped.where("id = component_id").groupBy("component").agg(F.min(F.struct("id", "mark")).alias("k"))
        .select(F.col("k.id").alias("_id"), F.col("k.mark").alias("_mark")).distinct()
    )
    # the row in one struct, so that no column of the caller's can clash with those of the join
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col).cast("string")).alias("_mark"), F.struct(*docs.columns).alias("_row"))
    order = Window.partitionBy("_id", "_mark").orderBy("_id")
    once = named.join(kept, ["_id", "_mark"]).withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return once.select("_row.*").unionByName(docs.where(F.col(id_col).isNull()))
