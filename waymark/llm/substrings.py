"""Substring dedup: suffix automata of reference shards, and matching statistics of what is streamed past them.

A word goes if a window of ``WINDOW`` words around it also starts in a document with a smaller id. Streaming every
document past the automaton of every shard would grow with the square of the corpus, so the shards are made by
content, and only text that can match is brought to them:

1. Each window has an anchor, its gram of least hash (winnowing): equal windows have equal anchors. Anchors that stand
   in two documents or more are kept in a bit map of fixed size.
2. So are the hashes of windows with such an anchor that start in two documents or more.
3. Runs of windows that pass both maps and share an anchor are passages, equal if the 128-bit BLAKE2b digests of their
   words are. Of equal passages only that of the least id is dealt to a shard, chosen by its anchor (a third map says
   which), so a group of copies of any size is one passage.
4. A shard takes its passages by ascending id. Each is streamed past the suffix automaton of those with smaller ids;
   a matching length of a window or more marks that window; then the passage joins the automaton. Words themselves are
   compared here, not hashes.
   An anchor with very many words of distinct passages would be too much for one shard. Its windows are passages of
   their own instead: of equal ones, by the same digests, all but those of the least id are marked, by an aggregation.
5. The marks go back to the documents, whose texts are shuffled this once.

The maps only keep work away: bits that are set by chance (or by a corpus too large for ``MAP_BITS``) cost time and
never change a result. Their size follows what they hold, up to ``MAP_BITS``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from waymark.llm.textbytes import Words, mix, sliding, text_pieces, window_hashes
from waymark.session import cut_lineage

WINDOW = 50
GRAM = 12
#: Bits of each map at most (64 MB), and bits for each hash that it holds.
MAP_BITS = 29
BITS_EACH = 64
#: Words of distinct passages that a shard should hold.
SHARD_WORDS = 60_000
#: Words of distinct passages from which on an anchor's windows are compared one by one.
CROWDED_WORDS = 500_000
#: Bits for the place of a gram, and windows whose anchors are found at once.
PLACE_BITS = 24
SPAN = 1 << 20


class Windows:
    """The windows of some texts: ``start`` (word index), ``doc``, ``hash`` and ``anchor`` (hash of the least gram)."""

    def __init__(self, words: Words, window: int = WINDOW, gram: int = GRAM):
        n = len(words.start)
        none = np.zeros(0, np.int64)
        self.start, self.doc, self.hash, self.anchor = none, none, none.astype(np.uint64), none.astype(np.uint64)
        if n < window:
            return
        left = np.repeat(words.first[1:], words.count) - np.arange(n)
        self.start = np.flatnonzero(left >= window)
        if not len(self.start):
            return
        grams, windows = window_hashes(words.hashes(), gram, window)
        self.doc = words.doc[self.start]
        self.hash = windows[self.start]
        # mixed again, as the least of many hashes have small leading bits, which name the bits of a map
        self.anchor = mix(_anchors(grams, window - gram + 1)[self.start])


def _anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """The gram of least hash (by its leading bits; of equal ones the first) of each run of ``width`` grams.

    Places count from the start of a span of bounded length, so the rule is the same for texts of any size.
    """
    low = np.uint64((1 << PLACE_BITS) - 1)
    out = np.empty(max(len(grams) - width + 1, 0), np.uint64)
    for a in range(0, len(out), SPAN):
        own = grams[a : a + SPAN + width - 1]
        least = sliding((own & ~low) | np.arange(len(own), dtype=np.uint64), width, np.minimum)
        out[a : a + SPAN] = own[(least & low).astype(np.int64)]
    return out


def _in_map(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bits of some hashes, named by their leading bits, are set."""
    at = (h >> np.uint64(64 - (8 * len(bits)).bit_length() + 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _map_of(hashes: DataFrame) -> np.ndarray:
    """Bit map of the hashes in column ``h`` (of a table that is written already)."""
    bits = min(MAP_BITS, max(16, (BITS_EACH * hashes.count()).bit_length()))
    place = F.shiftrightunsigned("h", 64 - bits)
    # at most 2 ** (bits - 6) rows
    found = (
        hashes.select(place.alias("p"))
        .select(F.shiftrightunsigned("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63L as int))").alias("m"))
        .groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    )
    words = np.zeros(1 << (bits - 6), np.int64)
    words[found.column("w").to_numpy()] = found.column("m").to_numpy()
    return words.view(np.uint8)


def _repeated(hashes: DataFrame) -> DataFrame:
    """Hashes that stand in two rows or more; each row gives a hash once."""
    return cut_lineage(hashes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))


def _over_windows(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run(words, windows, ids, marks)`` over the pieces of ``rows`` (id, mark, text), giving the columns of ``schema``."""
    names = [x.split()[0] for x in schema.split(",")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b, texts in text_pieces(batch.column(2), 1 << 20):
                words = Words(texts)
                windows = Windows(words)
                if len(windows.start):
                    columns = run(words, windows, ids[a:b], marks[a:b])
                    if len(columns[0]):
                        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=names)

    return rows.mapInArrow(each, schema)


def _distinct(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places of the first of each pair of hash and document."""
    by = np.lexsort((h, doc))
    h, doc = h[by], doc[by]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return by[fresh]


def _passages(words: Words, w: Windows, anchors: np.ndarray, repeated: np.ndarray, crowded: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of the runs of candidate windows that share an anchor, and whether that is crowded: each of
    its windows is a run then."""
    ok = np.flatnonzero(_in_map(anchors, w.anchor))
    ok = ok[_in_map(repeated, w.hash[ok])]
    if not len(ok):
        return ok, ok, np.zeros(0, bool)
    alone = np.zeros(len(ok), bool) if crowded is None else _in_map(crowded, w.anchor[ok])
    new = np.ones(len(ok), bool)
    new[1:] = (w.start[ok[1:]] != w.start[ok[:-1]] + 1) | (w.doc[ok[1:]] != w.doc[ok[:-1]]) | (w.anchor[ok[1:]] != w.anchor[ok[:-1]])
    at = np.flatnonzero(new | alone)
    return ok[at], ok[np.append(at[1:], len(ok)) - 1], alone[at]


class SuffixAutomaton:
    """Suffix automaton of several word sequences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.size = [0]

    def add(self, words: list) -> None:
        following, link, size = self.next, self.link, self.size
        last = 0
        for c in words:
            known = following[last].get(c)
            if known is not None:
                if size[known] == size[last] + 1:
                    last = known
                    continue
                last = self._split(last, known, c)
                continue
            new = len(size)
            following.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in following[p]:
                following[p][c] = new
                p = link[p]
            if p >= 0:
                q = following[p][c]
                link[new] = q if size[q] == size[p] + 1 else self._split(p, q, c)
            last = new

    def _split(self, p: int, q: int, c: object) -> int:
        """A copy of state ``q`` for the words that reach it from ``p`` and its suffixes."""
        copy = len(self.size)
        self.next.append(self.next[q].copy())
        self.size.append(self.size[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def matching(self, words: list) -> list[int]:
        """For each word, how many words up to it are found somewhere in the sequences."""
        following, link, size = self.next, self.link, self.size
        state = length = 0
        out = []
        for c in words:
            to = following[state].get(c)
            while to is None and state:
                state = link[state]
                length = size[state]
                to = following[state].get(c)
            if to is None:
                length = 0
            else:
                state = to
                length += 1
            out.append(length)
        return out


def mark_shard(passages: list[tuple[int, list]], window: int = WINDOW) -> list[list[int]]:
    """For each passage (id, words), the windows found in a passage of a smaller id: first, last, first, last ..."""
    automaton = SuffixAutomaton()
    out: list[list[int]] = [[] for _ in passages]
    order = sorted(range(len(passages)), key=lambda i: passages[i][0])
    for _, same in groupby(order, key=lambda i: passages[i][0]):
        fresh = []
        for i in same:
            words = passages[i][1]
            lengths = automaton.matching(words)
            runs = out[i]
            for end, n in enumerate(lengths):
                if n >= window:
                    at = end - window + 1
                    if runs and runs[-1] == at - 1:
                        runs[-1] = at
                    else:
                        runs += [at, at]
            if not words or lengths[-1] < len(words):
                fresh.append(words)
        for words in fresh:
            automaton.add(words)
    return out


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, mark, spans)``: words to remove, as first and last word index of each span, of rows that lose some.

    ``mark`` is xxhash64 of the text, so that rows that share an id keep apart.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    rows = rows.select("id", F.xxhash64("text").alias("mark"), "text")
    context = docs.sparkSession.sparkContext

    def of_anchors(words: Words, w: Windows, ids: np.ndarray, marks: np.ndarray) -> list:
        return [w.anchor[_distinct(w.anchor, w.doc)].view(np.int64)]

    anchors = context.broadcast(_map_of(_repeated(_over_windows(rows, of_anchors, "h long"))))

    def of_windows(words: Words, w: Windows, ids: np.ndarray, marks: np.ndarray) -> list:
        ok = np.flatnonzero(_in_map(anchors.value, w.anchor))
        return [w.hash[ok[_distinct(w.hash[ok], w.doc[ok])]].view(np.int64)]

    windows = context.broadcast(_map_of(_repeated(_over_windows(rows, of_windows, "h long"))))

    def placed(crowded: Broadcast | None) -> DataFrame:
        def of_places(words: Words, w: Windows, ids: np.ndarray, marks: np.ndarray) -> list:
            first, last, alone = _passages(words, w, anchors.value, windows.value, crowded and crowded.value)
            doc, start = w.doc[first], w.start[first]
            anchor, (content, check) = w.anchor[first], _digests(_texts(words, w, first, last))
            return [x.view(np.int64) for x in (anchor, content, check, _owned(anchor, content, ids[doc]))] + [
                ids[doc], marks[doc], (start - words.first[doc]).astype(np.int32), (w.start[last] - start + 1).astype(np.int32), pa.array(alone)
            ]

        schema = "anchor long, content long, check long, own long, id long, mark long, first int, windows int, alone boolean"
        return cut_lineage(_over_windows(rows, of_places, schema))

    def different(places: DataFrame) -> DataFrame:
        return cut_lineage(places.where("not alone").groupBy(*PASSAGE).agg(F.min_by("own", "id").alias("h"), F.max("windows").alias("windows")))

    crowded, size = None, F.sum(F.col("windows") + F.lit(WINDOW - 1)).alias("words")
    places = placed(None)
    distinct = different(places)
    many = cut_lineage(distinct.groupBy(F.col("anchor").alias("h")).agg(size).where(F.col("words") > CROWDED_WORDS).select("h"))
    if not many.isEmpty():
        crowded = context.broadcast(_map_of(many))
        places = placed(crowded)
        distinct = different(places)
    total = distinct.agg(size).first()[0] or 0
    owners = context.broadcast(_map_of(distinct))

    def of_texts(words: Words, w: Windows, ids: np.ndarray, marks: np.ndarray) -> list:
        first, last, alone = _passages(words, w, anchors.value, windows.value, crowded and crowded.value)
        first, last = first[~alone], last[~alone]
        texts = _texts(words, w, first, last)
        anchor, id_, (content, check) = w.anchor[first], ids[w.doc[first]], _digests(texts)
        ok = np.flatnonzero(_in_map(owners.value, _owned(anchor, content, id_)))
        passage = pa.array([texts[i] for i in ok.tolist()], pa.binary()).cast(pa.string())
        return [*(x[ok].view(np.int64) for x in (anchor, content, check)), id_[ok], passage]

    marked = cut_lineage(_marked(_over_windows(rows, of_texts, "anchor long, content long, check long, id long, passage string"), int(total)))
    if crowded is not None:
        alone = places.where("alone").groupBy(*PASSAGE).agg(F.min("id").alias("low")).withColumn("runs", F.array().cast("array<int>"))
        marked = marked.unionByName(alone)
    for shared in filter(None, (anchors, windows, owners, crowded)):
        shared.destroy()
    return (
        places.join(marked, PASSAGE)
        .select(
            "id", "mark",
            F.when(F.col("id") > F.col("low"), F.array(F.col("first"), F.col("first") + F.col("windows") + F.lit(WINDOW - 2)))
            .otherwise(F.transform("runs", lambda x, i: F.col("first") + x + (i % 2) * F.lit(WINDOW - 1))).alias("spans"),
        )
        .where("size(spans) > 0")
        .groupBy("id", "mark").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    )


#: What names a passage: its anchor, and the two halves of the digest of its words.
PASSAGE = ["anchor", "content", "check"]


def _texts(words: Words, w: Windows, first: np.ndarray, last: np.ndarray) -> list[bytes]:
    """The words of each run of windows, one space between them."""
    if not len(first):
        return []
    line, to = words.line()
    line = line.tobytes()
    return [line[a:b] for a, b in zip(to[w.start[first]].tolist(), (to[w.start[last] + WINDOW] - 1).tolist())]


def _digests(passages: list[bytes]) -> np.ndarray:
    """The two halves of the 128-bit digest of each passage."""
    raw = b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in passages)
    return np.frombuffer(raw, np.uint64).reshape(-1, 2).T


def _owned(anchor: np.ndarray, content: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Hash of a passage in a document."""
    return mix(anchor ^ mix(content ^ mix(ids.astype(np.int64).view(np.uint64))))


def _marked(texts: DataFrame, words: int) -> DataFrame:
    """``(anchor, content, check, low, runs)`` of distinct passages, by the automata of their shards."""
    shards = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-words // SHARD_WORDS))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # a passage of a larger id can come along by a chance bit
        pdf = pdf.sort_values("id", kind="stable").drop_duplicates(PASSAGE)
        marks = mark_shard([(low, text.split(" ")) for low, text in zip(pdf["id"], pdf["passage"])])
        return pd.DataFrame({c: pdf[c] for c in PASSAGE} | {"low": pdf["id"], "runs": marks})

    return texts.withColumn("shard", F.pmod("anchor", F.lit(shards))).groupBy("shard").applyInPandas(run, "anchor long, content long, check long, low long, runs array<int>")


def cover(runs: list[int] | None, n: int) -> np.ndarray:
    """Which of ``n`` words stand in the spans (first, last, first, last ...)."""
    steps = np.zeros(n + 1, np.int64)
    if runs is not None and len(runs):
        at = np.asarray(runs, np.int64)
        np.add.at(steps, at[0::2], 1)
        np.add.at(steps, at[1::2] + 1, -1)
    return np.cumsum(steps[:n]) > 0


def _joined(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(row, text, spans)``: the columns but the text in one struct, so that none can clash with those of the join."""
    found = spans(docs, id_col, text_col)
    text = F.col(text_col).cast("string")
    left = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("mark"), F.struct(*(c for c in docs.columns if c != text_col)).alias("row"), text.alias("text"))
    return left.join(found, ["id", "mark"], "left").select("row", "text", "spans")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_removed, kept_sha256)`` of every document, kept words joined by one space.

    Null text has no words. A null id neither loses words nor takes them from others. Equal ids take nothing from each
    other, and rows that repeat one keep a row each. An empty table gives an empty table; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_pieces(batch.column(1)):
                rows = batch.slice(a, b - a)
                n, gone, sha = [], [], []
                for text, runs in zip(texts, rows.column(2).to_pylist()):
                    words = split(text)
                    off = cover(runs, len(words))
                    n.append(len(words))
                    gone.append(int(off.sum()))
                    sha.append(hashlib.sha256(b" ".join(words if not gone[-1] else [x for x, o in zip(words, off.tolist()) if not o])).hexdigest())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = _joined(docs.select(id_col, text_col), id_col, text_col).select(F.col("row")[id_col].alias("id"), "text", "spans")
    return rows.mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept_sha256 string")


def split(text: bytes) -> list[bytes]:
    """Words: runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return."""
    return text.split()  # for bytes these six are the white space


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with repeated words cut out of their texts; what stands between kept words stays as it is.

    Every row is kept, also one that loses all its words (its text is then empty). ``chars_col``, if it is a column, gets
    the new number of code points. Nulls, repeated and empty rows: as in ``digest``.
    """
    joined = _joined(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_pieces(batch.column(1)):
                own, runs = batch.slice(a, b - a), batch.column(2).slice(a, b - a).to_pylist()
                if any(runs):
                    text = pa.array([cut(t, r) if r else t for t, r in zip(texts, runs)], pa.binary()).cast(pa.string())
                    null = own.column(1).is_null()
                    text = pc.if_else(null, pa.scalar(None, pa.string()), text)
                else:
                    text = own.column(1)
                yield pa.RecordBatch.from_arrays([own.column(0), text], names=["row", "text"])

    cut_out = joined.mapInArrow(run, StructType([joined.schema["row"], joined.schema["text"]]))
    chars = {chars_col: F.length("text").cast(docs.schema[chars_col].dataType)} if chars_col in docs.columns else {}
    return cut_out.select(*((F.col("text") if c == text_col else chars.get(c, F.col("row")[c])).alias(c) for c in docs.columns))


def cut(text: bytes, runs: list[int]) -> bytes:
    """``text`` without the words of the spans and the white space behind each of them."""
    words = Words([text])
    off = cover(runs, len(words.start))
    if off.all():
        return b""
    ends = np.append(words.start[1:], len(text))
    keep = [text[: words.start[0]]] + [text[a:b] for a, b, o in zip(words.start.tolist(), ends.tolist(), off.tolist()) if not o]
    return b"".join(keep)
