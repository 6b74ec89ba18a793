"""Toxicity by two class-conditional Kneser-Ney models, of toxic and of ordinary text.

A word has a continuation count in each class: the number of different words it follows there, so that copies and near
copies of a text add nothing. Counts are discounted, and what that takes away goes to the word's share in the whole
corpus (the texts that hold it), which both classes back off to:

    P(word | class) = max(count - DISCOUNT, 0) / total + rest(class) * share(word)

Expressions too rare in a class are thus judged by the shared counts alone, which cancel out between the classes. A text
is compared by its length-normalised log-likelihood ratio, toxic to ordinary, over the words on which the classes clearly
differ, and over its most toxic run of a few words; a logistic regression turns the two into a probability.

The order above, of whole bigrams, is left out: on folds 1 to 4 of sf0.1 it lowers the AUC of the first ratio from 0.976
to 0.64 to 0.79 (counts of texts or of contexts, full interpolation), as bigrams repeat with near copies of their texts.

Words are runs of bytes without ASCII punctuation or space, with A-Z lowered, kept as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.labelled import CALIBRATION_FOLD, FIT_FOLDS, fit_logistic, fold, labelled_ids, labelled_texts, predict
from waymark.llm.textbytes import IS_PUNCTUATION, Words, pieces, text_pieces
from waymark.session import cut_lineage

#: Contexts that a task holds before it hands them on, or before it looks for repeated ones again.
HELD = 1 << 20
#: Chosen on folds 1 to 4 of sf0.1 and sf0.01, each held out from the others in turn: what is taken from each count, the
#: size of a log ratio from which on the classes clearly differ on a word, and the words in a run.
DISCOUNT = 2.5
CLEAR = 1.5
RUN = 4
FEATURES = 2
#: Parts of one that ratios are added up in.
UNIT = 1 << 32


def _tokens(texts: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words, their hashes and the hashes of the words before them (0 at the start of a text)."""
    w = Words(texts, lower=True, separator=IS_PUNCTUATION)
    h = w.hashes()
    before = np.concatenate((np.zeros(1, h.dtype), h[:-1])) if len(h) else h.copy()
    before[w.first[:-1][w.count > 0]] = 0
    return w, h, before


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted value in sorted keys; ``len(keys)`` where it is missing."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, len(keys))


@dataclass(frozen=True)
class ToxicityModel:
    """Sorted hashes of the words whose count in a class is above the discount, with their discounted probabilities
    (columns ordinary, toxic) and shares in the corpus; all other words are ``rest`` times their shares.

    There are at most as many words as the labelled texts hold contexts, divided by the discount.
    """

    words: np.ndarray
    discounted: np.ndarray
    share: np.ndarray
    rest: np.ndarray
    calibration: np.ndarray

    @cached_property
    def log_ratio(self) -> np.ndarray:
        """Toxic to ordinary, of each of ``words`` and (last) of any other word."""
        p = np.concatenate((self.discounted + self.rest * self.share[:, None], self.rest[None, :]))
        return np.log(p[:, 1] / p[:, 0])

    def ratios(self, texts: list[bytes]) -> tuple[Words, np.ndarray]:
        """Log-likelihood ratio, toxic to ordinary, of each word."""
        w, h, _ = _tokens(texts)
        return w, self.log_ratio[_find(self.words, h)]

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Of each text: the sum of its clear ratios over its number of words, and the mean ratio of its most toxic run."""
        out = np.zeros((len(texts), FEATURES))
        for a, b in pieces(texts):
            w, r = self.ratios(texts[a:b])
            if not len(r):
                continue
            # whole numbers, so that a text has the same sums wherever it stands
            clear = np.rint(np.where(np.abs(r) >= CLEAR, r, 0.0) * UNIT).astype(np.int64)
            r = np.rint(r * UNIT).astype(np.int64)
            full = np.flatnonzero(w.count)
            first, n = w.first[:-1][full], w.count[full]
            sums = np.concatenate(([0], np.cumsum(r)))
            begin = np.arange(len(r))
            end = np.minimum(begin + RUN, np.repeat(w.first[1:], w.count))
            out[a + full, 0] = np.add.reduceat(clear, first) / UNIT / n
            out[a + full, 1] = np.maximum.reduceat(sums[end] - sums[begin], first) / (RUN * UNIT)
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        return predict(self.calibration, self.features(texts))


def _column(table: pa.Table, name: str, kind: type = np.float64) -> np.ndarray:
    return table.column(name).to_numpy().astype(kind)


def _distinct(label: np.ndarray, word: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different contexts, sorted by label and word."""
    order = np.lexsort((before, word, label))
    label, word, before = label[order], word[order], before[order]
    fresh = np.ones(len(word), bool)
    fresh[1:] = (before[1:] != before[:-1]) | (word[1:] != word[:-1]) | (label[1:] != label[:-1])
    return label[fresh], word[fresh], before[fresh]


def _merged(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _distinct(*(np.concatenate(x) for x in zip(*held))) if held else (np.zeros(0, np.int8), np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _first_of_words(label: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Where the contexts of each word in a class begin."""
    return np.flatnonzero(np.concatenate((np.ones(min(len(word), 1), bool), (word[1:] != word[:-1]) | (label[1:] != label[:-1]))))


def continuation_counts(texts: DataFrame) -> DataFrame:
    """``(word, n0, n1)`` of texts ``(label, text)``: how many different words each word follows in either class.

    A task lists the different words before each of its words in one row, and the rows of a word meet in one task, which
    drops repeated ones as it reads: a task holds the different contexts of its words, at most twice.
    """
    most = HELD

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def listed() -> pa.RecordBatch:
            label, word, before = _merged(held)
            first = _first_of_words(label, word)
            ends = pa.py_buffer((np.append(first, len(word)) * 8).astype(np.int32))
            lists = pa.Array.from_buffers(pa.binary(), len(first), [None, ends, pa.py_buffer(before)])
            return pa.RecordBatch.from_arrays([pa.array(word[first].view(np.int64)), pa.array(label[first].astype(np.int32)), lists], names=["word", "label", "before"])

        held: list[tuple] = []
        for batch in batches:
            label = batch.column(0).to_numpy().astype(np.int8)
            for a, b, own in text_pieces(batch.column(1)):
                w, h, before = _tokens(own)
                held.append(_distinct(label[a:b][w.doc], h, before))
                if sum(len(x[1]) for x in held) >= most:
                    yield listed()
                    held.clear()
        if held:
            yield listed()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, known = [], 0, 0
        for batch in batches:
            n = pc.binary_length(batch.column(2)).to_numpy() // 8
            before = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64)
            held.append((np.repeat(batch.column(1).to_numpy().astype(np.int8), n), np.repeat(batch.column(0).to_numpy().view(np.uint64), n), before))
            waiting += len(before)
            if waiting > most + known:
                held = [_merged(held)]
                waiting, known = 0, len(held[0][1])
        label, word, _ = _merged(held)
        first = _first_of_words(label, word)
        n = np.diff(np.append(first, len(word)))
        words, at = np.unique(word[first], return_inverse=True)
        out = np.zeros((2, len(words)), np.int64)
        out[label[first], at] = n
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(out[0]), pa.array(out[1])], names=["word", "n0", "n1"])

    lists = texts.select("label", "text").where("text is not null").mapInArrow(contexts, "word long, label int, before binary")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lists.repartition(parts, "word").mapInArrow(count, "word long, n0 long, n1 long")


def shared_counts(texts: DataFrame) -> DataFrame:
    """``(word, texts)``: how many texts of the whole corpus hold each word; a table as large as its vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, own in text_pieces(batch.column(0), 1 << 22):
                w, h, _ = _tokens(own)
                order = np.lexsort((h, w.doc))
                h, doc = h[order], w.doc[order]
                fresh = np.ones(len(h), bool)
                fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                word, n = np.unique(h[fresh], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "texts"])

    return texts.mapInArrow(count, "word long, texts long").groupBy("word").agg(F.sum("texts").alias("texts"))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Fit on all labelled rows outside the held-out fold (equal contexts of a class count once); the shared counts are
    those of all rows of ``docs``. The features of the rows that calibrate come to the driver, 20 bytes each."""
    ids = cut_lineage(labelled_ids(labels.withColumn(id_col, F.col(id_col).cast(docs.schema[id_col].dataType)), label_col, id_col))
    of_folds = lambda *folds: labelled_texts(docs.where(fold(F.col(id_col)).isin(*folds)), ids.where(F.col("fold").isin(*folds)), id_col, text_col)
    # words that are nowhere above the discount have the probability of an unseen one: one row stands for all of them
    above = (F.col("n0") > DISCOUNT) | (F.col("n1") > DISCOUNT)
    cut = lambda k: F.least(F.col(f"n{k}").cast("double"), F.lit(DISCOUNT))
    found = continuation_counts(of_folds(*FIT_FOLDS)).groupBy(F.when(above, F.col("word")).alias("word"))
    counts = cut_lineage(found.agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in (0, 1)), *(F.sum(cut(k)).alias(f"cut{k}") for k in (0, 1))))
    sums = counts.agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "cut0", "cut1"))).first()
    total = np.array([sums["n0"] or 0, sums["n1"] or 0], np.float64)
    # a class without texts backs off altogether
    rest = np.where(total > 0, np.array([sums["cut0"] or 0, sums["cut1"] or 0], np.float64) / np.maximum(total, 1), 1.0)
    known = counts.where("word is not null").select("word", "n0", "n1")
    shares = shared_counts(docs.select(F.col(text_col).cast("string"))).join(known, "word", "left")
    shares = shares.groupBy(F.when(F.col("n0").isNotNull(), F.col("word")).alias("word")).agg(F.sum("texts").alias("texts"), F.max("n0").alias("n0"), F.max("n1").alias("n1"))
    shares = cut_lineage(shares)
    all_texts = shares.agg(F.sum("texts")).first()[0] or 1
    kept = shares.where("word is not null").toArrow()
    words = _column(kept, "word", np.int64).view(np.uint64)
    order = np.argsort(words)
    n = np.column_stack([_column(kept, f"n{k}") for k in (0, 1)])[order]
    discounted = np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1)
    model = ToxicityModel(words[order], discounted, _column(kept, "texts")[order] / all_texts, rest, np.zeros((0, 3)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([np.zeros((0, FEATURES)), *(shared.value.features(t) for _, _, t in text_pieces(batch.column(1)))])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, i]) for i in range(FEATURES))], names=["label", *names])

    names = [f"x{i}" for i in range(FEATURES)]
    rows = of_folds(CALIBRATION_FOLD).mapInArrow(measure, "label int, " + ", ".join(f"{x} double" for x in names)).toPandas().sort_values([*names, "label"])
    calibration = fit_logistic(rows[names].to_numpy(np.float64), rows["label"].to_numpy(np.float64), ridge=0.5)
    return ToxicityModel(model.words, model.discounted, model.share, model.rest, calibration)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` of every whole text, without a shuffle (score 0..1, higher: toxic likelier).

    Null and empty texts get the score of a text without words; repeated rows keep a row each; an empty table gives an
    empty table; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the vocabulary above the discount

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.score(t) for _, _, t in text_pieces(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0), *found]))], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, label_col: str = "toxic") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every document; the labels are learnt outside the held-out fold.

    Null and empty texts get the score of a text without words. A null id counts as held out. Labels that are null, not 0
    or 1, or contradict each other are left out; without labels of both classes all scores are equal. Repeated rows keep a
    row each; an empty table gives an empty table; other columns are not read.
    """
    found = score(docs, fit(docs, labels, label_col))
    return found.select(
        F.col("id").alias("doc_id"), (fold(F.col("id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
