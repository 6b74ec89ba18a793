"""Labelled rows for the classifiers: fold rule, bounded samples, and calibration by logistic regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.session import cut_lineage

FOLDS = 5
#: Folds for fitting and for calibration; fold 0 is held out.
FIT_FOLDS = (1, 2, 3)
CALIBRATION_FOLD = 4
#: Labelled ids up to which they go to the executors (9 bytes each) and texts stay where they are.
LOOKUP_IDS = 1 << 25


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5 (null id: fold 0)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS, F.lit(0))


def labelled_ids(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """``(id, label, fold)``, one row an id outside the held-out fold; ids with contradictory labels are left out."""
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    one = rows.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    return one.select("id", "label", fold(F.col("id")).alias("fold")).where("fold <> 0")


def sample_ids(ids: DataFrame, rows: int, seed: int = 7) -> DataFrame:
    """At most ``rows`` of the rows, the same ones every time (least hash of the id first)."""
    return ids.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(rows)


def with_texts(docs: DataFrame, fitting: list[tuple], checking: list[tuple], id_col: str, text_col: str) -> DataFrame:
    """``(label, fitting, text)`` of the documents of two bounded lists of (id, label), fetched in one scan and written to
    the checkpoint folder, so that neither use scans the corpus again."""
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, label int, fitting boolean"
    wanted = docs.sparkSession.createDataFrame([(*x, True) for x in fitting] + [(*x, False) for x in checking], schema)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return cut_lineage(rows.join(F.broadcast(wanted), "id").select("label", "fitting", "text"))


def labelled_texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(label, text)`` of all documents of ``(id, label)``, different ids of the type of ``id_col``, without a shuffle of
    the texts.

    Ids are looked up by their 64-bit hash, which no two whole numbers share. More than ``LOOKUP_IDS`` are joined instead,
    which shuffles texts.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    hashed = ids.select(F.xxhash64("id").alias("key"), "label")
    if hashed.limit(LOOKUP_IDS + 1).count() > LOOKUP_IDS:
        return rows.join(ids.select("id", "label"), "id").select("label", "text")
    table = hashed.select("key", F.col("label").cast("byte").alias("label")).toArrow()
    keys, label = table.column("key").to_numpy(), table.column("label").to_numpy()
    order = np.argsort(keys)
    shared = docs.sparkSession.sparkContext.broadcast((keys[order], label[order].astype(np.int32)))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of = shared.value
        for batch in batches:
            asked = batch.column(0).to_numpy()
            at = np.minimum(np.searchsorted(known, asked), max(len(known) - 1, 0))
            found = np.flatnonzero(known[at] == asked) if len(known) else at[:0]
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(of[at[found]]), batch.column(1).take(pa.array(found))], names=["label", "text"])

    return rows.select(F.xxhash64("id"), "text").mapInArrow(pick, "label int, text string")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression on standardised columns, as (mean, scale, weights) rows.

    The result has one row a column plus one for the intercept. Without both classes the intercept is the log odds of
    half a row of the missing class.
    """
    n, k = x.shape if len(x) else (0, x.shape[1])
    mean = x.mean(axis=0) if n else np.zeros(k)
    scale = np.where((s := x.std(axis=0)) > 1e-12, s, 1.0) if n else np.ones(k)
    z = np.column_stack(((x - mean) / scale, np.ones(n))) if n else np.zeros((0, k + 1))
    w = np.zeros(k + 1)
    w[-1] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    if n and 0 < y.sum() < n:
        penalty = np.r_[np.full(k, ridge), 0.0]
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
            w = w + np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-6:
                break
    return np.column_stack((np.r_[mean, 0.0], np.r_[scale, 1.0], w))


def predict(model: np.ndarray, x: np.ndarray) -> np.ndarray:
    z = (x - model[:-1, 0]) / model[:-1, 1]
    return 1 / (1 + np.exp(-np.clip(z @ model[:-1, 2] + model[-1, 2], -35, 35)))
