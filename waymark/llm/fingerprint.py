"""Document fingerprints: quartile digests of hashed byte triplets, compared by a bounded difference score.

A digest has 256 buckets. Each byte of a text starts one triplet (the bytes 0, 3 and 7 places on; behind the end
stand zeros), whose hash names a bucket. A bucket is encoded in two bits by the quartile of its count among the 256
of the text; a header holds a length code and a checksum. Layout, in hex: 2 digits length code, 2 digits checksum,
128 digits of bucket codes. Spread triplets tell texts of one language apart much better than adjacent bytes do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.textbytes import pieces, text_pieces

BUCKETS = 256
SPREAD = (3, 7)
#: Cost of two quartile codes that differ by 0, 1, 2 and 3.
STEP_COST = np.array([0, 1, 2, 6], np.int64)
#: Difference that counts as no likeness at all: two points a bucket.
FULL = 2 * BUCKETS
#: Most ranges that neighbours() cuts the ids into; heads of ranges are broadcast, so this bounds that table.
MAX_RANGES = 32_768


def _checksums(texts: list[bytes]) -> np.ndarray:
    return np.array([hashlib.blake2b(t, digest_size=1).digest()[0] for t in texts], np.uint8)


def digests(texts: list[bytes]) -> np.ndarray:
    """Digest of each text, a row of 66 bytes: length code, checksum, bucket codes (four to a byte)."""
    out = np.zeros((len(texts), 2 + BUCKETS // 4), np.uint8)
    for a, b in pieces(texts):
        own = texts[a:b]
        gap = bytes(SPREAD[1])
        buf = np.frombuffer(gap.join(own) + gap, np.uint8).astype(np.uint32)
        n = np.array([len(t) for t in own])
        at = np.arange(n.sum()) + np.repeat(np.arange(len(own)) * SPREAD[1], n)
        h = buf[at] | (buf[at + SPREAD[0]] << np.uint32(8)) | (buf[at + SPREAD[1]] << np.uint32(16))
        h *= np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        key = np.repeat(np.arange(len(own)) * BUCKETS, n) + (h >> np.uint32(24))
        counts = np.bincount(key, minlength=len(own) * BUCKETS).reshape(len(own), BUCKETS)
        ranked = np.sort(counts, axis=1)
        codes = sum((counts > ranked[:, BUCKETS * k // 4 - 1, None]).astype(np.uint8) for k in (1, 2, 3))
        out[a:b, 2:] = codes[:, 0::4] | codes[:, 1::4] << 2 | codes[:, 2::4] << 4 | codes[:, 3::4] << 6
        out[a:b, 0] = np.minimum(255, np.round(8 * np.log2(1 + n)))
        out[a:b, 1] = _checksums(own)
    return out


def _codes(d: np.ndarray) -> np.ndarray:
    return np.stack([d[:, 2:] >> s & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(d), -1).astype(np.int64)


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """1 for equal digests, falling to 0 at a difference of ``FULL`` points or more.

    Points: ``STEP_COST`` for each bucket, the difference of the length codes (eight to a doubling), and one if only
    the checksums differ.
    """
    cost = STEP_COST[np.abs(_codes(x) - _codes(y))].sum(axis=1)
    cost += np.abs(x[:, 0].astype(np.int64) - y[:, 0])
    cost += (cost == 0) & (x[:, 1] != y[:, 1])
    return 1.0 - np.minimum(cost, FULL) / FULL


def hex_digests(d: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in d]


def from_hex(fingerprints: list[str]) -> np.ndarray:
    return np.array([list(bytes.fromhex(x)) for x in fingerprints], np.uint8).reshape(len(fingerprints), -1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint)`` of every row, without a shuffle. Null and empty texts share one fingerprint; equal texts
    have equal fingerprints; repeated rows keep a row each; an empty table gives an empty table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for _, _, t in text_pieces(batch.column(1)) for x in hex_digests(digests(t))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, fingerprint string")


def _ranges(docs: DataFrame, wanted: int) -> list[int]:
    """Ids that cut the table into about ``wanted`` ranges of equally many rows."""
    share = [i / wanted for i in range(1, wanted)]
    found = docs.where("id is not null").approxQuantile("id", share, 0.2 / wanted) if share else []
    return sorted({int(x) for x in found})


def _range_of(cuts: list[int]) -> str:
    """SQL of the number of cuts at or below ``id`` by binary search (a null id is below all)."""
    if not cuts:
        return "0"
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    literal = "array(" + ",".join(f"{x}L" for x in cuts) + ")"
    return (
        f"if(id is null, 0, aggregate(array({','.join(map(str, steps))}), 0, (p, s) -> "
        f"if(p + s <= {len(cuts)}, if(try_element_at({literal}, p + s) <= id, p + s, p), p)))"
    )


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(part, tail, id, text)`` dealt out so that each row with ``tail`` false is followed, in the order of its
    partition, by the next document in descending id (the first, after the last).

    One shuffle of the texts: the ids are cut into ranges of about equal row counts, and the first row of each range is
    sent a second time, as the tail of the range before it. Equal ids are ordered by text; null ids come last.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    wanted = min(MAX_RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = rows.select("id")
    part = F.expr(_range_of(_ranges(ids, wanted)))
    heads = sorted((r["part"], r["head"]) for r in ids.select(part.alias("part"), "id").groupBy("part").agg(F.max("id").alias("head")).collect())
    # at most MAX_RANGES rows: the head of each range, and the range that comes before it
    before = [x[0] for x in heads[1:]] + [x[0] for x in heads[:1]]
    table = spark.createDataFrame([(p, h, b) for (p, h), b in zip(heads, before)], "part int, head long, before int")
    placed = rows.withColumn("part", part).join(F.broadcast(table), "part")
    once = F.struct(F.col("part").alias("part"), F.lit(False).alias("tail"))
    again = F.struct(F.col("before").alias("part"), F.lit(True).alias("tail"))
    copies = F.when(F.col("id").eqNullSafe(F.col("head")), F.array(once, again)).otherwise(F.array(once))
    return (
        placed.select(F.explode(copies).alias("to"), "id", "text")
        .select("to.part", "to.tail", "id", "text")
        .repartition("part")
        .sortWithinPartitions("part", "tail", F.desc_nulls_last("id"), "text")
    )


def edit(text: str, following: str) -> str:
    """``text`` with its last third replaced by the start of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited text, and their likeness, one row a document.

    Columns: id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Null text is empty; of rows with equal ids the lesser text comes first; a table of one row is its own next; an
    empty table gives an empty table. Texts are whole, whatever their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple | None = None  # the last row so far, whose next is still to come
        for batch in batches:
            every_id, every_tail = batch.column("id").to_pylist(), batch.column("tail").to_pylist()
            for a, b, texts in text_pieces(batch.column("text")):
                ids, tails = every_id[a:b], every_tail[a:b]
                if kept:
                    texts, ids, tails = [kept[0], *texts], [kept[1], *ids], [kept[2], *tails]
                kept = (texts[-1], ids[-1], tails[-1])
                at = [i for i in range(len(texts) - 1) if not tails[i]]
                if not at:
                    continue
                decoded = [t.decode("utf-8", "surrogateescape") for t in texts]
                edited = [edit(decoded[i], decoded[i + 1]).encode("utf-8", "surrogateescape") for i in at]
                own, new, here = digests(texts), digests(edited), np.array(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i] for i in at], pa.int64()),
                        pa.array([len(decoded[i]) for i in at], pa.int64()),
                        pa.array([hashlib.sha256(t).hexdigest() for t in edited]),
                        pa.array(hex_digests(own[here])),
                        pa.array(hex_digests(new)),
                        pa.array(likeness(own[here], new)),
                        pa.array(likeness(own[here], own[here + 1])),
                    ],
                    names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return neighbours(docs, id_col, text_col).mapInArrow(
        run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
