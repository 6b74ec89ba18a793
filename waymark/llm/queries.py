"""The registered queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import ann, chat, fingerprint, mixing, quality, sentencepieces, simhash, substrings, toxicity, urls
from waymark.session import bound_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors found for every vector whose id is divisible by 100."""
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op2_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    return fingerprint.compare_with_next(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source and place in the mixture (slot and place order it) of every document."""
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source")).select("doc_id", "source", "mix.*")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict and the margin of the trees of every page."""
    return urls.judge(_table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return substrings.digest(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation and of conversation -7, read back from their formatted text."""
    extra = "values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(rows.unionByName(spark.sql(f"select * from {extra}")))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op9_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids of every document, and whether decoding the ids gives its text back."""
    return sentencepieces.round_trip(_table(spark, sf_dir, "documents"), sentencepieces.model_bytes(model or default_model()))


def default_model() -> str:
    """Path of the public 32k piece vocabulary."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_learned_partitions": op1_learned_partitions,
    "op2_kneser_ney_toxicity": op2_kneser_ney_toxicity,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_pfair_mixing": op4_pfair_mixing,
    "op5_url_filter": op5_url_filter,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_chat_format": op7_chat_format,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_compression_quality": op9_compression_quality,
    "op10_sentencepiece": op10_sentencepiece,
}

ORACLE_SQL: dict[str, str] = {
    "op4_pfair_mixing": mixing.oracle(),
    "op6_substring_dedup": f"""
with d as (select row_number() over () as row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
w as (select row, doc_id, s, array_to_string(ws[s:s + {substrings.WINDOW - 1}], ' ') as t from d, unnest(range(1, len(ws) - {substrings.WINDOW - 2})) as u(s)),
low as (select t, min(doc_id) as low from w group by t),
gone as (select distinct row, s + o as p from w join low on w.t = low.t, range(0, {substrings.WINDOW}) as r(o) where low < doc_id),
words as (select row, doc_id, p, ws[p] as word from d, unnest(range(1, len(ws) + 1)) as u(p)),
kept as (select words.row, count(*) as n, string_agg(word, ' ' order by words.p) as text from words left join gone on words.row = gone.row and words.p = gone.p where gone.p is null group by words.row)
select doc_id, len(ws) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join kept on d.row = kept.row
""",
    "op7_chat_format": chat.oracle(),
}
