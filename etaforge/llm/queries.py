"""The dealt operators as registered queries, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import importance, langid, phrases, pii, rankqueue, records, shards, spelling, superminhash, tiling, toxicity, viterbi
from .common import table
from .statements import STATEMENTS  # noqa: F401


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    files = records.write_records(docs, tokenizer_file("byte_bpe_50k.json"))
    return records.read_records(files).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return langid.predict(docs, langid.learn(docs))


def op3_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return tiling.contamination(docs, table(spark, sf_dir, "benchmark", "item_id", "text")).drop("text")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))


def op5_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    made = viterbi.encode(docs, tokenizer_file("piece_bpe_32k.model"), ("doc_id", "text"))
    return made.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.crc32(F.array_join("ids", ",").cast("binary")).alias("ids_crc32"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return pii.replace_pii(docs)


def op7_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.edited_fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_components(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return viterbi.token_counts(docs, tokenizer_file("piece_bpe_32k.model"))


def op10_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.byte_shards(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return importance.resample(docs, table(spark, sf_dir, "benchmark", "text"))


def op12_rank_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    with open(tokenizer_file("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        made = rankqueue.encode(docs, f.read(), public_tokenizers.PATTERN)
    return made.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {
    "op1_token_records": op1_token_records,
    "op2_language_filters": op2_language_filters,
    "op3_string_tiling": op3_string_tiling,
    "op4_toxicity": op4_toxicity,
    "op5_streaming_viterbi": op5_streaming_viterbi,
    "op6_surrogates": op6_surrogates,
    "op7_phrase_fingerprints": op7_phrase_fingerprints,
    "op8_superminhash": op8_superminhash,
    "op9_trie_token_counts": op9_trie_token_counts,
    "op10_byte_shards": op10_byte_shards,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_rank_queue": op12_rank_queue,
    "op13_spelling_variants": op13_spelling_variants,
}
