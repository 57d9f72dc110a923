"""Corpus cleaning in five stages: toxicity, near duplicates, decontamination, surrogates, pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from etaforge.llm import pii, superminhash, tiling, toxicity, viterbi
from etaforge.llm.queries import tokenizer_file
from etaforge.session import write_through

#: Documents are near copies from this share of common runs of five words on.
NEAR_PERCENT = 80
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is not among the ids; rows of a null id stay."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier does not reject, whatever their id. It is trained on labelled rows of these documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = toxicity.score(docs, toxicity.fit(docs, labels), COLUMNS)
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group; of repeated rows of one id all stay."""
    found = superminhash.near_components(docs, least=NEAR_PERCENT)
    return without(docs, found.where("not kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whole, partly or reordered."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = tiling.contamination(docs, benchmark, keep=("doc_id", "lang", "source", "n_chars"))
    return found.where("not contaminated").select(*COLUMNS)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in the text; n_chars follows the new text."""
    out = pii.replace_pii(docs.select(*COLUMNS))
    n = F.when(F.col("n_pii") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n).select(*COLUMNS)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their piece ids; a text that the ids do not give back raises."""
    made = viterbi.encode(docs, tokenizer_file("piece_bpe_32k.model"), COLUMNS)
    same = F.col("decoded").eqNullSafe(F.col("text"))
    checked = F.when(same, F.col("ids")).otherwise(F.raise_error(F.lit("decoding does not give back the text")).cast("array<int>"))
    return made.select(*COLUMNS, checked.alias("ids"), F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("pieces", to_pieces),
]

#: A trained classifier and a Viterbi search have no SQL form. The operators have tests; run() has none of its own yet.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_through(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
