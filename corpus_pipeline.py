"""A corpus pipeline of five stages, each one operator of ``rippleframe.llm`` over all that its predecessor kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleframe.llm import bpe, decontaminate, near_dedup, pii, quality
from rippleframe.llm._common import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The encoders' workers stay while other stages run: less is remembered than where tokens alone are made.
ENCODER_MEMORY = 96 << 20


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-likelihood ratio; a null or empty text fails."""
    trusted = quality.trusted_ids(table(spark, sf_dir, "labels"))
    return quality.judge_quality(docs.select(*COLUMNS), trusted).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates, that with the smallest id.

    Rows that share an id but not a text are documents of their own; of rows that share both, one stays; rows without an
    id are no one's copies and stay.
    """
    return near_dedup.drop_near_duplicates(docs.select(*COLUMNS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"), keep=tuple(COLUMNS))
    return found.where(F.size("matches") == 0).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates; n_chars follows the new text."""
    replaced = pii.replace_pii(docs.select(*COLUMNS), pii.OP1_KEY)
    return replaced.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' token ids and the digest of what they decode to (doc_id, lang, source, n_tokens, ids, decoded_sha256)."""
    encoded = bpe.encode_documents(docs, keep=("doc_id", "lang", "source"), decode="digest", memory=ENCODER_MEMORY)
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("byte_level_bpe", byte_level_bpe),
]

#: Hashed n-grams, MinHash groups and keyed surrogates have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
