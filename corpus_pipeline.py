"""The corpus pipeline: language ID, SimHash near-dedup, benchmark decontamination, secret scans, byte-level BPE.

Every stage works on all rows that the stage before it kept; the last one returns the token digests.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramian.llm import bpe, decontaminate, langid, secrets, simhash

#: Two texts are near-duplicates if the similarity of their five-word shingles is so much or more.
SHINGLE_WORDS, SIMILARITY = 5, 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter in them stay; the network learns from the labelled ones among ``docs``.  Where none is labelled there
    is no language to tell, and those with a letter stay too."""
    network = langid.fit(docs)
    if network is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.annotate(docs, network)
    return found.where(F.col("lang_pred") != langid.UNDETERMINED).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id."""
    return simhash.keep_first_similar(docs, words=SHINGLE_WORDS, similarity=SIMILARITY)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    items = decontaminate.fit(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontaminate.clean(docs, items)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and n_chars follows; all documents stay."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("secret scans", redact_secrets),
    ("byte-level BPE", tokenise),
]

#: No SQL expresses these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
