"""Stages from raw documents to token ids; each takes (spark, docs, sf_dir) and keeps all it does not decide on.

All but the last return the columns of documents. A filtering stage drops only what it finds: texts of no language,
later copies of near-duplicates, documents whose bytes all repeat earlier ones, and documents with benchmark passages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import common, decontam, langid, piece_dropout, shingle_links, suffix_dedup

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: lang becomes what the text is found to be in; texts without a letter go."""
    found, (lang, _) = langid.identify(docs, langid.train(docs))
    kept = found.where(F.col(lang) != langid.UNKNOWN)
    return kept.withColumn("lang", F.col(lang)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup: of each component the document with the smallest id stays. SimHash links, and 5-word shingles at a Jaccard similarity of 0.8."""
    return shingle_links.representatives(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: repeated windows of 100 bytes leave the texts; texts of which nothing is left go."""
    kept = suffix_dedup.without_repeats(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a window of a benchmark item go."""
    found, (_, hit, _) = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.col(hit).isNull()).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids with merge-dropout, checked to decode to the text."""
    import public_tokenizers

    return piece_dropout.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("suffix_dedup", repeats),
    ("decontamination", benchmark),
    ("sentencepiece", pieces),
]

#: The stages learn models and cut bytes, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each one's rows stored and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            at = common.new_table(spark, name)
            docs.write.parquet(at)
            docs = spark.read.parquet(at)
    return docs
