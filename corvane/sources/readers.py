"""Readers of the engine's inputs: chunk records, pages, state and settings."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import lexicon as X
from corvane.functions import text as T

CHUNK = "url string, title string, section string, faculty string, language string, lastUpdated string, source string, content_hash string, text string"
PAGE = "url string, title string, language string, markdown string"


def _read(spark: SparkSession, path: str, schema: str, **options) -> DataFrame | None:
    """Rows, or None where there is nothing at path."""
    try:
        return spark.read.schema(schema).options(**options).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a Parquet table at path."""
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False
    return True


def chunks(spark: SparkSession, path: str, missing_ok: bool = True, title: str = "Untitled", language: str = "pl") -> DataFrame:
    """Valid chunk records of a JSON-lines file, with defaults for missing keys and `ord`, their order.

    `ord` is a struct of the file, the block's start and a number that grows within the block, so the order doesn't depend on how
    blocks are dealt to tasks.

    Blank lines are skipped, malformed lines fail the read, rows without text or URL go. A null counts as missing.
    Without a file there are no rows, or, unless missing_ok, an error.
    """
    rows = _read(spark, path, CHUNK, mode="FAILFAST")
    if rows is None:
        if not missing_ok:
            raise FileNotFoundError(path)
        rows = spark.createDataFrame([], CHUNK)
        at = [F.lit("").alias("file"), F.lit(0).cast("long").alias("start")]
    else:
        at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    return valid(rows.select("*", F.struct(*at, F.monotonically_increasing_id().alias("n")).alias("ord")), title, language)


def valid(rows: DataFrame, title: str = "Untitled", language: str = "pl") -> DataFrame:
    stripped = {c: T.strip(F.coalesce(F.col(c), F.lit(""))) for c in ("text", "url", "section", "faculty")}
    out = rows.withColumns(stripped).where((F.col("text") != "") & (F.col("url") != ""))
    return out.withColumns({"title": T.strip(F.coalesce("title", F.lit(title))), "language": T.casefold(F.coalesce("language", F.lit(language)))})


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of one JSON array."""
    return spark.read.schema(PAGE).option("multiLine", True).json(path)


def state(spark: SparkSession, path: str) -> DataFrame:
    """url, content_hash of the last run; no rows before the first."""
    rows = _read(spark, path, "url string, content_hash string")
    return spark.createDataFrame([], "url string, content_hash string") if rows is None else rows


def stored_count(spark: SparkSession, table: str) -> int | None:
    """Rows of a stored table; None where there is no such table."""
    return spark.table(table).count() if spark.catalog.tableExists(table) else None


@dataclass(frozen=True)
class Settings:
    """Limits of answering. Values that can't be read, and integers that aren't positive, give way to defaults."""

    top_k: int = X.TOP_K
    confidence_threshold: float = X.CONFIDENCE
    vector_similarity_threshold: float = X.SIMILARITY
    embedding_dimensions: int = 384
    embedding_provider: str = "hash"

    @classmethod
    def from_mapping(cls, values: Mapping[str, str] | None = None, prefix: str = "CORVANE_") -> Settings:
        values = os.environ if values is None else values

        def read(name: str, kind, default, ok=lambda v: True):
            try:
                v = kind(values.get(prefix + name, default))
            except ValueError:
                return default
            return v if ok(v) else default

        return cls(
            read("TOP_K", int, X.TOP_K, lambda v: v > 0),
            read("CONFIDENCE", float, X.CONFIDENCE),
            read("SIMILARITY", float, X.SIMILARITY),
            read("DIMENSIONS", int, 384, lambda v: v > 0),
            values.get(prefix + "EMBEDDINGS", "hash"),
        )
