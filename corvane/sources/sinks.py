"""Writers of the engine's outputs. Each replaces what was there as one commit."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from corvane.functions import urls as U
from corvane.operators import state


def json_lines(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, in UTF-8."""
    df.write.mode("overwrite").json(path)


def documents(pages: DataFrame, path: str) -> None:
    json_lines(pages.select("url", "title", "language", "markdown", "last_modified", "content_hash"), path)


def pdfs(refs: DataFrame, path: str) -> None:
    """url and its language, each URL once."""
    json_lines(pdf_records(refs), path)


def pdf_records(refs: DataFrame) -> DataFrame:
    return refs.select("url").distinct().select("url", U.language(F.col("url")).alias("language"))


def errors(failed: DataFrame, path: str) -> None:
    """url and error of what could not be fetched."""
    json_lines(failed.select("url", "error"), path)


def crawl_state(pages: DataFrame, path: str) -> None:
    """The new state replaces the old: URLs that are gone vanish."""
    json_lines(pages.select("url", "content_hash"), path)


def save_index(chunks: DataFrame, table: str, path: str, dimension: int | None = None) -> None:
    """A table of chunks partitioned by language, so a filter on it reads its part only."""
    rows = chunks if dimension is None else state.checked_vectors(chunks, "embedding", dimension)
    rows.write.mode("overwrite").partitionBy("language").option("path", path).saveAsTable(table)


def _versions(spark: SparkSession, path: str, batch: str | None = None) -> Row | None:
    """The newest version; with a batch, the newest that was made of it."""
    try:
        rows = spark.read.schema("n long, at string, batch string").json(f"{path.rstrip('/')}/_versions")
        return (rows if batch is None else rows.where(F.col("batch") == batch)).orderBy(F.desc("n")).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def newest(spark: SparkSession, path: str) -> str | None:
    """The path of the newest version of the table under `path`; None before the first."""
    last = _versions(spark, path)
    return last["at"] if last else None


def upsert_table(spark: SparkSession, path: str, new: DataFrame, key: str, order: str, batch: str | None = None) -> str:
    """Merges rows into the newest version of the table under `path`, by key; returns the new version's path.

    A version is written whole beside the old ones, then named in the list of versions: a run that fails leaves the old one. For one writer
    and tables that are small; keyed_table.KeyedTable rewrites only what a merge touches.
    batch: a name of what is merged; if any version was made of the same one, the newest is returned as it is.
    """
    last = _versions(spark, path)
    if last and batch is not None and _versions(spark, path, batch):
        return last["at"]
    stamped = new.withColumn("updated_at", F.current_timestamp())
    rows = state.last_wins(stamped, key, order) if last is None else state.upsert(spark.read.parquet(last["at"]), stamped, key, order)
    at = f"{path.rstrip('/')}/v-{uuid.uuid4().hex}"
    rows.write.parquet(at)
    spark.createDataFrame([((last["n"] + 1) if last else 1, at, batch)], "n long, at string, batch string").coalesce(1).write.mode("append").json(f"{path.rstrip('/')}/_versions")
    return at
