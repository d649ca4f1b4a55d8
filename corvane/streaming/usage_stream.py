"""Usage metrics and keyed storage over streams of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.sources.keyed_table import KeyedTable


def event_stream(spark: SparkSession, folder: str, pattern: str, schema) -> DataFrame:
    """New Parquet files of a folder that fit the pattern."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def daily_metrics(events: DataFrame, time: str = "ts", late: str = "1 day") -> DataFrame:
    """Counts by day and type; rows later than the watermark are dropped in append mode."""
    return (
        events.withColumn("_t", F.col(time).cast("timestamp"))
        .withWatermark("_t", late)
        .groupBy(F.window("_t", "1 day").alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))
    )


def running_metrics(events: DataFrame, unanswered: Column, confidence: Column, latency_ms: Column, time: str = "ts", late: str = "1 day") -> DataFrame:
    """The four running metrics by day, as usage.snapshot() has them, for update mode: each batch gives the days that it changed, with their new totals.

    The state holds counts and sums of each day, combined within tasks before they meet it. A row that is more than `late` behind the latest one of the batches
    before is dropped, as its day's state is gone; its day stays as it was. Rows without a time are of no day and dropped, too.
    """
    rows = events.select(F.col(time).cast("timestamp").alias("_t"), unanswered.alias("_missed"), confidence.alias("_confidence"), latency_ms.alias("_latency"))
    by = rows.where("_t is not null").withWatermark("_t", late).groupBy(F.window("_t", "1 day").alias("w"))
    mean = lambda c, n: F.round(F.coalesce(F.avg(c), F.lit(0.0)), n)
    return by.agg(
        F.count(F.lit(1)).alias("total_questions"),
        F.coalesce(F.sum(F.col("_missed").cast("long")), F.lit(0)).alias("unanswered_questions"),
        mean("_confidence", 4).alias("average_confidence"),
        mean("_latency", 2).alias("average_latency_ms"),
    ).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "total_questions", "unanswered_questions", "average_confidence", "average_latency_ms")


def keep_metrics(metrics: DataFrame, path: str, checkpoint: str, parts: int = 4) -> None:
    """Keeps running_metrics() of all files that are there in a table by day; a batch that comes again changes nothing, and the checkpoint says where to go on."""

    def merge(batch: DataFrame, number: int) -> None:
        table = KeyedTable(batch.sparkSession, path, parts)
        table.merge(batch.withColumn("version", F.lit(number).cast("long")), "day", "version", batch=(checkpoint, number))
        table.expire(3)

    metrics.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain(stream: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over all files that are there and returns its result table."""
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query: StreamingQuery = writer.start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def upsert_stream(stream: DataFrame, path: str, key: str, order: str, checkpoint: str) -> None:
    """Each batch of files is merged into the table by key; a batch that is repeated changes nothing."""
    from corvane.sources.sinks import upsert_table

    def merge(batch: DataFrame, number: int) -> None:
        upsert_table(batch.sparkSession, path, batch, key, order, f"{checkpoint} {number}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def embed_stream(stream: DataFrame, path: str, key: str, order: str, text: str, embedder: Callable[[list[str]], list[list[float]]], dimension: int, checkpoint: str) -> None:
    """New chunks get their `embedding` and are merged into the table by key, batch by batch; the checkpoint says where to go on."""
    from corvane.operators.vector import embed
    from corvane.runtime import cut
    from corvane.sources.sinks import upsert_table

    def merge(batch: DataFrame, number: int) -> None:
        # stored, as the merge reads its rows more than once
        made = cut(embed(batch, F.col(text), embedder, dimension))
        upsert_table(batch.sparkSession, path, made, key, order, f"{checkpoint} {number}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
