"""Usage metrics over an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.runtime import cut


def snapshot(log: DataFrame, unanswered: Column, confidence: Column, latency_ms: Column, *by: str) -> DataFrame:
    """Counts and means; zeros without rows."""
    zero = lambda c, n: F.round(F.coalesce(F.avg(c), F.lit(0.0)), n)
    return log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_questions"),
        F.coalesce(F.sum(unanswered.cast("long")), F.lit(0)).cast("long").alias("unanswered_questions"),
        zero(confidence, 4).alias("average_confidence"),
        zero(latency_ms, 2).alias("average_latency_ms"),
    )


def kpis(shot: DataFrame, *by: str) -> DataFrame:
    """Answer rate in percent (0 without questions) and latency in seconds of snapshot()'s rows."""
    total, missed = F.col("total_questions"), F.col("unanswered_questions")
    rate = F.when(total > 0, F.round(100.0 * (total - missed) / total, 1)).otherwise(F.lit(0.0))
    return shot.select(*by, "total_questions", rate.alias("answer_rate"), F.round("average_confidence", 4).alias("retrieval"), F.round(F.col("average_latency_ms") / 1000, 3).alias("latency_s"))


def health(n_chunks: Column, generator: str, vector: bool) -> list[Column]:
    return [
        F.when(n_chunks > 0, "ready").otherwise("waiting_for_data").alias("status"),
        n_chunks.alias("chunks"),
        F.lit(generator != "local-extractive").alias("llm_enabled"),
        F.lit("hybrid-pgvector-bm25" if vector else "bm25").alias("retrieval_mode"),
    ]


def has_metrics(names: Column, required: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, required)), names)) == 0


def running_totals(log: DataFrame, time: str, key: str, unanswered: Column) -> DataFrame:
    """Cumulative counts in order of (time, key): within ranges of rows of like length, on top of the sums of the ranges before.

    The ranges are the parts of a sampled range partitioning, stored once; a busy hour or day is as many ranges as it takes.
    """
    rows = log.select(key, F.col(time).alias("_t"), unanswered.cast("long").alias("_u")).repartitionByRange("_t", key)
    rows = cut(rows.withColumn("_part", F.spark_partition_id()))
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.sum("_u").alias("_m"))
    up = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_m").over(up), F.lit(0)).alias("_m0"))
    own = W.partitionBy("_part").orderBy("_t", key).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(own)).withColumn("_m", F.sum("_u").over(own)).join(parts, "_part")
    return rows.select(key, (F.col("_n") + F.col("_n0")).alias("total_questions"), (F.col("_m") + F.col("_m0")).alias("unanswered_questions"))


def within_days(log: DataFrame, time: str, days: int) -> DataFrame:
    """Rows of the last days, counted back from the latest row."""
    latest = log.agg(F.max(time)).scalar()
    return log.where(F.col(time) >= latest - F.expr(f"INTERVAL {days} DAYS"))


def latency_ms(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1000.0


def validate_request(question: Column, language: Column, top_k: Column) -> Column:
    """What is wrong with a request; null where it is fine."""
    return (
        F.when(question.isNull() | (F.char_length(question) < 2) | (F.char_length(question) > 1000), "question must have 2 to 1000 characters")
        .when(F.char_length(language) > 30, "language must have up to 30 characters")
        .when((top_k < 1) | (top_k > 10), "top_k must be 1 to 10")
    )


# ---- loose payloads ----

SOURCE = "title string, url string"


def sources(raw: Column, default: str = "Verified source") -> Column:
    """A JSON text of one or several sources (texts or objects with varying names) as an array of (title, url)."""
    trimmed = T.strip(F.coalesce(raw, F.lit("")))
    listed = F.when(F.startswith(trimmed, F.lit("[")), trimmed).when(trimmed == "", F.lit("[]")).otherwise(F.concat(F.lit("["), trimmed, F.lit("]")))
    parts = F.coalesce(F.from_json(listed, "array<string>"), F.array().cast("array<string>"))

    def field(p: Column, *names: str) -> Column:
        return F.coalesce(*[F.nullif(F.get_json_object(p, f"$.{n}"), F.lit("")) for n in names])

    def one(p: Column) -> Column:
        is_object = F.startswith(T.strip(p), F.lit("{"))
        link = F.when(is_object, field(p, "url", "source_url", "link")).when(p.rlike("^https?://"), p)
        name = F.when(is_object, F.coalesce(field(p, "title", "name", "source"), F.lit(default))).otherwise(F.lit(default))
        return F.struct(name.alias("title"), link.alias("url"))

    return F.filter(F.transform(F.filter(parts, lambda p: p.isNotNull()), one), lambda s: s["url"].isNotNull())


def answer_of(payload: Column) -> Column:
    """The stripped answer of a JSON response under any of its names; null where it is blank."""
    got = [F.nullif(F.get_json_object(payload, f"$.{n}"), F.lit("")) for n in ("answer", "response", "message")]
    return F.nullif(T.strip(F.coalesce(*got)), F.lit(""))


def canned_reply(question: Column, language: Column, replies: dict[str, str], default: str) -> Column:
    """A test double's reply by the language's first letters; null without a question."""
    low = F.lower(F.coalesce(language, F.lit("English")))
    out = F.when(F.coalesce(T.strip(question), F.lit("")) == "", F.lit(None).cast("string"))
    for prefix, reply in replies.items():
        out = out.when(F.startswith(low, F.lit(prefix)), reply)
    return out.otherwise(default)
