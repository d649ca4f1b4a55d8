"""Queries on usage, requests and payloads, each with its SQL.

events stand for the log of questions (an error is an unanswered one, the user modulo 20 its source, value its latency
and, as value / (value + 2), its confidence), conversations for requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import usage
from corvane.runtime import new_table
from corvane.sources import keyed_table
from corvane.streaming import usage_stream

from . import oracle as O
from .search import docs

MISSED = "event_type = 'error'"


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def _missed() -> Column:
    return F.col("event_type") == "error"


def _shot(log: DataFrame, *by: str) -> DataFrame:
    return usage.snapshot(log, _missed(), T.confidence(F.col("value")), F.col("value"), *by)


def metrics_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return _shot(events(spark, d))


def kpis(spark: SparkSession, d: str) -> DataFrame:
    return usage.kpis(_shot(events(spark, d)))


def kpis_empty(spark: SparkSession, d: str) -> DataFrame:
    return usage.kpis(_shot(events(spark, d).where("event_type is null and event_id < 0")))


def daily_activity(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).groupBy(F.date_format("ts", "E").alias("day"))
    return rows.agg(F.count(F.lit(1)).alias("questions"), F.sum((~_missed()).cast("long")).alias("answered"))


def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy(F.col("event_type").alias("category")).agg(F.count(F.lit(1)).alias("questions"))


def unanswered_top(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).where(_missed()).groupBy("user_id").agg(F.count(F.lit(1)).alias("times_asked"), F.round(F.max(T.confidence(F.col("value"))), 4).alias("best_score"))
    return rows.orderBy(F.desc("times_asked"), "user_id").limit(10)


def source_performance(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("source", F.col("user_id") % 20)
    return rows.groupBy("source").agg(F.sum((F.col("event_type") == "click").cast("long")).alias("clicks"), F.round(F.avg(T.confidence(F.col("value"))), 4).alias("average_score"))


def period_metrics(spark: SparkSession, d: str) -> DataFrame:
    log = events(spark, d)
    parts = [usage.kpis(_shot(usage.within_days(log, "ts", n))).withColumn("days", F.lit(n).cast("long")) for n in (7, 30, 90)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def running_totals(spark: SparkSession, d: str) -> DataFrame:
    return usage.running_totals(events(spark, d), "ts", "event_id", _missed())


def latency(spark: SparkSession, d: str) -> DataFrame:
    end = F.col("ts") + F.expr("make_dt_interval(0, 0, 0, cast(value as decimal(18, 6)))")
    ms = usage.latency_ms(F.col("ts").cast("timestamp"), end.cast("timestamp"))
    return events(spark, d).select("event_id", F.round(ms, 2).alias("latency_ms"))


def health(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(*usage.health(F.col("n"), "local-extractive", True))


def metrics_schema(spark: SparkSession, d: str) -> DataFrame:
    names = F.json_object_keys(F.col("props"))
    return events(spark, d).select("event_id", usage.has_metrics(F.coalesce(names, F.array().cast("array<string>")), ["k"]).alias("complete"))


def conversations(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet")


def chat_activity(spark: SparkSession, d: str) -> DataFrame:
    return conversations(spark, d).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("conv_id").alias("conversations"), F.max("turn").alias("last_turn"))


def request_validation(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("conv_id") % 13
    problem = usage.validate_request(F.when(n == 3, F.lit("x")).when(n == 4, F.repeat(F.col("text"), 40)).otherwise(F.col("text")), F.when(n == 5, F.repeat(F.lit("ab"), 16)).otherwise("English"), F.when(n < 12, n.cast("int")))
    return conversations(spark, d).select("conv_id", "turn", problem.alias("problem"))


def settings_values(spark: SparkSession, d: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, ["7", "-3", "0", "x", "2.5", " 8 "])), (F.col("conv_id") % 6 + 1).cast("int"))
    return conversations(spark, d).select("conv_id", "turn", T.positive_int(F.trim(raw), 5).cast("long").alias("top_k"), T.float_value(F.trim(raw), 0.15).alias("threshold"), T.or_default((F.col("turn") % 3).cast("long"), 5).alias("or_default"))


_PAYLOADS = [
    '{"answer": " A ", "sources": ["https://a.example/x", "ftp://no", {"url": "", "link": "https://b.example", "name": "B"}]}',
    '{"response": "R", "source": {"source_url": "https://c.example", "title": ""}}',
    '{"message": "   "}',
    '{"answer": "", "message": "M", "sources": "http://d.example"}',
    '{"answer": "N", "sources": []}',
]


def payload_answers(spark: SparkSession, d: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, _PAYLOADS)), (F.col("conv_id") % len(_PAYLOADS) + 1).cast("int"))
    listed = F.coalesce(F.get_json_object(raw, "$.sources"), F.get_json_object(raw, "$.source"))
    found = usage.sources(F.when(F.startswith(listed, F.lit("http")), F.concat(F.lit('"'), listed, F.lit('"'))).otherwise(listed))
    text = F.array_join(F.transform(found, lambda s: F.concat(s["title"], F.lit("="), s["url"])), ";")
    answer = usage.answer_of(raw)
    return conversations(spark, d).select("conv_id", "turn", answer.alias("answer"), F.when(answer.isNotNull(), text).alias("sources"), answer.isNotNull().alias("success"))


REPLIES = {"tr": "Test cevabı.", "türk": "Test cevabı.", "pl": "Odpowiedź testowa.", "pol": "Odpowiedź testowa."}


def mock_routing(spark: SparkSession, d: str) -> DataFrame:
    language = F.element_at(F.array(*map(F.lit, ["Türkçe", "Polski", "pl", "English", "tr-TR", "русский"])), (F.col("conv_id") % 6 + 1).cast("int"))
    return conversations(spark, d).select("conv_id", "turn", usage.canned_reply(F.when(F.col("turn") > 0, F.col("text")), language, REPLIES, "Test response.").alias("reply"))


def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    from corvane.operators import vector

    title = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("")
    return docs(spark, d).select("doc_id", F.sha2(vector.embedding_text(title, F.col("lang"), F.lit(None).cast("string"), F.col("text")), 256).alias("text_sha256"))


def stream_metrics(spark: SparkSession, d: str) -> DataFrame:
    import uuid

    stream = usage_stream.event_stream(spark, d, "events.parquet", events(spark, d).schema)
    return usage_stream.drain(usage_stream.daily_metrics(stream), "usage_" + uuid.uuid4().hex)


def stream_running(spark: SparkSession, d: str) -> DataFrame:
    """The four running metrics of each day, kept by a stream in a table by day."""
    stream = usage_stream.event_stream(spark, d, "events.parquet", events(spark, d).schema)
    at = new_table(spark, "metrics")
    usage_stream.keep_metrics(usage_stream.running_metrics(stream, _missed(), T.confidence(F.col("value")), F.col("value")), f"{at}/table", f"{at}/checkpoint")
    return keyed_table.KeyedTable(spark, f"{at}/table").read().drop("version")


def keyed_merge(spark: SparkSession, d: str) -> DataFrame:
    """Each user's last event, kept in a table by key: the events come in three merges, the latest first, and one of them twice."""
    rows = events(spark, d).select("user_id", "event_id", "event_type", "value")
    table = keyed_table.KeyedTable(spark, new_table(spark, "users"), parts=16)
    for k in (2, 1, 0, 1):
        table.merge(rows.where(F.col("event_id") % 3 == k), "user_id", "event_id", batch=(f"part {k}", 0))
    return table.read()


QUERIES = {
    "keyed_merge": keyed_merge,
    "metrics_snapshot": metrics_snapshot, "kpis": kpis, "kpis_empty": kpis_empty, "daily_activity": daily_activity, "category_counts": category_counts, "unanswered_top": unanswered_top, "source_performance": source_performance,
    "period_metrics": period_metrics, "running_totals": running_totals, "latency": latency, "health": health, "metrics_schema": metrics_schema, "chat_activity": chat_activity,
    "request_validation": request_validation, "settings_values": settings_values, "payload_answers": payload_answers, "mock_routing": mock_routing, "embedding_text": embedding_text, "stream_metrics": stream_metrics, "stream_running": stream_running,
}

_CONF = O.confidence("value")
_SHOT = lambda where="TRUE": f"(SELECT count(*) AS total_questions, coalesce(sum(CASE WHEN {MISSED} THEN 1 ELSE 0 END), 0)::BIGINT AS unanswered_questions, round(coalesce(avg({_CONF}), 0), 4)::DOUBLE AS average_confidence, round(coalesce(avg(value), 0), 2)::DOUBLE AS average_latency_ms FROM events WHERE {where})"
_KPIS = lambda shot: f"SELECT total_questions, CASE WHEN total_questions > 0 THEN round(100.0::DOUBLE * (total_questions - unanswered_questions) / total_questions, 1) ELSE 0.0::DOUBLE END AS answer_rate, average_confidence AS retrieval, round(average_latency_ms / 1000, 3) AS latency_s FROM {shot}"
_PICK = lambda values, i: f"{O.array(values)}[{i} + 1]"
_ANSWERS = "['A', 'R', NULL, 'M', 'N']"
_SOURCES = "['Verified source=https://a.example/x;B=https://b.example', 'Verified source=https://c.example', NULL, 'Verified source=http://d.example', '']"

ORACLE = {
    "keyed_merge": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "metrics_snapshot": f"SELECT * FROM {_SHOT()}",
    "kpis": _KPIS(_SHOT()),
    "kpis_empty": _KPIS(_SHOT("FALSE")),
    "daily_activity": f"SELECT strftime(ts, '%a') AS day, count(*) AS questions, sum(CASE WHEN {MISSED} THEN 0 ELSE 1 END)::BIGINT AS answered FROM events GROUP BY 1",
    "category_counts": "SELECT event_type AS category, count(*) AS questions FROM events GROUP BY 1",
    "unanswered_top": f"SELECT user_id, count(*) AS times_asked, max({_CONF})::DOUBLE AS best_score FROM events WHERE {MISSED} GROUP BY user_id ORDER BY times_asked DESC, user_id LIMIT 10",
    "source_performance": f"SELECT user_id % 20 AS source, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS clicks, round(avg({_CONF}), 4)::DOUBLE AS average_score FROM events GROUP BY 1",
    "period_metrics": " UNION ALL ".join(f"SELECT *, {n}::BIGINT AS days FROM ({_KPIS(_SHOT(f'ts >= (SELECT max(ts) FROM events) - INTERVAL {n} DAY'))})" for n in (7, 30, 90)),
    "running_totals": f"SELECT event_id, count(*) OVER w AS total_questions, (sum(CASE WHEN {MISSED} THEN 1 ELSE 0 END) OVER w)::BIGINT AS unanswered_questions FROM events WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
    "latency": "SELECT event_id, round(value * 1000, 2) AS latency_ms FROM events",
    "health": "SELECT CASE WHEN count(*) > 0 THEN 'ready' ELSE 'waiting_for_data' END AS status, count(*) AS chunks, FALSE AS llm_enabled, 'hybrid-pgvector-bm25' AS retrieval_mode FROM documents",
    "metrics_schema": "SELECT event_id, coalesce(list_contains(json_keys(props), 'k'), FALSE) AS complete FROM events",
    "chat_activity": "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations, max(turn) AS last_turn FROM conversations GROUP BY role",
    "request_validation": "SELECT conv_id, turn, CASE WHEN length(q) < 2 OR length(q) > 1000 OR q IS NULL THEN 'question must have 2 to 1000 characters' WHEN n = 5 THEN 'language must have up to 30 characters' WHEN n = 0 OR n = 11 THEN 'top_k must be 1 to 10' END AS problem FROM (SELECT *, conv_id % 13 AS n, CASE conv_id % 13 WHEN 3 THEN 'x' WHEN 4 THEN repeat(text, 40) ELSE text END AS q FROM conversations)",
    "settings_values": "SELECT conv_id, turn, [7, 5, 5, 5, 5, 8][conv_id % 6 + 1]::BIGINT AS top_k, [7.0, -3.0, 0.0, 0.15, 2.5, 8.0][conv_id % 6 + 1]::DOUBLE AS threshold, CASE turn % 3 WHEN 0 THEN 5 ELSE turn % 3 END::BIGINT AS or_default FROM conversations",
    "payload_answers": f"SELECT conv_id, turn, {_ANSWERS}[conv_id % 5 + 1] AS answer, {_SOURCES}[conv_id % 5 + 1] AS sources, {_ANSWERS}[conv_id % 5 + 1] IS NOT NULL AS success FROM conversations",
    "mock_routing": "SELECT conv_id, turn, CASE WHEN turn > 0 AND trim(text) <> '' THEN ['Test cevabı.', 'Odpowiedź testowa.', 'Odpowiedź testowa.', 'Test response.', 'Test cevabı.', 'Test response.'][conv_id % 6 + 1] END AS reply FROM conversations",
    "embedding_text": "SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN source || chr(10) ELSE '' END || lang || chr(10) || text) AS text_sha256 FROM documents",
    "stream_running": f"SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS total_questions, coalesce(sum(CASE WHEN {MISSED} THEN 1 ELSE 0 END), 0)::BIGINT AS unanswered_questions, round(coalesce(avg({_CONF}), 0), 4)::DOUBLE AS average_confidence, round(coalesce(avg(value), 0), 2)::DOUBLE AS average_latency_ms FROM events GROUP BY 1",
    "stream_metrics": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
