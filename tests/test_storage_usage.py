"""Readers, sinks, change detection, usage metrics and streams."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import state, usage
from corvane.sources import readers, sinks
from corvane.streaming import usage_stream


def test_chunk_reader(spark, tmp_path):
    path = tmp_path / "chunks.jsonl"
    rows = [{"url": " u ", "text": " t ", "language": "EN", "extra": 1}, {"url": "v", "text": " "}, {"url": "w", "text": "x", "title": None}]
    path.write_text("\n\n".join(json.dumps(r) for r in rows) + "\n")
    got = [tuple(r) for r in readers.chunks(spark, str(path)).select("url", "text", "title", "language", "section").collect()]
    assert got == [("u", "t", "Untitled", "en", ""), ("w", "x", "Untitled", "pl", "")]
    path.write_text('{"url": "u"\n')
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        readers.chunks(spark, str(path)).collect()
    assert readers.chunks(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(FileNotFoundError):
        readers.chunks(spark, str(tmp_path / "none"), missing_ok=False)


def test_pages_state_settings(spark, tmp_path):
    (tmp_path / "pages.json").write_text(json.dumps([{"url": "u", "title": "t", "language": "pl", "markdown": "a\nb"}]))
    assert readers.pages(spark, str(tmp_path / "pages.json")).first()["markdown"] == "a\nb"
    assert readers.state(spark, str(tmp_path / "state")).count() == 0
    s = readers.Settings.from_mapping({"CORVANE_TOP_K": "-1", "CORVANE_CONFIDENCE": "x", "CORVANE_DIMENSIONS": "64"})
    assert (s.top_k, s.confidence_threshold, s.embedding_dimensions) == (5, 0.15, 64)
    assert readers.stored_count(spark, "no_such_table") is None


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("https://h/en/a.pdf",), ("https://h/en/a.pdf",), ("https://h/b.pdf",)], "url string")
    sinks.pdfs(rows, str(tmp_path / "pdfs"))
    got = spark.read.json(str(tmp_path / "pdfs"))
    assert {tuple(r) for r in got.select("url", "language").collect()} == {("https://h/en/a.pdf", "en"), ("https://h/b.pdf", "pl")}
    pages = spark.createDataFrame([("u", "h1"), ("v", "h2")], "url string, content_hash string")
    sinks.crawl_state(pages, str(tmp_path / "state"))
    sinks.crawl_state(pages.where("url = 'u'"), str(tmp_path / "state"))
    assert [tuple(r) for r in readers.state(spark, str(tmp_path / "state")).collect()] == [("u", "h1")]


def test_changes(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, h string")
    old = spark.createDataFrame([(2, "b"), (3, "x"), (4, "d")], "id long, h string")
    got = {r["id"]: r["status"] for r in state.changes(now, old, "id", "h").collect()}
    assert got == {1: "new", 2: "unchanged", 3: "changed", 4: "deleted"}


def test_upsert(spark, tmp_path):
    one = spark.createDataFrame([("k", "a", 1), ("k", "b", 2), ("m", "c", 1)], "key string, v string, ord long")
    sinks.upsert_table(spark, str(tmp_path / "t"), one, "key", "ord")
    two = spark.createDataFrame([("m", "d", 1), ("n", "e", 1)], "key string, v string, ord long")
    at = sinks.upsert_table(spark, str(tmp_path / "t"), two, "key", "ord")
    assert {(r["key"], r["v"]) for r in spark.read.parquet(at).collect()} == {("k", "b"), ("m", "d"), ("n", "e")}
    assert state.is_complete(two, spark.read.parquet(at), "key").first()["complete"]
    bad = spark.createDataFrame([([1.0],)], "v array<float>")
    with pytest.raises(Exception, match="must have 2 numbers"):
        state.checked_vectors(bad, "v", 2).collect()


def test_metrics(spark):
    log = spark.createDataFrame([(1, "2024-01-01 00:00:01", True, 2.0), (2, "2024-01-02 00:00:00", False, 4.0), (3, "2024-01-01 00:00:00", False, 0.0)], "id long, t string, missed boolean, v double").withColumn("t", F.col("t").cast("timestamp"))
    shot = usage.snapshot(log, F.col("missed"), T.confidence(F.col("v")), F.col("v"))
    assert tuple(shot.first()) == (3, 1, 0.3889, 2.0)
    assert tuple(usage.kpis(shot).first()) == (3, 66.7, 0.3889, 0.002)
    got = {r["id"]: (r["total_questions"], r["unanswered_questions"]) for r in usage.running_totals(log, "t", "id", F.col("missed")).collect()}
    assert got == {3: (1, 0), 1: (2, 1), 2: (3, 1)}
    assert usage.within_days(log, "t", 0).count() == 1


def test_payloads(spark):
    rows = spark.createDataFrame([('["https://a", 7, {"link": "l", "name": "n"}]',), ('{"url": "u"}',), (None,), ("not json",)], "s string")
    got = [[(x["title"], x["url"]) for x in r["o"]] for r in rows.select(usage.sources(F.col("s")).alias("o")).collect()]
    assert got == [[("Verified source", "https://a"), ("n", "l")], [("Verified source", "u")], [], []]


def test_streams(spark, tmp_path):
    for i, rows in enumerate(([(1, "a")], [(1, "b"), (2, "c")])):
        spark.createDataFrame(rows, "key long, v string").withColumn("ord", F.lit(i)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = usage_stream.event_stream(spark, str(tmp_path / "in"), "*.parquet", schema)
    usage_stream.upsert_stream(stream, str(tmp_path / "table"), "key", "ord", str(tmp_path / "ck"))
    last = spark.read.json(str(tmp_path / "table/_versions")).orderBy(F.desc("n")).first()["at"]
    assert {(r["key"], r["v"]) for r in spark.read.parquet(last).collect()} == {(1, "b"), (2, "c")}


def test_daily_append(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 01:00:00", "x", 1.0), ("2024-01-01 02:00:00", "x", 2.0), ("2024-01-05 00:00:00", "x", 4.0)], "ts string, event_type string, value double")
    rows.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = usage_stream.event_stream(spark, str(tmp_path / "in"), "*.parquet", spark.read.parquet(str(tmp_path / "in")).schema)
    got = usage_stream.drain(usage_stream.daily_metrics(stream), "daily_append_test", "append", str(tmp_path / "ck"))
    assert [tuple(r) for r in got.collect()] == [("2024-01-01", "x", 2, 3.0)]
