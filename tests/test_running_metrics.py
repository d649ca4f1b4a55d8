"""Running metrics over a stream of files: restarts, late rows, and the totals of one batch run."""

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import usage
from corvane.sources.keyed_table import KeyedTable
from corvane.streaming import usage_stream

KIND = "id long, ts timestamp, missed boolean, v double"


def rows(spark, *r):
    return spark.createDataFrame([(i, t, m, v) for i, t, m, v in r], "id long, t string, missed boolean, v double").select("id", F.col("t").cast("timestamp").alias("ts"), "missed", "v")


def test_restarts_give_the_totals_of_one_run(spark, tmp_path):
    folder, ck, path = str(tmp_path / "in"), str(tmp_path / "ck"), str(tmp_path / "t")
    batches = [
        [(1, "2024-01-01 01:00:00", True, 2.0), (2, "2024-01-01 02:00:00", False, 4.0), (3, None, False, 1.0)],
        [(4, "2024-01-01 23:00:00", None, None), (5, "2024-01-02 01:00:00", False, 6.0)],
        [(6, "2024-01-02 03:00:00", True, 0.0), (7, "2024-01-09 00:00:00", False, 1.0)],
    ]
    for k, batch in enumerate(batches):
        rows(spark, *batch).coalesce(1).write.mode("append").parquet(folder)
        stream = usage_stream.event_stream(spark, folder, "*.parquet", rows(spark, *batch).schema)
        metrics = usage_stream.running_metrics(stream, F.col("missed"), T.confidence(F.col("v")), F.col("v"))
        usage_stream.keep_metrics(metrics, path, ck)  # each call goes on from the checkpoint
        seen = spark.read.parquet(folder).where("ts is not null").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
        want = usage.snapshot(seen, F.col("missed"), T.confidence(F.col("v")), F.col("v"), "day")
        got = KeyedTable(spark, path).read().drop("version")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect())), k
    # more than a day behind the latest of the batches before: dropped, and its day stays
    before = sorted(map(tuple, KeyedTable(spark, path).read().drop("version").collect()))
    rows(spark, (8, "2024-01-01 05:00:00", True, 9.0)).coalesce(1).write.mode("append").parquet(folder)
    stream = usage_stream.event_stream(spark, folder, "*.parquet", rows(spark, *batches[0]).schema)
    usage_stream.keep_metrics(usage_stream.running_metrics(stream, F.col("missed"), T.confidence(F.col("v")), F.col("v")), path, ck)
    assert sorted(map(tuple, KeyedTable(spark, path).read().drop("version").collect())) == before
    assert len(KeyedTable(spark, path).versions()) <= 3
