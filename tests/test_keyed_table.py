"""The versioned table by key: touched partitions, two writers, replays, nulls, deletions, expiry."""

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corvane.operators import crawl, state
from corvane.sources import keyed_table as K
from corvane.sources import sinks
from corvane.streaming import usage_stream

KIND = "id long, v string, ord long"


def rows(spark, *r):
    return spark.createDataFrame(list(r), KIND)


def held(table):
    return sorted(((r["id"], r["v"]) for r in table.read().collect()), key=repr)


def test_merges(spark, tmp_path):
    t = K.KeyedTable(spark, str(tmp_path / "t"), parts=4)
    assert t.read() is None and t.manifest() is None and t.lookup([1]) is None
    t.merge(rows(spark, (1, "a", 1), (1, "b", 2), (2, "c", 1), (None, "n", 1)), "id", "ord")
    t.merge(rows(spark, (2, "d", 1), (3, "e", None), (None, "m", 2), (1, "old", 1)), "id", "ord")
    assert held(t) == [(1, "b"), (2, "d"), (3, "e"), (None, "m")]
    t.merge(rows(spark, (3, "f", 0), (1, "null", None)), "id", "ord")
    assert held(t) == [(1, "b"), (2, "d"), (3, "f"), (None, "m")]
    assert t.versions() == [1, 2, 3] and sorted(r["v"] for r in t.read(1).collect()) == ["b", "c", "n"]
    assert [r["v"] for r in t.lookup([3, 77]).collect()] == ["f"] and [r["v"] for r in t.lookup([None]).collect()] == ["m"]
    t.merge(rows(spark), "id", "ord")
    assert len(held(t)) == 4
    with pytest.raises(ValueError):
        t.merge(rows(spark, (1, "x", 1)).withColumn("extra", F.lit(1)), "id", "ord")
    with pytest.raises(ValueError):
        t.merge(rows(spark, (1, "x", 1)), "v", "ord")


def test_only_touched_partitions_are_written(spark, tmp_path):
    t = K.KeyedTable(spark, str(tmp_path / "t"), parts=16)
    t.merge(spark.range(2000).select("id", F.lit("x").alias("v"), F.lit(1).cast("long").alias("ord")), "id", "ord")
    before = t.manifest()
    some = spark.range(2000).where(K.KeyedTable._part("id", 16).isin(3, 7)).limit(20).select("id", F.lit("y").alias("v"), F.lit(2).cast("long").alias("ord"))
    after = t.merge(some, "id", "ord")
    changed = {p for p in after.files if after.files[p] != before.files[p]}
    assert changed <= {"3", "7"} and changed
    written = sum(f.stat().st_size for p in changed for f in (Path(t.path) / n for n in after.files[p]))
    assert written < 0.3 * sum((Path(t.path) / n).stat().st_size for fs in before.files.values() for n in fs)
    assert t.read().count() == 2000 and t.read().where("v = 'y'").count() == 20


def test_two_writers_lose_nothing(spark, tmp_path):
    t = K.KeyedTable(spark, str(tmp_path / "t"), parts=4)
    t.merge(rows(spark, (0, "z", 0)), "id", "ord")
    failed = []

    def write(who):
        try:
            for k in range(3):
                own = K.KeyedTable(spark, t.path)
                own.merge(rows(spark, *[(i, f"{who}{k}", k) for i in range(who * 5, who * 5 + 8)]), "id", "ord", batch=(f"w{who}", k))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in (0, 1)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not failed
    got = dict(held(t))
    assert set(got) == set(range(13)) and all(v.endswith("2") for v in got.values())
    assert t.versions() == list(range(1, 8)) and t.manifest().batches == {"w0": 2, "w1": 2}


def test_a_taken_number_is_not_replaced(spark, tmp_path):
    t = K.KeyedTable(spark, str(tmp_path / "t"), parts=2)
    m = t.merge(rows(spark, (1, "a", 1)), "id", "ord")
    assert not t._commit(m)
    assert held(t) == [(1, "a")]


def test_replays_and_late_batches(spark, tmp_path):
    t = K.KeyedTable(spark, str(tmp_path / "t"), parts=2)
    first, other = rows(spark, (1, "a", 1)), rows(spark, (1, "b", 2))
    t.merge(first, "id", "ord", batch=("s", 0))
    t.merge(other, "id", "ord", batch=("other", 5))
    assert t.merge(first, "id", "ord", batch=("s", 0)).n == 2  # known, though another writer came between
    t.merge(first, "id", "ord")  # not known, but older
    assert held(t) == [(1, "b")]


def test_deletions_compaction_and_expiry(spark, tmp_path):
    t = K.KeyedTable(spark, str(tmp_path / "t"), parts=2)
    t.merge(rows(spark, *[(i, "a", 1) for i in range(6)]), "id", "ord")
    t.delete(spark.createDataFrame([(1,), (2,), (99,)], "id long"), 2)
    t.merge(rows(spark, (1, "late", 1), (2, "new", 3)), "id", "ord")
    assert held(t) == [(0, "a"), (2, "new"), (3, "a"), (4, "a"), (5, "a")]
    marks = rows(spark, (3, None, 5), (4, "b", 5)).withColumn("gone", F.col("v").isNull())
    t.merge(marks, "id", "ord", deleted="gone")
    assert held(t) == [(0, "a"), (2, "new"), (4, "b"), (5, "a")]
    t.compact()
    assert held(t) == [(0, "a"), (2, "new"), (4, "b"), (5, "a")] and t._rows(t.manifest()).count() == 4
    files = lambda: len(list(Path(t.path).rglob("*.parquet")))
    before = files()
    assert t.expire(1) == 4 and t.versions() == [5] and files() < before
    assert held(t) == [(0, "a"), (2, "new"), (4, "b"), (5, "a")] and t.expire(1) == 0


def test_stream(spark, tmp_path):
    for i, batch in enumerate(([(1, "a", 1)], [(1, "b", 2), (2, "c", 1)], [(2, None, 3)])):
        rows(spark, *batch).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = usage_stream.event_stream(spark, str(tmp_path / "in" / "*"), "*.parquet", rows(spark).schema)
    gone = lambda df: df.withColumn("gone", F.col("v").isNull())
    for _ in range(2):
        K.merge_stream(stream, str(tmp_path / "t"), "id", "ord", str(tmp_path / "ck"), "gone", gone)
        assert held(K.KeyedTable(spark, str(tmp_path / "t"))) == [(1, "b")]


def test_null_orders_and_keys_of_the_older_forms(spark, tmp_path):
    got = state.last_wins(rows(spark, (1, "kept?", None), (2, "a", None), (2, "b", 1)), "id", "ord")
    assert sorted(tuple(r) for r in got.select("id", "v").collect()) == [(1, "kept?"), (2, "b")]
    for _ in range(2):
        one = rows(spark, (None, "n", 1), (1, "a", 1))
        assert state.upsert(one, rows(spark, (None, "m", 2)), "id", "ord").count() == 2
    pages = spark.createDataFrame([("u", None, "t")], "url string, ord long, title string")
    assert tuple(crawl.merge_crawls(pages, "url", "ord", "title").first()) == ("u", "t", None)
    path = str(tmp_path / "t")
    sinks.upsert_table(spark, path, rows(spark, (1, "a", 1)), "id", "ord", "one")
    sinks.upsert_table(spark, path, rows(spark, (1, "b", 2)), "id", "ord", "two")
    at = sinks.upsert_table(spark, path, rows(spark, (1, "a", 1)), "id", "ord", "one")
    assert [r["v"] for r in spark.read.parquet(at).collect()] == ["b"]
