"""The index that is kept up to date, held against one that is built anew."""

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corvane.operators import bm25
from corvane.operators.bm25_store import Store

D = "/root/testdata/sf0.001"


def table(df):
    return bm25.token_table(df, "doc_id", "doc_id", [F.col("text")], [F.col("source")], F.col("lang"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text", "lang", "source").cache()


@pytest.fixture(scope="module")
def terms(spark):
    items = spark.read.parquet(f"{D}/benchmark.parquet").select(F.col("item_id").alias("q"), F.col("text").alias("question"), F.when(F.col("item_id") % 2 == 0, "fr").otherwise("xx").alias("language"))
    return bm25.query_terms(items, language="language").cache()


def found(df):
    return sorted((r["q"], r["key"], round(r["score"], 9), r["rank"]) for r in df.collect())


def same(store, docs, terms):
    """The store answers as a search of these documents without an index does, and its sums are theirs."""
    for by_language in (False, True):
        assert found(store.search(terms, 7, by_language)) == found(bm25.search(table(docs), terms, 7, by_language))
    n, avgdl = bm25.corpus_stats(table(docs)).first()
    assert store.stats() == (n, pytest.approx(avgdl))
    assert sorted(store.document_frequency().collect()) == sorted(bm25.document_frequency(table(docs)).collect())


def size(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*") if f.is_file())


def test_updates_are_as_a_rebuild(spark, docs, terms, tmp_path):
    store = Store(spark, str(tmp_path / "i"), parts=4)
    assert store.search(terms, 3).collect() == [] and store.stats() == (0, 0.0)
    store.update(table(docs))
    same(store, docs, terms)
    whole = size(store.path)
    # edits, new chunks, and deletions of one in fifty
    edited = docs.where("doc_id % 50 = 3").withColumn("text", F.concat(F.lit("the license that applies "), F.substr("text", F.lit(1), F.lit(200))))
    added = docs.where("doc_id % 50 = 4").withColumn("doc_id", F.col("doc_id") + 100_000).withColumn("lang", F.lit("xx"))
    gone = docs.where("doc_id % 50 = 5")
    store.update(table(edited.unionByName(added)), gone.select(F.col("doc_id").alias("key")).unionByName(spark.createDataFrame([(-7,)], "key long")))
    now = docs.where("doc_id % 50 not in (3, 5)").unionByName(edited).unionByName(added).cache()
    same(store, now, terms)
    assert size(store.path) - whole < 0.6 * whole  # small files have their own cost here; the postings themselves:
    names = list(store.version()["segments"].items())
    assert [n for _, n in names] == [docs.count(), edited.count() + added.count()]
    # an edit of an edit, a key that comes back, a key twice in one update
    again = edited.limit(1).withColumn("text", F.lit("software license"))
    back = gone.limit(1)
    twice = again.withColumn("doc_id", F.lit(500_000).cast("long"))
    one = table(again.unionByName(back).unionByName(twice))
    older = table(twice.withColumn("text", F.lit("older"))).withColumn("ord", F.lit(-1).cast("long"))
    store.update(one.unionByName(older))
    now = now.join(again.select("doc_id"), "doc_id", "left_anti").unionByName(again).unionByName(back).unionByName(twice).cache()
    same(store, now, terms)
    v = store.compact(below=100)
    assert len(v["segments"]) == 2 and len(v["marks"]) == 1
    same(store, now, terms)
    v = store.compact()
    assert len(v["segments"]) == 1 and v["marks"] == []
    same(store, now, terms)
    assert store.compact() == v
    store.rebuild(table(docs))
    same(store, docs, terms)


def test_nothing_to_do_and_null_keys(spark, docs, terms, tmp_path):
    store = Store(spark, str(tmp_path / "i"), parts=2)
    assert store.update(table(docs.limit(0)))["version"] == 0
    assert store.update(None, spark.createDataFrame([(1,)], "key long"))["version"] == 0
    null = table(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    store.update(null)
    store.update(null)
    assert store.stats()[0] == 1
    store.update(None, spark.createDataFrame([(None,)], "key long"))
    assert store.stats()[0] == 0


def test_two_writers(spark, docs, terms, tmp_path):
    path = str(tmp_path / "i")
    Store(spark, path, parts=2).update(table(docs.where("doc_id < 20")))
    failed = []

    def write(low):
        try:
            Store(spark, path).update(table(docs.where(f"doc_id >= {low} and doc_id < {low + 30}")))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(low,)) for low in (10, 25)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    same(Store(spark, path), docs.where("doc_id < 55"), terms)
