import zlib
from collections import Counter, defaultdict

from corvane.llm import sharding

from .conftest import make_docs


def test_query(spark, written, odd_rows):
    d = written(odd_rows)
    got = sharding.op1_shards(spark, d).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in odd_rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert (r["law"], r["grown_shard"]) == ("rows", None) and 0 <= r["shard"] < 40
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(40)]
    assert max(sizes) - min(sizes) <= 1


def test_seeded_and_complete(spark, odd_rows):
    docs = make_docs(spark, odd_rows * 20)
    place = lambda seed, n: sorted((r["shard"], r["slot"], r["record"]["doc_id"] or -1, r["record"]["a.b"]) for r in sharding.shuffle_shards(docs.repartition(n), 7, seed, bucket_bytes=1 << 14).collect())
    assert place(1, 3) == place(1, 5) != place(2, 3)
    assert len(place(1, 3)) == 20 * len(odd_rows)


def test_mixed(spark):
    docs = make_docs(spark, [(i, f"t{i}") for i in range(4000)])
    rows = sharding.shuffle_shards(docs, 4, 3).collect()
    order = [r["record"]["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert sum(a < b for a, b in zip(order, order[1:])) in range(1700, 2300)


def test_write_and_empty(spark, tmp_path):
    docs = make_docs(spark, [(i, str(i)) for i in range(50)])
    sharding.write_shards(sharding.shuffle_shards(docs, 3), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and back.select("shard").distinct().count() == 3
    assert sharding.shuffle_shards(docs.limit(0)).collect() == []


def test_maps(spark):
    docs = make_docs(spark, [(1, "a"), (1, "a"), (2, None)]).selectExpr("*", "map('k', doc_id) AS m")
    assert sharding.shuffle_shards(docs, 2).count() == 3


def test_one_row_many_times(spark):
    """Copies of one row are scattered over buckets, alike for any layout, and none is lost."""
    rows = [(5, "same text " * 20)] * 900 + [(i, f"t{i}") for i in range(60)]
    docs = make_docs(spark, rows)
    run = lambda n: sharding.shuffle_shards(docs.repartition(n), 7, 3, bucket_bytes=1 << 14)
    place = lambda n: sorted((r["shard"], r["slot"], r["record"]["doc_id"]) for r in run(n).collect())
    got = place(2)
    assert got == place(5)
    assert Counter(i for _, _, i in got) == Counter(i for i, _ in rows)
    sizes = Counter(s for s, _, _ in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    # 900 copies of 216 bytes fill some twelve buckets
    held = Counter(r["p"] for r in run(3).selectExpr("spark_partition_id() p").collect())
    assert len(held) >= 10 and max(held.values()) < 200


def test_copies_with_maps(spark):
    docs = make_docs(spark, [(1, "a" * 400)] * 200 + [(2, None)]).selectExpr("*", "map('k', doc_id) AS m")
    got = sharding.shuffle_shards(docs, 2, bucket_bytes=1 << 12).collect()
    assert Counter(r["record"]["doc_id"] for r in got) == {1: 200, 2: 1}


def test_empty_query(spark, written):
    assert sharding.op1_shards(spark, written([])).count() == 0
