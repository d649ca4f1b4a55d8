import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import minhash as M
from corvane.llm import shingle_links
from corvane.llm.common import cut


def shingles(text, width=5):
    low = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", low) if x]
    return {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    return sorted(((i, len(s), least[find(k)], i == least[find(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def more_rows(words):
    """Chains of near copies, a group that shares half of its words, and short texts."""
    rng = random.Random(2)
    say = lambda n: [rng.choice(words) for _ in range(n)]
    rows, base = [], say(200)
    for k in range(40):  # each near the one before
        base = [*base]
        base[rng.randrange(200)] = f"z{k}"
        rows.append((1000 + k, " ".join(base)))
    common = say(120)
    rows += [(1100 + k, " ".join([*common, *say(60)])) for k in range(30)]
    rows += [(1150 + k, " ".join([*common, *rows[40 + k][1].split()[120:-3], "end"])) for k in range(5)]
    rows += [(1200 + k, " ".join(say(11)[: 1 + k % 11])) for k in range(22)] + [(1230, "a b c d e f g h i j k l m n o p q"), (1231, "a b c d e f g h i j k l m n o p Q"), (1232, "A b c d e f g h i j k l m n o p q r")]
    return rows


def test_query_is_brute_force(spark, written, odd_rows, more_rows):
    rows = odd_rows + more_rows
    assert got(M.op11_minhash(spark, written(rows))) == brute(rows)


def test_parted_buckets(spark, monkeypatch, more_rows):
    """Short keys and low limits, so large buckets of unlike sets are parted, dealt in blocks and compared."""
    monkeypatch.setattr(M, "LARGE", 4)
    monkeypatch.setattr(M, "PARTNERS", 2)
    monkeypatch.setattr(M.Signatures.__init__, "__defaults__", (60, 2, 5))
    docs = spark.createDataFrame(more_rows, "doc_id long, text string")
    assert got(M.near_duplicates(docs)) == brute(more_rows)


def test_empty(spark, written):
    assert M.op11_minhash(spark, written([])).collect() == []
    assert got(M.near_duplicates(spark.createDataFrame([(1, None), (2, ""), (2, " ")], "doc_id long, text string"))) == [(1, 0, 1, True), (2, 0, 2, True), (2, 0, 2, True)]


@pytest.mark.parametrize("n", [7, 20, 150, 3000])
def test_bins_agree_as_sets_do(n):
    rng, sig = np.random.default_rng(n), M.Signatures()
    same, keys = [], []
    for _ in range(60):
        x = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        y = np.unique(np.concatenate([x[rng.permutation(n)[: round(n * 0.925)]], rng.integers(0, 1 << 64, n - round(n * 0.925), np.uint64)]))
        like = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        same.append((sig.bins_of(x) == sig.bins_of(y)).mean() - like)
        keys.append((sig.keys(x) == sig.keys(y)).any())
    assert abs(np.mean(same)) < 0.03
    assert all(keys)


def test_one_element_fills_all_bins():
    assert len(set(M.Signatures().bins_of(np.array([12345], np.uint64)).tolist())) == 1


def test_edges_are_stars(spark, words):
    """A large group of near copies is compared with hubs, not pair by pair."""
    rng = random.Random(6)
    base = [rng.choice(words) for _ in range(300)]
    rows = [(k, " ".join([*base[: k % 300], f"w{k}", *base[k % 300 + 1 :]])) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = cut(M._marks(docs, "doc_id", "text", 5))
    sets = cut(marks.groupBy("one", "two").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("bits", ignorenulls=True).alias("bits"), F.first("keys", ignorenulls=True).alias("keys")).withColumn("set", F.monotonically_increasing_id()))
    found = M.links(docs, sets)
    assert found.count() < 4 * len(rows)
    assert {r["component_id"] for r in M.near_duplicates(docs).collect()} == {0}
    assert shingle_links.Shingles(5).of([b"a"]).size == 1


def test_components_of_long_chains_in_few_tasks(spark):
    """Right in few tasks: with 40 shuffle partitions as with 4, a round's tasks stay as many as its edges are worth."""
    from corvane.llm import components

    edges = spark.range(0, 300, 1, 40).selectExpr("id AS a", "id + 1 AS b").where("a % 100 <> 99")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    stored = []
    try:
        with pytest.MonkeyPatch.context() as patch:
            cut = components.cut
            patch.setattr(components, "cut", lambda df: stored.append(cut(df)) or stored[-1])
            found = components.connected_components(edges)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(df.rdd.getNumPartitions() <= components.TASKS for df in stored[1:]) and len(stored) > 1
    assert sorted(map(tuple, found.collect())) == [(k, k // 100 * 100) for k in range(300)]
