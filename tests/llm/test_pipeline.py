"""The pipeline's stages, each on its own input, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from corvane.llm import shingle_links

from .test_decontam import brute as leaks
from .test_simhash import brute_components, brute_fp
from .test_suffix_dedup import brute as repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows(words):
    rng = random.Random(21)
    words = [w for w in words if len(w) > 3]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, item, base = say(60), say(30), say(200)
    out = [(k, say(rng.randint(30, 120)) + ".") for k in range(60)]
    out += [(100, base), (101, base), (102, base + " end"), (110, f"{say(80)} {passage} {say(40)}"), (111, f"{say(90)} {passage} {say(70)}"), (120, f"{say(50)} {item} {say(20)}"), (130, None), (131, "1234 !"), (132, "")]
    return [(i, t, ("en", "de", "fr", "es")[i % 4], "s", None if t is None else len(t)) for i, t in out], item


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    at = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows[0], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, rows[1])], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages(spark, folder, rows, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in C.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stage(spark, docs, folder)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = before, docs.collect()
    before, after = kept["language_id"]
    assert {r["doc_id"] for r in after} == {i for i, _ in before} - {130, 131, 132}
    before, after = kept["near_dedup"]
    parts = brute_components([brute_fp(t) for _, t in before], [i for i, _ in before])
    assert {r["doc_id"] for r in after} == set(parts) and len(after) == len(set(parts))
    assert 100 in set(parts) and 101 not in set(parts)
    before, after = kept["suffix_dedup"]
    cut = {i: n for i, _, n, _, _ in repeats(before, 100)}
    text = dict(before)
    for r in after:
        assert len(r["text"].encode()) <= len(text[r["doc_id"]].encode()) - cut[r["doc_id"]] and r["n_chars"] == len(r["text"])
        if not cut[r["doc_id"]]:
            assert r["text"] == text[r["doc_id"]]
    assert cut[111] > 200 and cut[110] == 0
    before, after = kept["decontamination"]
    hit = {row[0] for row in leaks(before, [(1, rows[1])]) if row[5]}
    assert hit == {120} and {r["doc_id"] for r in after} == {i for i, _ in before} - hit
    before, after = kept["sentencepiece"]
    assert len(after) == len(before) and all(r["lossless"] for r in after)
    assert {r["doc_id"]: r["ids_crc32"] for r in C.run(spark, folder).collect()} == {r["doc_id"]: r["ids_crc32"] for r in after}


def test_empty(spark, folder, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_ties(spark):
    data = [(1, "same words here", "en", "b", 3), (1, "same words here", "en", "a", 3), (None, "other words at all", "en", "s", 1), (None, "other words at all", "en", "s", 1), (None, "a third text", "en", "s", 1)]
    out = C.near_duplicates(spark, spark.createDataFrame(data, SCHEMA), "").collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in out) == [(-1, "a third text"), (-1, "other words at all"), (1, "same words here")]


@pytest.mark.parametrize(("block", "crowd"), [(shingle_links.BLOCK, shingle_links.CROWD), (7, 1000), (3, 1)])
def test_near_dedup_by_shingles(spark, words, monkeypatch, block, crowd):
    """Small blocks and crowds take the ways of large groups."""
    monkeypatch.setattr(shingle_links, "BLOCK", block)
    monkeypatch.setattr(shingle_links, "CROWD", crowd)
    rng = random.Random(33)
    say = lambda n: [rng.choice(words) for _ in range(n)]
    line, texts = say(12), []
    for _ in range(12):
        base = say(rng.randint(20, 250))
        texts += [" ".join(base), " ".join(line + base)]
        for share in (0.005, 0.01, 0.02, 0.04):
            texts.append(" ".join(rng.choice(words) if rng.random() < share else w for w in base))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    fps, part = [brute_fp(t) for t in texts], list(range(len(texts)))
    far = 0
    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            near = 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared)
            far += near and (fps[i] ^ fps[j]).bit_count() > 3
            if near or (fps[i] ^ fps[j]).bit_count() <= 3:
                part = [min(part[i], part[j]) if p in (part[i], part[j]) else p for p in part]
    assert far > 5
    out = C.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r["doc_id"] for r in out) == sorted(set(part))


def test_crowded_groups(spark, words, monkeypatch):
    """Short texts, each of whose few first shingles many others have, too."""
    rng = random.Random(44)
    base = [rng.choice(words) for _ in range(30)]
    texts = []
    for k in range(120):
        w = list(base)
        for _ in range(k % 9):
            w[rng.randrange(30)] = rng.choice(words)
        texts.append(" ".join(w))
    monkeypatch.setattr(shingle_links, "BLOCK", 2)
    monkeypatch.setattr(shingle_links, "CROWD", 2)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.lower().split() for t in texts)]
    part = list(range(len(texts)))
    fps = [brute_fp(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared) or (fps[i] ^ fps[j]).bit_count() <= 3:
                part = [min(part[i], part[j]) if p in (part[i], part[j]) else p for p in part]
    out = C.near_duplicates(spark, spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA), "").collect()
    assert 20 < len(set(part)) < 110
    assert sorted(r["doc_id"] for r in out) == sorted(set(part))


def test_rows_of_a_large_group(spark):
    """A million unlike sets at one shingle go out a bounded number of times."""
    n, size = 1_000_000, 12
    rooted = spark.range(n).selectExpr("5L h", "id sid", "id root", f"shiftleft({size}L, 32) at")

    def seconds(sids):
        return sids.selectExpr("sid", "explode(sequence(0L, 3L)) place").withColumn("second", F.xxhash64("sid", "place")).select("sid", "second", "place")

    assert n / shingle_links.BLOCK > shingle_links.CROWD
    assert shingle_links._blocks(rooted, 0.8, seconds).count() <= 4 * n


def test_near_dedup_in_few_tasks(spark, words):
    """With 64 shuffle partitions, small tables between the steps get as many tasks as their rows are worth, for each task leaves files."""
    rng = random.Random(55)
    say = lambda n: [rng.choice(words) for _ in range(n)]
    rows = []
    for k in range(20):
        base = say(40)
        rows += [(4 * k + j, " ".join(w if i not in (3 * j, 39 - j) else "zz" for i, w in enumerate(base)), "en", "s", 1) for j in range(4)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    sc, held = spark.sparkContext, {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sc.setJobGroup("few tasks", "near_dedup")
    try:
        found = shingle_links.near_duplicates(docs).select("doc_id", "component_id").collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.set(k, v)
    told = sc.statusTracker()
    stages = {s for j in told.getJobIdsForGroup("few tasks") for s in told.getJobInfo(j).stageIds}
    tasks = [told.getStageInfo(s).numCompletedTasks for s in stages if told.getStageInfo(s)]
    assert len({r["doc_id"] for r in found}) == 80
    # 4,633 when each of these had a task for each shuffle partition
    assert 0 < sum(tasks) < 3000
