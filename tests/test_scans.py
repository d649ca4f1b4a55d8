"""Searches that score within the scan: results against plain loops, and nothing but the best exchanged."""

import math

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import bm25, vector


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_index_merges_repeated_chunks_and_searches_as_without_one(spark, tmp_path):
    rows = [(i, f"alpha beta{i % 5} {'gamma ' * (i % 4)}", "en" if i % 3 else None) for i in range(60)] + [(7, "delta gamma alpha", "en"), (7, "delta beta2 beta2", "en"), (None, "gamma", "fr"), (80, "", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tokens = bm25.token_table(docs, "doc_id", "doc_id", [F.col("text")], [F.col("lang")], F.col("lang"))
    asked = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate([("alpha gamma", "en"), ("delta beta2", "xx"), ("gamma fr", "zz"), ("nothing", "en")])], "q long, question string, language string")
    terms = bm25.query_terms(asked, language="language")
    index = bm25.write_index(tokens, str(tmp_path / "i"))
    assert index.apart
    told = lambda df: sorted((r["q"], r["key"] is None, r["key"] or 0, round(r["score"], 9), r["rank"]) for r in df.collect())
    for by_language in (False, True):
        want = bm25.search(tokens, terms, 4, by_language)
        found = bm25.search_index(spark, index, terms, 4, by_language)
        assert told(found) == told(want) and found.count() > 4
        # several blocks of questions
        parts = [spark.read.parquet(f"{index.path}/{p}") for p in ("single", "frequencies", "languages", "repeated")]
        assert told(bm25.best_rows(parts[0], parts[1], index.n, index.avgdl, parts[2], terms, 4, by_language, parts[3], most=2)) == told(want)
    # only what each task kept is exchanged: no aggregate over questions and chunks
    found = bm25.search_index(spark, bm25.write_index(tokens.where("key > 100 or key < 7"), str(tmp_path / "j")), terms, 4)
    assert "HashAggregate" not in plan(found) and "MapInArrow" in plan(found)
    freq = bm25.term_frequency(tokens)
    assert {(r["key"], r["term"]): r["tf"] for r in freq.collect()}[7, "beta2"] == 3


def test_counting_a_chunk_exchanges_nothing(spark):
    docs = spark.createDataFrame([(1, "beta alpha beta"), (2, "")], "doc_id long, text string")
    rows = bm25.counted(bm25.token_table(docs, "doc_id", "doc_id", [F.col("text")]))
    assert [(r["dl"], r["terms"], r["tf"], r["mtf"]) for r in rows.collect()] == [(3, ["alpha", "beta"], [1, 2], [0, 0]), (0, [], [], [])]
    assert "Exchange" not in plan(rows) and "Exchange" not in plan(bm25.term_frequency(bm25.token_table(docs, "doc_id", "doc_id", [F.col("text")])))


def test_folding_is_pythons(spark):
    texts = ["Straße ﬁx İstanbul", "ŉ ǰ ΐ և ᾳ ﬗ ẞ", "plain", "ÄÖÜ", ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(T.casefold(F.col("t"))).collect()]
    assert got == [t.casefold() for t in texts]
    assert [r[0] for r in spark.createDataFrame([("".join(T._MORE),)], "t string").select(T.casefold(F.col("t"))).collect()] == ["".join(T._MORE).casefold()]


@pytest.mark.parametrize("most", [3, 1000])
def test_nearest_matches_plain_loops(spark, most):
    import random

    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.5, 2.0, 0.0]) for _ in range(3)], i % 2) for i in range(300)]
    rows += [(300 + i, [0.0, 0.0, 0.0], 0) for i in range(5)] + [(400, None, 0), (401, [1.0, None, 2.0], 0), (402, [1.0, 2.0], 1), (None, [1.0, 0.5, 2.0], 0), (403, [float("nan"), 1.0, 1.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    asked = [(k, v, s) for k, v, s in rows if k is not None and k % 40 == 0]
    queries = spark.createDataFrame(asked, "q long, vector array<float>, label int")

    def similar(v, u):
        if not v or not u or len(v) != len(u) or None in v or None in u:
            return None
        nv, nu = math.sqrt(sum(x * x for x in v)), math.sqrt(sum(x * x for x in u))
        if nv * nu == 0:
            return None
        c = sum(x * y for x, y in zip(v, u, strict=True)) / (nv * nu)
        return 1.0 if c != c else max(0.0, min(1.0, c))

    for same in (None, "label"):
        want = []
        for q, u, s in asked:
            scored = sorted((-round(c, 9), k is not None, k or 0) for k, v, t in rows if (same is None or s == t) and (c := similar(v, u)) is not None)
            want += [(q, there, k, -c, rank) for rank, (c, there, k) in enumerate(scored[:20], 1)]
        got = vector.nearest(table, queries, 20, same=same, most=most).collect()
        assert sorted((r["q"], r["key"] is not None, r["key"] or 0, round(r["similarity"], 9), r["rank"]) for r in got) == sorted(want)
