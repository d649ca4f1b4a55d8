"""Search, fusion and answers against golden values of a five-record corpus."""

import pytest
from pyspark.sql import functions as F

from corvane.functions import lexicon as X
from corvane.functions import text as T
from corvane.operators import bm25, fusion, vector

CHUNKS = [
    (0, "https://example.org/en/tuition", "Tuition fees", "Computer Science", "Informatyka", "en", "The tuition fee for the Computer Science programme is published in the official tuition calculator."),
    (1, "https://example.org/en/admissions", "Admissions", "Required documents", "Rekrutacja", "en", "Applicants must submit the required documents through the university admissions process."),
    (2, "https://example.org/kontakt", "Kontakt", "Dane kontaktowe", "Kontakt", "pl", "Dane kontaktowe i adres uczelni znajdują się na oficjalnej stronie kontaktowej."),
    (3, "https://example.org/uk/pravyla-vstupu/", "Правила вступу", "Необхідні документи", "Приймальна комісія", "uk", "Кандидати подають необхідні документи відповідно до правил вступу університету."),
    (4, "https://example.org/ru/pravila-postupleniya/", "Правила поступления", "Необходимые документы", "Приёмная комиссия", "ru", "Кандидаты подают необходимые документы в соответствии с правилами поступления университета."),
]
GOLDEN = [
    ("Where can I find Computer Science tuition fees?", "English", [(0, 16.175444)]),
    ("Tell me about Computer Science tuition fees.", "English", [(0, 16.175444)]),
    ("What is the weather today?", "English", []),
    ("Bilgisayar bölümü öğrenim ücreti nedir?", "Türkçe", [(0, 13.031969)]),
    ("Які правила вступу?", "Українська", [(3, 5.355889)]),
    ("Какие правила поступления?", "Русский", [(4, 5.355889)]),
    ("Яка сьогодні погода?", "Українська", []),
    ("Tell me about admissions.", "English", [(1, 5.959291)]),
]


@pytest.fixture(scope="module")
def tokens(spark):
    rows = spark.createDataFrame(CHUNKS, "ord long, url string, title string, section string, faculty string, language string, text string")
    meta = [F.col("title"), F.col("section"), F.col("faculty")]
    return bm25.token_table(rows, "ord", "ord", [F.col("text")], meta, F.col("language")).cache()


def questions(spark, rows):
    return spark.createDataFrame([(i, q, lang) for i, (q, lang, _) in enumerate(rows)], "q long, question string, language string")


def test_statistics(tokens):
    assert [r["dl"] for r in tokens.orderBy("ord").collect()] == [16, 13, 13, 14, 14]
    assert tuple(bm25.corpus_stats(tokens).first()) == (5, 14.0)


def test_golden_scores(spark, tokens):
    found = bm25.search(tokens, bm25.query_terms(questions(spark, GOLDEN), language="language"), 10, by_language=True).collect()
    for i, (_, _, hits) in enumerate(GOLDEN):
        got = [(r["key"], round(r["score"], 6)) for r in sorted(found, key=lambda r: r["rank"]) if r["q"] == i]
        assert got == hits


def test_expanded_terms(spark):
    rows = questions(spark, GOLDEN).select(F.size(T.expand(T.tokens(F.col("question")))).alias("n")).collect()
    assert [r["n"] for r in rows] == [24, 24, 2, 23, 15, 15, 3, 16]


def test_empty_corpus_and_question(spark, tokens):
    none = tokens.limit(0)
    assert bm25.search(none, bm25.query_terms(questions(spark, GOLDEN)), 5).count() == 0
    assert bm25.search(tokens, bm25.query_terms(questions(spark, [("", "en", [])])), 5).count() == 0
    assert tuple(bm25.corpus_stats(none).first()) == (0, 0.0)


def test_gate_and_messages(spark, tokens):
    q = questions(spark, GOLDEN)
    best = bm25.search(tokens, bm25.query_terms(q, language="language"), 1, by_language=True)
    got = {r["q"]: r for r in bm25.gate(best, q, F.col("language")).collect()}
    assert got[0]["confidence"] == 0.89 and got[0]["answered"] and got[0]["message"] is None
    assert got[3]["confidence"] == 0.867 and got[7]["confidence"] == 0.7487
    assert got[2]["message"] == X.NOT_FOUND["en"] and got[6]["message"] == X.NOT_FOUND["uk"]


def test_confidence(spark):
    got = spark.createDataFrame([(0.0,), (-1.0,), (0.3529,), (2.0,), (None,)], "s double").select(T.confidence(F.col("s")).alias("c")).collect()
    assert [r["c"] for r in got] == [0.0, 0.0, 0.15, 0.5, 0.0]


@pytest.mark.parametrize(
    ("left", "right", "k", "wanted"),
    [
        ("ABC", "CDA", 5, [("A", 0.027505), ("C", 0.027348), ("B", 0.016129), ("D", 0.01129)]),
        ("", "AB", 2, [("A", 0.011475), ("B", 0.01129)]),
        ("AA", "B", 3, [("A", 0.032522), ("B", 0.011475)]),
    ],
)
def test_fusion(spark, left, right, k, wanted):
    make = lambda s: spark.createDataFrame([(0, i + 1, c) for i, c in enumerate(s)], "q long, rank int, key string")
    got = fusion.fuse(make(left), make(right), k, ["key"]).orderBy("rank").collect()
    assert [(r["key"], r["score"]) for r in got] == wanted


def test_hybrid(spark, tokens):
    q = questions(spark, [GOLDEN[7]])
    lexical = bm25.search(tokens, bm25.query_terms(q, language="language"), 10, by_language=True).select("q", "key", "score", "rank")
    close = spark.createDataFrame([(0, 99, 0.88, 1)], "q long, key long, similarity double, rank int")
    decisions, results = fusion.hybrid(q, lexical, close)
    d = decisions.first()
    assert (d["confidence"], d["mode"], d["retrieval_score"]) == (0.88, "hybrid-pgvector-bm25", 0.88)
    assert [(r["key"], r["score"]) for r in results.orderBy("rank").collect()] == [(99, 0.016393), (1, 0.011475)]
    decisions, results = fusion.hybrid(q, lexical, close.withColumn("similarity", F.lit(0.5)))
    assert decisions.first()["mode"] == "bm25" and [r["key"] for r in results.collect()] == [1]
    assert fusion.hybrid(q, lexical, None, failed=True)[0].first()["mode"] == "bm25-vector-fallback"
    texts = spark.createDataFrame([(1, "one"), (99, "other")], "key long, text string")
    assert fusion.answers(decisions, results, texts, F.lit("English")).first()["full_mode"] == "local-extractive+bm25"
    silent = lambda r: r.select("q").distinct().withColumn("answer", F.lit(None).cast("string"))
    got = fusion.answers(decisions, results, texts, F.lit("English"), silent).first()
    assert got["text"] == "one" and got["full_mode"] == "local-extractive-after-provider-error+bm25"


def test_excerpt(spark):
    rows = [("x" * 1000 + " " + "y" * 100 + " " + "z" * 300,), ("w" * 1300,), ("  short ",)]
    got = [r["e"] for r in spark.createDataFrame(rows, "t string").select(T.excerpt(F.col("t")).alias("e")).collect()]
    assert len(got[0]) == 1104 and got[0].endswith("...") and len(got[1]) == 1200 and got[2] == "short"


def test_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [3.0, 3.0]), (3, [0.0, 0.0]), (4, None)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 1.0])], "q long, vector array<float>")
    got = vector.nearest(rows, q, 2).orderBy("rank").collect()
    assert [(r["key"], round(r["similarity"], 4)) for r in got] == [(2, 1.0), (0, 0.7071)]
    many = spark.createDataFrame([(i, [1.0, i / 7]) for i in range(20)], "q long, vector array<float>")
    assert sorted(vector.nearest(rows, many, 2, most=3).collect()) == sorted(vector.nearest(rows, many, 2).collect())
    assert len(vector.bounded_queries(rows.select(F.col("vec_id").alias("q")), 2)) == 3


def test_embedding(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "")], "id long, text string")
    got = vector.embed(rows, F.col("text"), vector.HashEmbedder(8), 8).orderBy("id").collect()
    assert abs(sum(x * x for x in got[0]["embedding"]) - 1) < 1e-6 and not any(got[1]["embedding"])
    with pytest.raises(Exception, match="one vector of 9 numbers"):
        vector.embed(rows, F.col("text"), vector.HashEmbedder(8), 9).collect()
    with pytest.raises(ValueError):
        vector.build_embedder("nowhere")
