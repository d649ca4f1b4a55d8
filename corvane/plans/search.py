"""Search queries over the documents, embeddings and benchmark tables, each with its SQL.

documents stand for chunks (source is the metadata side), embeddings for the vector table (label stands for the
language there), benchmark items for questions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import lexicon as X
from corvane.functions import text as T
from corvane.operators import bm25, bm25_store, fusion, vector, vector_index
from corvane.runtime import new_table, version_of, widen

from . import oracle as O

QUESTION = "Which version of the license applies to the software and what was that for?"
META_QUESTION = QUESTION + " src3 src7"
FRENCH = "Les textes pas dans la source, que une les des sur pour"
#: Neighbours are asked for by every row whose id divides by this.
EVERY = 50


def docs(spark: SparkSession, d: str) -> DataFrame:
    return widen(spark.read.parquet(f"{d}/documents.parquet"))


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return widen(spark.read.parquet(f"{d}/embeddings.parquet"))


def items(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("q"), F.col("text").alias("question"))


def one(spark: SparkSession, question: str, language: str = "") -> DataFrame:
    return spark.range(1).select(F.col("id").alias("q"), F.lit(question).alias("question"), F.lit(language).alias("language"))


def table(spark: SparkSession, d: str, meta: list[Column] | None = None) -> DataFrame:
    return bm25.token_table(docs(spark, d), "doc_id", "doc_id", [F.col("text")], meta, F.col("lang"))


#: The indexes that an application has made, by the version of their table, each in the folder that its session shares.
_INDEXES: dict[tuple, bm25.Index] = {}


def lookup(spark: SparkSession, d: str, terms: DataFrame, k: int, by_language: bool = False, meta: bool = False) -> DataFrame:
    """A search in the stored index of the documents of d, which is made on first use."""
    key = (spark.sparkContext.applicationId, version_of(spark, f"{d}/documents.parquet"), meta)
    if key not in _INDEXES:
        _INDEXES[key] = bm25.write_index(table(spark, d, [F.col("source")] if meta else None), new_table(spark, "postings"))
    return bm25.search_index(spark, _INDEXES[key], terms, k, by_language)


def bm25_build(spark: SparkSession, d: str) -> DataFrame:
    """Builds the stored index of all documents anew: what it says of them."""
    made = bm25.write_index(table(spark, d), new_table(spark, "postings"))
    _INDEXES[spark.sparkContext.applicationId, version_of(spark, f"{d}/documents.parquet"), False] = made
    return spark.createDataFrame([(made.n, made.avgdl)], "n long, avgdl double").select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_updated(spark: SparkSession, d: str) -> DataFrame:
    """An index that had older texts of some documents and others that are gone is brought up to date; it answers as one of the documents alone."""
    now = docs(spark, d).select("doc_id", "text", "lang")
    old = now.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("license "), F.substr("text", F.lit(1), F.lit(300)))).otherwise(F.col("text")))
    gone = now.withColumn("doc_id", -F.col("doc_id") - 1).where("doc_id % 10 = 0")
    tokens = lambda df: bm25.token_table(df, "doc_id", "doc_id", [F.col("text")], None, F.col("lang"))
    store = bm25_store.Store(spark, new_table(spark, "index"))
    store.update(tokens(old.unionByName(gone)))
    store.update(tokens(now.where("doc_id % 3 = 0")), gone.select(F.col("doc_id").alias("key")))
    return ranked(store.search(bm25.query_terms(items(spark, d)), X.DEPTH), "q")


def ranked(found: DataFrame, *before: str) -> DataFrame:
    return found.select(*before, F.col("key").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# ---- text statistics ----


def token_stats(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d)
    return t.select(F.col("key").alias("doc_id"), "dl", F.size(F.array_distinct("tokens")).cast("long").alias("n_terms"))


def term_freq(spark: SparkSession, d: str) -> DataFrame:
    return bm25.term_frequency(table(spark, d)).select(F.col("key").alias("doc_id"), "term", "tf")


def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return bm25.document_frequency(table(spark, d))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return bm25.corpus_stats(table(spark, d)).select("n", F.round("avgdl", 6).alias("avgdl"))


def query_expand(spark: SparkSession, d: str) -> DataFrame:
    extra = [(-1, "Where can I find the tuition fee?"), (-2, "Bilgisayar bölümü öğrenim ücreti nedir?"), (-3, "Які правила вступу?"), (-4, "")]
    rows = items(spark, d).unionByName(spark.createDataFrame(extra, "q long, question string"))
    terms = T.expand(T.tokens(F.col("question")))
    return rows.select("q", F.array_join(terms, " ").alias("terms"), F.size(terms).cast("long").alias("n_terms"))


def language_alias(spark: SparkSession, d: str) -> DataFrame:
    names = [*X.LANGUAGE_ALIASES, " English ", "TÜRKÇE", "klingon", ""]
    rows = spark.createDataFrame([(n,) for n in names], "name string").unionByName(docs(spark, d).select(F.col("lang").alias("name")).distinct())
    return rows.select("name", T.language_code(F.col("name")).alias("code"), T.not_found(F.col("name")).alias("message"))


_TOK = f"(SELECT doc_id, {O.tokens('text')} AS toks FROM documents)"
_ALIAS = "CASE " + " ".join(f"WHEN n = {O.q(k)} THEN {O.q(v)}" for k, v in X.LANGUAGE_ALIASES.items()) + " ELSE n END"
_MESSAGE = "CASE code " + " ".join(f"WHEN {O.q(k)} THEN {O.q(v)}" for k, v in X.NOT_FOUND.items()) + f" ELSE {O.q(X.NOT_FOUND['en'])} END"

# ---- lexical search ----


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return ranked(lookup(spark, d, bm25.query_terms(one(spark, QUESTION)), 50))


def bm25_batch(spark: SparkSession, d: str) -> DataFrame:
    return ranked(lookup(spark, d, bm25.query_terms(items(spark, d)), X.DEPTH), "q")


def bm25_meta_boost(spark: SparkSession, d: str) -> DataFrame:
    return ranked(lookup(spark, d, bm25.query_terms(one(spark, META_QUESTION)), 50, meta=True))


def bm25_lang_filter(spark: SparkSession, d: str) -> DataFrame:
    terms = bm25.query_terms(one(spark, FRENCH, " FR "), language="language")
    return ranked(lookup(spark, d, terms, 50, by_language=True))


def bm25_lang_fallback(spark: SparkSession, d: str) -> DataFrame:
    terms = bm25.query_terms(one(spark, FRENCH, "Türkçe"), language="language")
    return ranked(lookup(spark, d, terms, 50, by_language=True))


def confidence_gate(spark: SparkSession, d: str) -> DataFrame:
    extra = spark.createDataFrame([(-1, "What is today's weather?"), (-2, "Zażółć gęślą jaźń")], "q long, question string")
    questions = items(spark, d).unionByName(extra)
    best = lookup(spark, d, bm25.query_terms(questions), 1)
    return bm25.gate(best, questions, F.when(F.col("q") == -2, "polski").otherwise("English"))


def _ask(question: str, k: int = 50, meta: str | None = None, keep: str = "TRUE") -> str:
    body = O.bm25("documents", f"(SELECT 0 AS q, {O.q(question)} AS question)", 1 << 40, meta=meta)
    return f"""WITH {body}
SELECT key AS doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, key) AS rank
FROM best JOIN documents ON doc_id = key WHERE {keep} ORDER BY rank LIMIT {k}"""


_ITEMS = "(SELECT item_id AS q, text AS question FROM benchmark)"

# ---- vectors ----


def _query(spark: SparkSession, d: str, where: Column) -> DataFrame:
    return embeddings(spark, d).where(where).select(F.col("vec_id").alias("q"), F.col("embedding").alias("vector"), "label")


def near(found: DataFrame) -> DataFrame:
    return found.select("q", F.col("key").alias("vec_id"), F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    return near(vector.nearest(embeddings(spark, d), _query(spark, d, F.col("vec_id") == 0), 50))


#: The vector tables that an application has stored by label, by the version of what they were made of.
_LABELS: dict[tuple, DataFrame] = {}


def by_label(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings in partitions by their label, stored on first use."""
    key = (spark.sparkContext.applicationId, version_of(spark, f"{d}/embeddings.parquet"))
    if key not in _LABELS:
        _LABELS[key] = vector.store_by(spark.read.parquet(f"{d}/embeddings.parquet"), new_table(spark, "labels"), "label")
    return _LABELS[key]


def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    return near(vector.nearest(by_label(spark, d), _query(spark, d, F.col("vec_id") == 0), 50, same="label"))


def knn_batch(spark: SparkSession, d: str) -> DataFrame:
    return near(vector.nearest(embeddings(spark, d), _query(spark, d, F.col("vec_id") % EVERY == 0), X.DEPTH))


#: The vector indexes that an application has made, by the version of their table.
_CELLS: dict[tuple, vector_index.Index] = {}


def vector_cells(spark: SparkSession, d: str) -> DataFrame:
    """Builds the index of all vectors anew; its cells, with how many rows lie in each."""
    made = vector_index.build(embeddings(spark, d), new_table(spark, "cells"))
    _CELLS[spark.sparkContext.applicationId, version_of(spark, f"{d}/embeddings.parquet")] = made
    return vector_index.cells(spark, made).select("cell", F.col("rows"), F.round("least", 6).alias("least"))


def _cells(spark: SparkSession, d: str) -> vector_index.Index:
    key = (spark.sparkContext.applicationId, version_of(spark, f"{d}/embeddings.parquet"))
    if key not in _CELLS:
        vector_cells(spark, d)
    return _CELLS[key]


def knn_index(spark: SparkSession, d: str) -> DataFrame:
    """Approximate: of each query's cells, by codes; recall is tested."""
    return near(vector_index.search(spark, _cells(spark, d), _query(spark, d, F.col("vec_id") % EVERY == 0), X.DEPTH, share=0.7))


def knn_cells(spark: SparkSession, d: str) -> DataFrame:
    """Exact, by the cells' bounds."""
    return near(vector_index.search(spark, _cells(spark, d), _query(spark, d, F.col("vec_id") % EVERY == 0), X.DEPTH, exact=True))


def vector_unit(spark: SparkSession, d: str) -> DataFrame:
    from corvane.functions import vectors as V

    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1))
    rows = embeddings(spark, d).select("vec_id", scaled.alias("e"))
    return rows.select("vec_id", F.round(V.norm(F.col("e")), 6).alias("length"), F.round(V.norm(V.unit(F.col("e"))), 6).alias("unit_length"), F.size("e").cast("long").alias("n"))


# ---- fusion ----


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions, their lexical list, and the list of neighbours of the vector with the question's id."""
    questions = items(spark, d)
    lexical = lookup(spark, d, bm25.query_terms(questions), X.DEPTH)
    own = embeddings(spark, d).join(questions, F.col("vec_id") == F.col("q"), "left_semi").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vector"))
    return questions, lexical, vector.nearest(embeddings(spark, d), own, X.DEPTH)


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    _, lexical, close = _lists(spark, d)
    fused = fusion.fuse(close, lexical, X.DEPTH, ["key"])
    return fused.select("q", F.col("key").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


#: Every third question has no similar vectors, so that both branches are taken.
def _hybrid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    questions, lexical, close = _lists(spark, d)
    close = close.withColumn("similarity", F.when(F.col("q") % 3 == 0, F.col("similarity") * 0.5).otherwise(F.col("similarity")))
    return (questions, *fusion.hybrid(questions, lexical, close))


def hybrid_answer(spark: SparkSession, d: str) -> DataFrame:
    _, decisions, results = _hybrid(spark, d)
    counts = results.groupBy("q").agg(F.count(F.lit(1)).alias("n_results"), F.min(F.when(F.col("rank") == 1, F.col("key"))).alias("best_key"))
    out = decisions.join(counts, "q", "left")
    return out.select("q", F.round("confidence", 4).alias("confidence"), "retrieval_score", "mode", "answered", F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), "best_key")


def hybrid_results(spark: SparkSession, d: str) -> DataFrame:
    _, _, results = _hybrid(spark, d)
    return results.select("q", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def extractive_answer(spark: SparkSession, d: str) -> DataFrame:
    _, decisions, results = _hybrid(spark, d)
    texts = docs(spark, d).select(F.col("doc_id").alias("key"), "text")
    return fusion.answers(decisions, results, texts, F.lit("English")).select("q", "answered", F.sha2("text", 256).alias("answer_sha256"), F.col("full_mode").alias("mode"))


def _results(spark: SparkSession, d: str) -> DataFrame:
    found = lookup(spark, d, bm25.query_terms(items(spark, d)), X.DEPTH)
    return found.join(docs(spark, d).select(F.col("doc_id").alias("key"), "source", "lang", "text"), "key")


def source_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return fusion.distinct_sources(_results(spark, d), "source").select("q", "source", F.col("first").cast("long").alias("first"), F.col("place").cast("long").alias("place"))


def prompt_context(spark: SparkSession, d: str) -> DataFrame:
    rows = _results(spark, d).where(F.col("rank") <= X.TOP_K).withColumn("url", F.concat(F.lit("doc:"), F.col("key").cast("string")))
    out = fusion.prompt_context(rows, "source", "lang", "url", "text")
    return out.select("q", F.char_length("context").cast("long").alias("n_chars"), F.sha2("context", 256).alias("context_sha256"))


_LISTS = f"""WITH {O.bm25('documents', _ITEMS, X.DEPTH)},
{O.nearest('embeddings', '(SELECT vec_id AS q, embedding AS u FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark))', X.DEPTH)}"""
_FUSE = """
fused AS (SELECT q, key, round(total, 6) AS score, rank FROM (
  SELECT q, key, total, row_number() OVER (PARTITION BY q ORDER BY round(total, 12) DESC, first) AS rank FROM (
    SELECT q, key, sum(CASE WHEN list = 0 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END / (60 + rank)) AS total, min(list * 1000 + rank) AS first
    FROM (SELECT q, key, rank, 0 AS list FROM near UNION ALL SELECT q, key, rank, 1 AS list FROM best) GROUP BY q, key)))"""
_HYBRID = f"""{_LISTS}, {_FUSE},
sim AS (SELECT q, max(CASE WHEN q % 3 = 0 THEN similarity * 0.5 ELSE similarity END) AS top FROM near GROUP BY q),
facts AS (SELECT i.q, coalesce(b.score, 0) AS s, sim.top, coalesce(sim.top >= 0.55, FALSE) AS fused FROM {_ITEMS} i
  LEFT JOIN (SELECT q, score FROM best WHERE rank = 1) b ON i.q = b.q LEFT JOIN sim ON sim.q = i.q),
dec AS (SELECT q, fused, CASE WHEN fused THEN greatest({O.confidence('s')}, top) ELSE {O.confidence('s')} END AS confidence,
  round(CASE WHEN fused THEN top ELSE s END, 4) AS retrieval_score, CASE WHEN fused THEN 'hybrid-pgvector-bm25' ELSE 'bm25' END AS mode FROM facts),
res AS (SELECT q, key, best.score, best.rank FROM best JOIN dec USING (q) WHERE NOT fused AND confidence >= 0.15 AND rank <= 5
  UNION ALL SELECT q, key, f.score, f.rank FROM fused f JOIN dec USING (q) WHERE dec.fused AND confidence >= 0.15 AND rank <= 5)"""

QUERIES = {
    "token_stats": token_stats, "term_freq": term_freq, "doc_freq": doc_freq, "corpus_stats": corpus_stats, "query_expand": query_expand, "language_alias": language_alias,
    "bm25_build": bm25_build, "bm25_updated": bm25_updated, "bm25_topk": bm25_topk, "bm25_batch": bm25_batch, "bm25_meta_boost": bm25_meta_boost, "bm25_lang_filter": bm25_lang_filter, "bm25_lang_fallback": bm25_lang_fallback, "confidence_gate": confidence_gate,
    "knn_topk": knn_topk, "knn_filtered": knn_filtered, "knn_batch": knn_batch, "vector_cells": vector_cells, "knn_index": knn_index, "knn_cells": knn_cells, "vector_unit": vector_unit,
    "rrf_fusion": rrf_fusion, "hybrid_answer": hybrid_answer, "hybrid_results": hybrid_results, "extractive_answer": extractive_answer, "source_dedupe": source_dedupe, "prompt_context": prompt_context,
}

_NEAR = "SELECT q, key AS vec_id, round(similarity, 6) AS similarity, rank FROM near"
_MSG = O.q(X.NOT_FOUND["en"])
_EXTRA = "SELECT -1, 'What is today''s weather?' UNION ALL SELECT -2, 'Zażółć gęślą jaźń'"

ORACLE = {
    "token_stats": f"SELECT doc_id, CAST(len(toks) AS BIGINT) AS dl, CAST(len(list_distinct(toks)) AS BIGINT) AS n_terms FROM {_TOK}",
    "term_freq": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM {_TOK}) GROUP BY ALL",
    "doc_freq": f"SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(toks)) AS term FROM {_TOK}) GROUP BY term",
    "corpus_stats": f"SELECT count(*) AS n, round(avg(len(toks)), 6) AS avgdl FROM {_TOK}",
    "query_expand": f"""SELECT q, array_to_string(e, ' ') AS terms, CAST(len(e) AS BIGINT) AS n_terms FROM (SELECT q, {O.expand('ts')} AS e FROM (SELECT q, {O.tokens('question')} AS ts FROM (
      SELECT item_id AS q, text AS question FROM benchmark UNION ALL SELECT -1, 'Where can I find the tuition fee?' UNION ALL SELECT -2, 'Bilgisayar bölümü öğrenim ücreti nedir?' UNION ALL SELECT -3, 'Які правила вступу?' UNION ALL SELECT -4, '')))""",
    "language_alias": f"""SELECT name, code, {_MESSAGE} AS message FROM (SELECT name, {_ALIAS} AS code FROM (SELECT name, {O.strip(O.casefold('name'))} AS n FROM (
      SELECT unnest({O.array([*X.LANGUAGE_ALIASES, ' English ', 'TÜRKÇE', 'klingon', ''])}) AS name UNION ALL SELECT DISTINCT lang FROM documents)))""",
    "bm25_build": f"SELECT count(*) AS n, round(avg(len(toks)), 6) AS avgdl FROM {_TOK}",
    "bm25_updated": f"WITH {O.bm25('documents', _ITEMS, X.DEPTH)} SELECT q, key AS doc_id, round(score, 6) AS score, rank FROM best",
    "bm25_topk": _ask(QUESTION),
    "bm25_batch": f"WITH {O.bm25('documents', _ITEMS, X.DEPTH)} SELECT q, key AS doc_id, round(score, 6) AS score, rank FROM best",
    "bm25_meta_boost": _ask(META_QUESTION, meta="source"),
    "bm25_lang_filter": _ask(FRENCH, keep="lang = 'fr'"),
    "bm25_lang_fallback": _ask(FRENCH),
    "confidence_gate": f"""WITH {O.bm25('documents', f"(SELECT item_id AS q, text AS question FROM benchmark UNION ALL {_EXTRA})", 1)}
      SELECT i.q, {O.confidence('score')} AS confidence, {O.confidence('score')} >= 0.15 AS answered, CASE WHEN {O.confidence('score')} < 0.15 THEN CASE WHEN i.q = -2 THEN {O.q(X.NOT_FOUND['pl'])} ELSE {_MSG} END END AS message
      FROM (SELECT item_id AS q, text AS question FROM benchmark UNION ALL {_EXTRA}) i LEFT JOIN best ON best.q = i.q""",
    "knn_topk": f"WITH {O.nearest('embeddings', '(SELECT vec_id AS q, embedding AS u FROM embeddings WHERE vec_id = 0)', 50)} {_NEAR}",
    "knn_filtered": f"WITH {O.nearest('embeddings', '(SELECT vec_id AS q, embedding AS u, label FROM embeddings WHERE vec_id = 0)', 50, 'label')} {_NEAR}",
    "knn_batch": f"WITH {O.nearest('embeddings', f'(SELECT vec_id AS q, embedding AS u FROM embeddings WHERE vec_id % {EVERY} = 0)', X.DEPTH)} {_NEAR}",
    "knn_cells": f"WITH {O.nearest('embeddings', f'(SELECT vec_id AS q, embedding AS u FROM embeddings WHERE vec_id % {EVERY} = 0)', X.DEPTH)} {_NEAR}",
    "vector_unit": "SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS length, 1.0::DOUBLE AS unit_length, CAST(len(e) AS BIGINT) AS n FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (label + 1)) AS e FROM embeddings)",
    "rrf_fusion": f"{_LISTS}, {_FUSE} SELECT q, key AS doc_id, score, rank FROM fused WHERE rank <= 10",
    "hybrid_answer": f"{_HYBRID} SELECT dec.q, round(confidence, 4) AS confidence, retrieval_score, mode, confidence >= 0.15 AS answered, count(res.key) AS n_results, min(res.key) FILTER (WHERE res.rank = 1) AS best_key FROM dec LEFT JOIN res ON res.q = dec.q GROUP BY ALL",
    "hybrid_results": f"{_HYBRID} SELECT q, key AS doc_id, round(score, 6) AS score, rank FROM res",
    "extractive_answer": f"{_HYBRID} SELECT dec.q, confidence >= 0.15 AS answered, sha256(CASE WHEN confidence >= 0.15 THEN {O.excerpt('text')} ELSE {_MSG} END) AS answer_sha256, 'local-extractive+' || mode AS mode FROM dec LEFT JOIN res ON res.q = dec.q AND res.rank = 1 LEFT JOIN documents ON doc_id = key",
    "source_dedupe": f"WITH {O.bm25('documents', _ITEMS, X.DEPTH)} SELECT * FROM (SELECT q, source, first, row_number() OVER (PARTITION BY q ORDER BY first) AS place FROM (SELECT q, source, min(rank) AS first FROM best JOIN documents ON doc_id = key GROUP BY q, source)) WHERE place <= 3",
    "prompt_context": f"""WITH {O.bm25('documents', _ITEMS, X.DEPTH)} SELECT q, CAST(length(c) AS BIGINT) AS n_chars, sha256(c) AS context_sha256 FROM (SELECT q, string_agg('SOURCE ' || rank || chr(10) || 'Title: ' || source || chr(10) || 'Section: ' || lang || chr(10) || 'URL: doc:' || key || chr(10) || 'Content:' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS c
      FROM best JOIN documents ON doc_id = key WHERE rank <= 5 GROUP BY q)""",
}
