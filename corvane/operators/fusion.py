"""Fusion of ranked lists, gates, and answers made of what was found."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import lexicon as X
from corvane.functions import text as T
from corvane.runtime import cut


def fuse(vector: DataFrame, lexical: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """Weighted reciprocal-rank fusion of two lists (q, rank, keys...).

    A key's score is the sum of weight / (60 + rank) over all its places, to six digits; ties keep the order of first
    appearance, the vector list before the other. Returns q, keys, score, rank.
    """
    both = vector.select("q", "rank", *keys, F.lit(0).alias("list")).unionByName(lexical.select("q", "rank", *keys, F.lit(1).alias("list")))
    weight = F.when(F.col("list") == 0, F.lit(X.RRF_VECTOR)).otherwise(F.lit(X.RRF_LEXICAL))
    merged = both.groupBy("q", *keys).agg(F.sum(weight / (X.RRF_K + F.col("rank"))).alias("total"), F.min(F.struct("list", F.col("rank").alias("at"))).alias("first"))
    order = W.partitionBy("q").orderBy(F.round("total", 12).desc(), "first.list", "first.at")
    out = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("q", *keys, F.round("total", 6).alias("score"), "rank")


def hybrid(questions: DataFrame, lexical: DataFrame, vector: DataFrame | None, k: int = X.TOP_K, threshold: float = X.CONFIDENCE, similar: float = X.SIMILARITY, failed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Decides for every question (q) between the lists, which reach to depth max(k, 10).

    Returns decisions (q, confidence, retrieval_score, mode, answered) and results (q, key, score, rank).
    """
    # the lists hold k rows a question and are used in several places: they are made once
    lexical, vector = cut(lexical), None if vector is None or failed else cut(vector)
    best = lexical.where("rank = 1").select("q", F.col("score").alias("best"))
    if vector is None:
        mode = "bm25-vector-fallback" if failed else "bm25"
        facts = questions.select("q").join(best, "q", "left").withColumn("top", F.lit(None).cast("double")).withColumn("fused", F.lit(False)).withColumn("mode", F.lit(mode))
    else:
        top = vector.groupBy("q").agg(F.max("similarity").alias("top"))
        facts = questions.select("q").join(best, "q", "left").join(top, "q", "left")
        facts = facts.withColumn("fused", F.coalesce(F.col("top") >= similar, F.lit(False)))
        facts = facts.withColumn("mode", F.when(F.col("fused"), "hybrid-pgvector-bm25").otherwise("bm25"))
    score = F.coalesce("best", F.lit(0.0))
    facts = facts.withColumn("confidence", F.when(F.col("fused"), F.greatest(T.confidence(score), F.col("top"))).otherwise(T.confidence(score)))
    facts = facts.withColumn("retrieval_score", F.round(F.when(F.col("fused"), F.col("top")).otherwise(score), 4)).withColumn("answered", F.col("confidence") >= threshold)
    kept = facts.where("answered").select("q", "fused")
    plain = lexical.join(kept.where("not fused").select("q"), "q", "left_semi").where(F.col("rank") <= k).select("q", "key", "score", "rank")
    if vector is None:
        return facts.select("q", "confidence", "retrieval_score", "mode", "answered"), plain
    own = kept.where("fused").select("q")
    fused = fuse(vector.join(own, "q", "left_semi"), lexical.join(own, "q", "left_semi"), k, ["key"])
    return facts.select("q", "confidence", "retrieval_score", "mode", "answered"), plain.unionByName(fused.select("q", "key", "score", "rank"))


def answers(decisions: DataFrame, results: DataFrame, texts: DataFrame, language: Column, generator: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Decisions with `answer` and the full mode: an excerpt of the best chunk, or what an injected generator gives.

    texts: key, text. generator: takes (q, rank, key, text) and returns (q, answer); where it has no answer, the excerpt
    stands in and the mode says so.
    """
    best = results.where("rank = 1").join(texts, "key").select("q", T.excerpt(F.col("text")).alias("excerpt"))
    out = decisions.join(best, "q", "left")
    if generator is None:
        made, mode = F.col("excerpt"), F.concat(F.lit("local-extractive+"), F.col("mode"))
    else:
        out = out.join(generator(results.join(texts, "key").select("q", "rank", "key", "text")), "q", "left")
        made = F.coalesce("answer", "excerpt")
        mode = F.concat(F.when(F.col("answer").isNull() & F.col("answered"), F.lit("local-extractive-after-provider-error+")).otherwise(F.lit("generated+")), F.col("mode"))
    return out.select("q", "confidence", "retrieval_score", "answered", F.when(F.col("answered"), made).otherwise(T.not_found(language)).alias("text"), mode.alias("full_mode"))


def distinct_sources(results: DataFrame, source: str, k: int = 3) -> DataFrame:
    """q, source, first (the best rank it has), place: the first k sources of every question."""
    first = results.groupBy("q", source).agg(F.min("rank").alias("first"))
    return first.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy("first"))).where(F.col("place") <= k)


def prompt_context(results: DataFrame, title: str, section: str, url: str, text: str) -> DataFrame:
    """q, context: the results in order, as numbered sources. Each question's results are bounded by its k."""
    part = F.concat_ws("\n", F.concat(F.lit("SOURCE "), F.col("rank").cast("string")), F.concat(F.lit("Title: "), F.col(title)), F.concat(F.lit("Section: "), F.col(section)), F.concat(F.lit("URL: "), F.col(url)), F.lit("Content:"), F.col(text))
    parts = F.array_sort(F.collect_list(F.struct("rank", part.alias("part"))))
    return results.groupBy("q").agg(F.array_join(F.transform(parts, lambda p: p["part"]), "\n\n---\n\n").alias("context"))
