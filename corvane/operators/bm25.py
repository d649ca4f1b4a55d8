"""BM25 search over text chunks, for many questions at once.

Corpus statistics come from all chunks, before any language filter; chunks without tokens count too. Chunks can be
searched as they are (search): then tokens are matched with the questions' distinct terms inside the scan and counted
within tasks, and only the postings of these terms are exchanged. Or they are indexed once (write_index): each chunk becomes
one row of its distinct terms with their counts, beside which document frequencies are stored. A search (search_index) sends
the questions' terms to the scan of these rows, where each task scores its own chunks and keeps the best of each question, so
neither building nor searching exchanges postings, and no text is read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import lexicon as X
from corvane.functions import text as T
from corvane.operators import best
from corvane.runtime import cut, ship

#: What makes two chunks one.
SAME = ("key", "ord", "language", "dl")
#: Questions that go to the tasks at once; more are taken in blocks.
BLOCK = 2_000


def token_table(chunks: DataFrame, key: str, ord: str, body: list[Column], meta: list[Column] | None = None, language: Column | None = None) -> DataFrame:
    """key, ord, language, dl (tokens of metadata and body), tokens and meta tokens of every chunk."""
    meta = meta or []
    return chunks.select(
        F.col(key).alias("key"),
        F.col(ord).alias("ord"),
        (T.casefold(language) if language is not None else F.lit("")).alias("language"),
        T.tokens(T.join_parts(" ", *meta, *body)).alias("tokens"),
        (T.tokens(T.join_parts(" ", *meta)) if meta else F.array().cast("array<string>")).alias("meta"),
    ).withColumn("dl", F.size("tokens").cast("long"))


def term_frequency(tokens: DataFrame) -> DataFrame:
    """key, term, tf. A chunk counts its own terms; only chunks whose key is not theirs alone are exchanged."""
    own = counted(tokens).select("key", F.explode(F.arrays_zip("terms", "tf")).alias("x")).select("key", F.col("x.terms").alias("term"), F.col("x.tf").cast("long").alias("tf"))
    again = repeated(tokens, "key")
    if again is None:
        return own
    return _without(own, again, "key").unionByName(_within(own, again, "key").groupBy("key", "term").agg(F.sum("tf").alias("tf")))


def document_frequency(tokens: DataFrame) -> DataFrame:
    """term, df: each chunk counts a term once, so nothing but the term is exchanged."""
    return tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """One row: n chunks, avgdl (0 without chunks)."""
    return tokens.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def query_terms(questions: DataFrame, q: str = "q", question: str = "question", language: str | None = None) -> DataFrame:
    """q, code (the normalised language, empty for any), term: the expanded terms of every question."""
    code = T.language_code(F.col(language)) if language else F.lit("")
    return questions.select(F.col(q).alias("q"), code.alias("code"), F.explode(T.expand(T.tokens(F.col(question)))).alias("term"))


def _each(tokens: DataFrame) -> DataFrame:
    """One row for each token of a chunk, in its text (tf) or its metadata (mtf)."""
    one = F.concat(F.transform("tokens", lambda t: F.struct(t.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("mtf"))), F.transform("meta", lambda t: F.struct(t.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("mtf"))))
    return tokens.select("key", "ord", "language", "dl", F.explode(one).alias("x")).select("key", "ord", "language", "dl", "x.term", "x.tf", "x.mtf")


def _counted(each: DataFrame) -> DataFrame:
    return each.groupBy("key", "ord", "language", "dl", "term").agg(F.sum("tf").alias("tf"), F.sum("mtf").alias("mtf"))


def search(tokens: DataFrame, terms: DataFrame, k: int, by_language: bool = False) -> DataFrame:
    """q, key, ord, score, rank: the k best chunks of every question, ties by ord. Scores are over 0."""
    stats = corpus_stats(tokens)
    n, avgdl = stats.select(F.col("n").cast("double")).scalar(), stats.select("avgdl").scalar()
    postings = _counted(_each(tokens).join(terms.select("term").distinct(), "term", "left_semi"))
    return _best(postings, n, avgdl, tokens.select("language").distinct(), terms, k, by_language)


def _best(postings: DataFrame, n: Column, avgdl: Column, languages: DataFrame, terms: DataFrame, k: int, by_language: bool) -> DataFrame:
    """Ranks the postings of the questions' terms."""
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return _ranked(_scores(postings, df, n, avgdl, languages, terms, by_language), k).where("score > 0")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("q").orderBy(F.round("score", 9).desc(), "ord")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scores(postings: DataFrame, df: DataFrame, n: Column, avgdl: Column, languages: DataFrame, terms: DataFrame, by_language: bool) -> DataFrame:
    """q, key, ord, score of all postings, by an exchange."""
    hits = postings.join(df, "term").join(terms, "term")
    if by_language:
        # a question's language counts only if some chunk has it
        have = languages.join(terms.select("code").distinct(), F.startswith("language", "code")).select("code").distinct().withColumn("there", F.lit(True))
        hits = hits.join(have, "code", "left").where(F.col("there").isNull() | F.startswith("language", "code"))
    idf = F.ln(1.0 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    soft = F.col("tf") * (X.BM25_K1 + 1) / (F.col("tf") + X.BM25_K1 * (1 - X.BM25_B + X.BM25_B * F.col("dl") / F.greatest(avgdl, F.lit(1.0))))
    return hits.groupBy("q", "key", "ord").agg(F.sum(idf * soft + X.META_BOOST * F.col("mtf")).alias("score"))


def counted(tokens: DataFrame) -> DataFrame:
    """key, ord, language, dl, terms (distinct, in order), tf and mtf (how often each is in text and metadata) of every chunk."""

    def of(s: Column) -> Column:
        return T.let(F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull()), lambda at: made(s, at))

    def made(s: Column, at: Column) -> Column:
        terms = F.transform(at, lambda i: F.get(s, i))
        tf = F.transform(at, lambda i, j: F.coalesce(F.get(at, j + 1), F.size(s)) - i)
        in_meta = F.transform(at, lambda i: F.size(F.filter("meta", lambda m: m == F.get(s, i))))
        return F.struct(F.size(s).cast("long").alias("dl"), terms.alias("terms"), tf.alias("tf"), F.when(F.size("meta") == 0, F.transform(at, lambda i: F.lit(0))).otherwise(in_meta).alias("mtf"))

    return tokens.withColumn("_c", T.let(F.sort_array("tokens"), of)).select("key", "ord", "language", "_c.dl", "_c.terms", "_c.tf", "_c.mtf")


def repeated(rows: DataFrame, *by: str) -> DataFrame | None:
    """The values of these columns that several rows have; None if there are none."""
    again = cut(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    return None if again.isEmpty() else again


def _on(again: DataFrame, rows: DataFrame, by: tuple[str, ...]) -> tuple[DataFrame, Column]:
    other = again.toDF(*[f"_{c}" for c in by])
    return other, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])


def _without(rows: DataFrame, again: DataFrame, *by: str) -> DataFrame:
    return rows.join(*_on(again, rows, by), "left_anti")


def _within(rows: DataFrame, again: DataFrame, *by: str) -> DataFrame:
    return rows.join(*_on(again, rows, by), "left_semi")


def _merged(rows: DataFrame) -> DataFrame:
    """Rows of counted() that agree in SAME as one, with the sums of their counts."""
    x = F.explode(F.arrays_zip("terms", "tf", "mtf")).alias("x")
    each = rows.select(*SAME, x).groupBy(*SAME, F.col("x.terms").alias("term")).agg(F.sum("x.tf").cast("int").alias("tf"), F.sum("x.mtf").cast("int").alias("mtf"))
    lists = each.groupBy(*SAME).agg(F.sort_array(F.collect_list(F.struct("term", "tf", "mtf"))).alias("x"))
    return lists.select(*SAME, F.col("x.term").alias("terms"), F.col("x.tf").alias("tf"), F.col("x.mtf").alias("mtf"))


@dataclass(frozen=True)
class Index:
    """A stored index: its folder, what holds for all chunks, and whether several chunks have one key; these lie apart (folder repeated, the others in single)."""

    path: str
    n: int
    avgdl: float
    apart: bool


def write_index(tokens: DataFrame, path: str) -> Index:
    """Stores the chunks of a token table with their counted terms under `path`, with document frequencies, languages and statistics; the statistics come last."""
    spark = tokens.sparkSession
    counted(tokens).write.mode("overwrite").parquet(f"{path}/chunks")
    rows = spark.read.parquet(f"{path}/chunks")
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl")).first()
    rows.select("language").distinct().write.mode("overwrite").parquet(f"{path}/languages")
    again = repeated(rows, "key", "ord")
    if again is not None:
        _without(rows, again, "key", "ord").write.mode("overwrite").parquet(f"{path}/single")
        _merged(_within(rows, again, "key", "ord")).write.mode("overwrite").parquet(f"{path}/repeated")
        rows = spark.read.parquet(f"{path}/single", f"{path}/repeated")
    rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.mode("overwrite").parquet(f"{path}/frequencies")
    told = spark.createDataFrame([(got["n"], float(got["avgdl"]), again is not None)], "n long, avgdl double, apart boolean")
    told.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    told = spark.read.parquet(f"{path}/stats").first()
    return Index(path, told["n"], told["avgdl"], told["apart"])


def search_index(spark: SparkSession, index: Index, terms: DataFrame, k: int, by_language: bool = False) -> DataFrame:
    """As search(), from a stored index: no text is read, and no postings are exchanged but those of keys that several chunks have."""
    rows, df, languages = (spark.read.parquet(f"{index.path}/{what}") for what in ("single" if index.apart else "chunks", "frequencies", "languages"))
    several = spark.read.parquet(f"{index.path}/repeated") if index.apart else None
    return best_rows(rows, df, index.n, index.avgdl, languages, terms, k, by_language, several)


def best_rows(rows: DataFrame, df: DataFrame, n: int, avgdl: float, languages: DataFrame, terms: DataFrame, k: int, by_language: bool = False, several: DataFrame | None = None, most: int = BLOCK) -> DataFrame:
    """As search(), from rows of counted() whose keys (with ord) differ, and df (term, df); several: rows of other keys that differ in SAME only.

    Beyond `most` questions the rows are read once for each block of these.
    """
    ship(rows.sparkSession)
    blocks = max(1, -(-terms.select("q").distinct().count() // most))
    parts = [terms if blocks == 1 else terms.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b) for b in range(blocks)]
    found = reduce(DataFrame.unionByName, [_best_of_block(rows, df, n, avgdl, languages, part, k, by_language) for part in parts])
    if several is not None:
        postings = several.select(*SAME, F.explode(F.arrays_zip("terms", "tf", "mtf")).alias("x")).select(*SAME, F.col("x.terms").alias("term"), "x.tf", "x.mtf")
        found = found.unionByName(_scores(postings, df, F.lit(float(n)), F.lit(avgdl), languages, terms, by_language))
    return _ranked(found, k)


def _best_of_block(rows: DataFrame, df: DataFrame, n: int, avgdl: float, languages: DataFrame, terms: DataFrame, k: int, by_language: bool) -> DataFrame:
    """q, key, ord, score: what each task holds for the best of its own rows."""
    spark = rows.sparkSession
    asked = terms.join(df, "term").select("q", "code", "term", "df").collect()  # the terms of a block of questions
    have: set = set()
    if by_language:
        # a question's language counts only if some chunk has it
        have = {r["code"] for r in languages.join(terms.select("code").distinct(), F.startswith("language", "code")).select("code").distinct().collect()}
    numbers: dict = {}
    for r in asked:
        numbers.setdefault(r["q"], len(numbers))
    names = sorted({r["term"] for r in asked})
    place = {t: i for i, t in enumerate(names)}
    codes = sorted(have)
    entries = sorted((place[r["term"]], numbers[r["q"]], codes.index(r["code"]) if r["code"] in have else len(codes)) for r in asked)
    idf = np.zeros(len(names))
    for r in asked:
        idf[place[r["term"]]] = math.log(1.0 + (n - r["df"] + 0.5) / (r["df"] + 0.5))
    term, question, code = (np.array([e[c] for e in entries], np.int64) for c in range(3))
    first = np.searchsorted(term, np.arange(len(names) + 1))
    sent = spark.sparkContext.broadcast((names, idf, first, question, code, codes, len(numbers)))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("key", "ord")}
    found = rows.select("key", "ord", "language", "dl", "terms", "tf", "mtf").mapInArrow(_scorer(sent, max(avgdl, 1.0), k), f"i int, key {kinds['key']}, ord {kinds['ord']}, score double")
    questions = spark.createDataFrame([(i, q) for q, i in numbers.items()], f"i int, q {terms.schema['q'].dataType.simpleString()}")
    return found.join(F.broadcast(questions), "i").select("q", "key", "ord", "score")


def _scorer(sent, avgdl: float, k: int):
    """Scores batches of rows for all questions; yields the best of each question once, at the end of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, idf, first, question, code, codes, width = sent.value
        if not width:
            return
        wanted, many = pa.array(names, pa.string()), np.diff(first)
        kept, floor = None, np.full(width, -np.inf)
        for whole in batches:
            for a in range(0, whole.num_rows, max(1, best.CELLS // width)):
                b = whole.slice(a, max(1, best.CELLS // width))
                size = pc.list_value_length(b.column(4)).to_numpy(zero_copy_only=False)
                at = pc.fill_null(pc.index_in(b.column(4).flatten().cast(pa.string()), value_set=wanted), -1).to_numpy(zero_copy_only=False)
                hit = np.flatnonzero(at >= 0)
                row, at = np.repeat(np.arange(b.num_rows), size)[hit], at[hit]
                tf, mtf = (b.column(c).flatten().to_numpy(zero_copy_only=False)[hit].astype(np.float64) for c in (5, 6))
                dl = b.column(3).to_numpy(zero_copy_only=False).astype(np.float64)[row]
                worth = idf[at] * (tf * (X.BM25_K1 + 1) / (tf + X.BM25_K1 * (1 - X.BM25_B + X.BM25_B * dl / avgdl))) + X.META_BOOST * mtf
                # each hit once for every question that has its term
                times = many[at]
                entry = np.arange(int(times.sum())) + np.repeat(first[at] - np.cumsum(times) + times, times)
                row, worth = np.repeat(row, times), np.repeat(worth, times)
                if codes:
                    may = np.stack([pc.fill_null(pc.starts_with(b.column(2), c), False).to_numpy(zero_copy_only=False) for c in codes] + [np.ones(b.num_rows, bool)], axis=1)
                    own = may[row, code[entry]]
                    entry, row, worth = entry[own], row[own], worth[own]
                score = np.bincount(row * width + question[entry], worth, b.num_rows * width).reshape(b.num_rows, width)
                if b.num_rows > k:
                    floor = np.maximum(floor, np.partition(score, b.num_rows - k, axis=0)[b.num_rows - k])
                row, of = np.nonzero((score > 0) & (score >= floor - best.NEAR))
                if len(row):
                    take = pa.array(row)
                    new = pa.table({"i": pa.array(of, pa.int32()), "key": b.column(0).take(take), "ord": b.column(1).take(take), "score": score[row, of]})
                    kept, floor = best.keep(new if kept is None else pa.concat_tables([kept, new]), k, floor)
        if kept is not None:
            yield from kept.combine_chunks().to_batches()

    return run


def gate(best: DataFrame, questions: DataFrame, language: Column, threshold: float = X.CONFIDENCE) -> DataFrame:
    """q, confidence, answered, message of every question, from its best score; refused below the threshold."""
    top = best.where("rank = 1").select("q", "score")
    conf = T.confidence(F.coalesce("score", F.lit(0.0)))
    out = questions.join(top, "q", "left").withColumn("confidence", conf)
    return out.select("q", "confidence", (F.col("confidence") >= threshold).alias("answered"), F.when(F.col("confidence") < threshold, T.not_found(language)).alias("message"))
