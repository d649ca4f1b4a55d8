"""Whole jobs made of the operators: crawling, building chunks, indexing them, and answering."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import html as H
from corvane.functions import text as T
from corvane.functions import urls as U
from corvane.operators import bm25, bm25_store, chunk, clean, crawl, fusion, state, vector
from corvane.runtime import cut
from corvane.sources import keyed_table, readers, sinks
from corvane.sources.readers import Settings

#: Fetches pages: takes (url) and returns (url, html, error), error null where the page came.
Fetch = Callable[[DataFrame], DataFrame]


@dataclass
class Crawl:
    """What a crawl gives: pages (url, title, language, markdown, level), pdfs (url) and errors (url, error)."""

    pages: DataFrame
    pdfs: DataFrame
    errors: DataFrame


def crawl_site(start: DataFrame, fetch: Fetch, domains: list[str], most: int, rules: DataFrame | None = None, rounds: int | None = None) -> Crawl:
    """Breadth-first over the links of fetched pages, level by level, up to `most` pages that came.

    start: url. Rules with a `place` (crawl.robots_rules()) are read in their order, others by the longest prefix. URLs are normalised; those that rules forbid, that were tried in an earlier level, that are foreign or skipped, aren't
    fetched. A failed URL may be tried again when a later page links to it. Within a level the order of URLs decides who fits the budget;
    the others stay queued before the links that are found meanwhile, so what failures leave of the budget goes to them. A page's level
    is the number of links that lead to it. The crawl ends with the budget or the queue; given `rounds` that don't suffice are an error.
    """
    spark = start.sparkSession
    todo = cut(start.select(U.normalize(F.col("url")).alias("url"), F.lit(0).alias("level")).distinct())
    done = spark.createDataFrame([], "url string, title string, language string, markdown string, level int")
    pdfs, errors = spark.createDataFrame([], "url string"), spark.createDataFrame([], "url string, error string")
    have = 0
    turn = 0
    while have < most and not todo.isEmpty():
        if turn == rounds:
            raise RuntimeError(f"after {rounds} rounds the crawl has budget and URLs left")
        turn += 1
        if rules is not None:
            judge = crawl.allowed_in_order if "place" in rules.columns else crawl.allowed_by_rules
            todo = judge(todo, "url", rules).where("allowed").select("url", "level")
        # one request at most for each page that the budget still has
        asked = cut(todo.orderBy("level", "url").limit(most - have))
        rest = todo.join(asked.select("url"), "url", "left_anti")
        got = cut(fetch(asked.select("url")).join(asked, "url"))
        errors = errors.unionByName(got.where("error is not null").select("url", "error"))
        came = cut(got.where("error is null").select("url", "level", H.page(F.col("html")).alias("page")))
        made = clean.clean_text(came.select("url", "level", "page.title", U.language(F.col("url")).alias("language"), F.col("page.markdown").alias("_md")), "_md", "markdown")
        new = cut(made.select("url", "title", "language", "markdown", "level"))
        links = came.select(F.col("url").alias("base"), (F.col("level") + 1).alias("level"), F.explode("page.links").alias("href")).select(U.resolve(F.col("base"), F.col("href")).alias("link"), "level").distinct()
        routed = cut(crawl.route(links, "link", domains).where("route in ('pdf', 'page')").groupBy("route", "target").agg(F.min("level").alias("level")))
        pdfs = pdfs.unionByName(routed.where("route = 'pdf'").select(F.col("target").alias("url")))
        done = cut(done.unionByName(new))
        have = done.count()
        linked = routed.where("route = 'page'").select(F.col("target").alias("url"), "level")
        todo = cut(rest.unionByName(linked).groupBy("url").agg(F.min("level").alias("level")).join(done.select("url"), "url", "left_anti"))
    return Crawl(done, pdfs.distinct(), errors)


@dataclass
class Build:
    """documents, chunks, the new state (url, content_hash) and counts by status."""

    documents: DataFrame
    chunks: DataFrame
    state: DataFrame
    report: DataFrame


def build_chunks(pages: DataFrame, before: DataFrame, updated: Column | None = None) -> Build:
    """Pages (url, title, language, markdown) as documents and chunk records, and what changed since the state `before`.

    Blank pages go, and are in no state either. `updated` is one value for the whole run.
    """
    updated = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX") if updated is None else updated
    kept = pages.where(T.strip(F.coalesce("markdown", F.lit(""))) != "").withColumn("content_hash", chunk.page_hash(F.col("markdown")))
    documents = kept.select("url", "title", "language", "markdown", updated.alias("last_modified"), "content_hash")
    rows = chunk.chunk_pages(kept, "url", "title", "markdown")
    chunks = chunk.chunk_records(rows, F.col("url"), F.col("title"), F.col("language"), F.col("markdown"), updated).drop("seq")
    now = kept.select("url", "content_hash")
    return Build(documents, chunks, now, state.report(state.changes(now, before, "url", "content_hash")))


def write_build(built: Build, folder: str) -> None:
    """The outputs of a run; the state comes last, so a run that fails is done again."""
    sinks.documents(built.documents, f"{folder}/documents")
    sinks.json_lines(built.chunks, f"{folder}/chunks")
    sinks.json_lines(built.report, f"{folder}/report")
    sinks.crawl_state(built.state, f"{folder}/state")


def index_chunks(spark: SparkSession, chunks: DataFrame, path: str, embedder: Callable[[list[str]], list[list[float]]], dimension: int, only_new: bool = False) -> str | None:
    """Embeds chunk records and merges them into the vector table under `path` by their hash; returns the new version's path.

    Of records of one hash the last by `ord` wins; where chunks have no such column, any of them. only_new: embeds only records whose
    hash isn't stored yet, so a job that was broken off goes on where it was; if there are none, nothing is written and the newest path returned.
    """
    key = chunk.chunk_hash(*[F.col(c) for c in ("url", "title", "section", "language", "text")])
    ord = F.col("ord") if "ord" in chunks.columns else F.monotonically_increasing_id().alias("ord")
    rows = chunks.select("url", "title", "section", "faculty", "language", "text", chunk.sparse_metadata(F.col("lastUpdated"), F.col("source")).alias("metadata"), key.alias("content_hash"), ord)
    rows = state.last_wins(rows, "content_hash", "ord").withColumn("ord", F.lit(0))
    stored = sinks.newest(spark, path)
    if only_new and stored is not None:
        rows = cut(rows.join(spark.read.parquet(stored).select("content_hash"), "content_hash", "left_anti"))
        if rows.isEmpty():
            return stored
    text = vector.embedding_text(F.col("title"), F.col("section"), F.col("faculty"), F.col("text"))
    return sinks.upsert_table(spark, path, vector.embed(rows, text, embedder, dimension), "content_hash", "ord")


def sync_chunks(spark: SparkSession, built: Build, before: DataFrame, folder: str, run: int) -> dict[str, int]:
    """Brings the chunk store and the index under `folder` up to date with a build; returns how many chunks came and went.

    before: the state of the last run (url, content_hash). Only pages that are new, changed or gone are touched: their stored chunks that the
    build doesn't have any more are deleted from the store (a table by key, parted by URL) and from the index, the others are merged. run: a number that
    grows from run to run; one that comes again changes nothing.
    """
    store, index = keyed_table.KeyedTable(spark, f"{folder}/chunks", by="url"), bm25_store.Store(spark, f"{folder}/index")
    changed = cut(state.changes(built.state, before, "url", "content_hash").where("status <> 'unchanged'").select("url"))
    key = chunk.chunk_hash(*[F.col(c) for c in ("url", "title", "section", "language", "text")])
    new = built.chunks.join(changed, "url", "left_semi").select(key.alias("chunk_hash"), "url", "title", "section", "faculty", "language", "text", F.lit(run).cast("long").alias("run"))
    new = cut(new.dropDuplicates(["chunk_hash"]))
    held = store.rows_of(changed)
    stale = None
    if held is not None:
        stale = cut(held.join(new.select("chunk_hash"), "chunk_hash", "left_anti").select(new.columns).withColumn("run", F.lit(run).cast("long")))
    rows = new.withColumn("gone", F.lit(False))
    if stale is not None:
        rows = rows.unionByName(stale.withColumn("gone", F.lit(True)))
    store.merge(rows, "chunk_hash", "run", deleted="gone", batch=("run", run))
    # the store has the run now; the index takes over what it says of these pages, so a run that broke off between the two is made good by the next call
    live = store.rows_of(changed)
    tokens = bm25.token_table(live.withColumn("ord", F.col("chunk_hash")), "chunk_hash", "ord", [F.col("text")], [F.col("title"), F.col("section"), F.col("faculty")], F.col("language"))
    gone = None if stale is None else stale.select(F.col("chunk_hash").alias("key"))
    index.update(tokens, gone)
    return {"came": new.count(), "went": 0 if stale is None else stale.count()}


class Service:
    """Answers questions over stored chunks (url, title, section, faculty, language, text, content_hash, embedding)."""

    def __init__(self, chunks: DataFrame, settings: Settings, embedder: Callable | None = None, generator: Callable[[DataFrame], DataFrame] | None = None, index: str | None = None):
        """index: a folder for the postings of the chunks, which are then made once; an index that lies there is taken as it is."""
        self.chunks, self.settings, self.embedder, self.generator = chunks, settings, embedder, generator
        meta = [F.col("title"), F.col("section"), F.col("faculty")]
        self.tokens = bm25.token_table(chunks, "content_hash", "content_hash", [F.col("text")], meta, F.col("language"))
        self.index = None
        if index is not None:
            there = readers.exists(chunks.sparkSession, f"{index}/stats")
            self.index = bm25.open_index(chunks.sparkSession, index) if there else bm25.write_index(self.tokens, index)

    def ask(self, questions: DataFrame) -> DataFrame:
        """questions (q, question, language) to q, text, confidence, retrieval_score, answered, full_mode, sources (up to 3 of title and url)."""
        s = self.settings
        depth = max(s.top_k, 10)
        terms = bm25.query_terms(questions, language="language")
        if self.index is None:
            found = bm25.search(self.tokens, terms, depth, by_language=True)
        else:
            found = bm25.search_index(questions.sparkSession, self.index, terms, depth, by_language=True)
        lexical = found.select("q", "key", "score", "rank")
        close = None
        if self.embedder is not None:
            asked = vector.embed(questions.select("q", "question", T.language_code(F.col("language")).alias("language")), F.col("question"), self.embedder, s.embedding_dimensions)
            close = vector.nearest(self.chunks, asked.withColumnRenamed("embedding", "vector"), depth, "content_hash", "embedding", same="language")
        decisions, results = fusion.hybrid(questions, lexical, close, s.top_k, s.confidence_threshold, s.vector_similarity_threshold)
        texts = self.chunks.select(F.col("content_hash").alias("key"), "text", "url", "title")
        said = fusion.answers(decisions.join(questions.select("q", "language"), "q"), results, texts.select("key", "text"), F.col("language"), self.generator)
        found = results.join(texts, "key")
        sources = fusion.distinct_sources(found, "url").join(found.select("q", "url", "title", F.col("rank").alias("first")), ["q", "url", "first"])
        sources = sources.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "title", "url"))).alias("s"))
        return said.join(sources, "q", "left").withColumn("sources", F.coalesce(F.transform("s", lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"))), F.array().cast("array<struct<title:string,url:string>>"))).drop("s")
