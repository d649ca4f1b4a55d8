"""Whole jobs on a small site."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import jobs, vector
from corvane.sources import readers

SITE = {
    "https://h.org/": '<title>Home</title><body><p>Welcome to the home page of all things.</p><a href="/en/a/">a</a><a href="b?x=1#y">b</a><a href="/x.PDF#p">p</a><a href="https://other.org/">o</a><a href="/feed/">f</a></body>',
    "https://h.org/en/a/": '<title>Tuition</title><body><h1>Fees</h1><p>The tuition fee of the computer science programme is listed here.</p><a href="/gone/">g</a><a href="/">home</a></body>',
    "https://h.org/b/": '<title>B</title><body><h2>Contact</h2><p>The contact address of the office is listed on this page.</p><a href="/forbidden/x/">n</a><a href="/en/a/">a</a></body>',
    "https://h.org/forbidden/x/": "<body>never</body>",
}


def fetch(urls):
    spark = urls.sparkSession
    known = spark.createDataFrame(list(SITE.items()), "url string, html string")
    return urls.join(known, "url", "left").withColumn("error", F.when(F.col("html").isNull(), "404"))


def crawled(spark, most=10):
    rules = spark.createDataFrame([("h.org", "/forbidden/", False)], "host string, prefix string, allow boolean")
    start = spark.createDataFrame([("https://h.org",)], "url string")
    return jobs.crawl_site(start, fetch, ["h.org"], most, rules)


def test_crawl(spark):
    got = crawled(spark)
    assert {(r["url"], r["level"], r["language"]) for r in got.pages.collect()} == {("https://h.org/", 0, "pl"), ("https://h.org/en/a/", 1, "en"), ("https://h.org/b/", 1, "pl")}
    assert [r["url"] for r in got.pdfs.collect()] == ["https://h.org/x.PDF"]
    assert {tuple(r) for r in got.errors.collect()} == {("https://h.org/gone/", "404")}
    assert crawled(spark, 2).pages.count() == 2


def test_build_index_and_ask(spark, tmp_path):
    pages = crawled(spark).pages
    before = spark.createDataFrame([("https://h.org/", "stale"), ("https://h.org/old/", "x")], "url string, content_hash string")
    built = jobs.build_chunks(pages.unionByName(pages.limit(1).withColumn("url", F.lit("u")).withColumn("markdown", F.lit(" "))), before, F.lit("2026-01-01T00:00:00+00:00"))
    assert {r["status"]: r["n"] for r in built.report.collect()} == {"changed": 1, "new": 2, "deleted": 1}
    jobs.write_build(built, str(tmp_path))
    assert readers.state(spark, f"{tmp_path}/state").count() == 3
    chunks = readers.chunks(spark, f"{tmp_path}/chunks")
    assert {"Tuition > Fees", "B > Contact"} <= {r["section"] for r in chunks.collect()}

    embedder = vector.HashEmbedder(64)
    at = jobs.index_chunks(spark, chunks, f"{tmp_path}/index", embedder, 64)
    again = jobs.index_chunks(spark, chunks, f"{tmp_path}/index", embedder, 64)
    stored = spark.read.parquet(again)
    assert stored.count() == spark.read.parquet(at).count() == chunks.count()

    asked = spark.createDataFrame([(1, "What is the computer science tuition fee?", "English"), (2, "Wo ist der Mond?", "Deutsch")], "q long, question string, language string")
    settings = readers.Settings(embedding_dimensions=64)
    for service in (jobs.Service(stored, settings), jobs.Service(stored, settings, embedder)):
        got = {r["q"]: r for r in service.ask(asked).collect()}
        assert got[1]["answered"] and "tuition fee" in got[1]["text"] and got[1]["sources"][0]["url"] == "https://h.org/en/a/"
        assert not got[2]["answered"] and got[2]["sources"] == [] and got[2]["text"].startswith("I could not find")


def site(pages):
    def get(urls):
        known = urls.sparkSession.createDataFrame([(f"https://h.org{u}", "<body><p>A page of this site.</p>" + "".join(f'<a href="{x}">x</a>' for x in to) + "</body>") for u, to in pages.items()], "url string, html string")
        return urls.join(known, "url", "left").withColumn("error", F.when(F.col("html").isNull(), "404"))

    return get


def test_failures_leave_the_rest_of_a_level_queued(spark):
    pages = {"/": [f"/p{k}/" for k in range(9)]} | {f"/p{k}/": ["/a/"] for k in range(3, 9)} | {"/a/": []}
    start = spark.createDataFrame([("https://h.org/",)], "url string")
    got = jobs.crawl_site(start, site(pages), ["h.org"], 5)
    assert {(r["url"], r["level"]) for r in got.pages.collect()} == {("https://h.org/", 0)} | {(f"https://h.org/p{k}/", 1) for k in range(3, 7)}
    assert {r["url"] for r in got.errors.collect()} == {f"https://h.org/p{k}/" for k in range(3)}


def test_rounds_that_do_not_suffice(spark):
    start = spark.createDataFrame([("https://h.org/",)], "url string")
    chain = {"/": ["/c1/"], "/c1/": ["/c2/"], "/c2/": ["/c3/"], "/c3/": []}
    with pytest.raises(RuntimeError):
        jobs.crawl_site(start, site(chain), ["h.org"], 9, rounds=2)
    assert jobs.crawl_site(start, site(chain), ["h.org"], 9).pages.count() == 4
