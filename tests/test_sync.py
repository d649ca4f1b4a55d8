"""Whole runs over edited and vanished pages, rules of robots.txt in a crawl, sections in linear time, and case folding."""

import time

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import bm25, chunk, crawl, jobs
from corvane.operators.bm25_store import Store
from corvane.sources.keyed_table import KeyedTable
from tests.test_jobs import site

PAGES = "url string, title string, language string, markdown string"


def pages(spark, **texts):
    return spark.createDataFrame([(f"https://h.org/{u}/", u.title(), "en", t) for u, t in texts.items()], PAGES)


def built(spark, rows, before):
    return jobs.build_chunks(rows, before, F.lit("2026-01-01T00:00:00+00:00"))


def test_edits_and_deletions_leave_no_stale_chunk(spark, tmp_path):
    none = spark.createDataFrame([], "url string, content_hash string")
    one = pages(spark, a="# A\nThe tuition fee of this year is listed.\n\n## B\nAdmission begins in June of the year.", b="The library opens at nine every day.", c="A page that will be gone soon enough.")
    two = pages(spark, a="# A\nThe tuition fee of next year is listed.\n\n## B\nAdmission begins in June of the year.", b="The library opens at nine every day.", d="A new page about scholarships and grants.")
    folder = str(tmp_path / "site")
    first = built(spark, one, none)
    assert jobs.sync_chunks(spark, first, none, folder, 1) == {"came": 4, "went": 0}
    second = built(spark, two, first.state)
    got = jobs.sync_chunks(spark, second, first.state, folder, 2)
    assert got == {"came": 3, "went": 2}
    jobs.sync_chunks(spark, second, first.state, folder, 2)  # a run that is done again
    # against a rebuild
    other = str(tmp_path / "other")
    jobs.sync_chunks(spark, second, none, other, 1)
    texts = lambda f: sorted((r["url"], r["section"], r["text"]) for r in KeyedTable(spark, f"{f}/chunks").read().collect())
    assert texts(folder) == texts(other) and len(texts(folder)) == 4
    asked = spark.createDataFrame([(1, "tuition fee year"), (2, "page gone soon"), (3, "admission June"), (4, "scholarships")], "q long, question string")
    hits = lambda f: sorted((r["q"], r["key"], round(r["score"], 9)) for r in Store(spark, f"{f}/index").search(bm25.query_terms(asked), 5).collect())
    assert hits(folder) == hits(other) and hits(folder)
    assert Store(spark, f"{folder}/index").stats() == Store(spark, f"{other}/index").stats()


def test_crawl_reads_rules_in_their_order(spark):
    """Disallow: /a before Allow: /a/b forbids both, as the first rule that fits decides."""
    files = spark.createDataFrame([("h.org", "User-agent: *\nDisallow: /a\nAllow: /a/b\n")], "host string, body string")
    rules = crawl.robots_rules(files, "corvane")
    start = spark.createDataFrame([("https://h.org/",)], "url string")
    fetch = site({"/": ["/a/b/", "/c/"], "/a/b/": [], "/c/": []})
    got = jobs.crawl_site(start, fetch, ["h.org"], 9, rules)
    assert {r["url"] for r in got.pages.collect()} == {"https://h.org/", "https://h.org/c/"}
    longest = spark.createDataFrame([("h.org", "/a", False), ("h.org", "/a/b", True)], "host string, prefix string, allow boolean")
    assert jobs.crawl_site(start, fetch, ["h.org"], 9, longest).pages.count() == 3


def by_definition(text):
    """Sections as a fold over a stack that is copied for each heading."""
    heads, out, body, crumb = [], [], [], ""
    for line in chunk.LINE_END.split(text):
        bare = line.strip()
        n = len(bare) - len(bare.lstrip("#"))
        if 1 <= n <= 6 and bare[n : n + 1].isspace():
            out.append((crumb, "\n".join(body).strip()))
            heads = [h for h in heads if h[0] < n] + [(n, bare[n:].strip())]
            crumb, body = " > ".join(h for _, h in heads), []
        else:
            body.append(line)
    out.append((crumb, "\n".join(body).strip()))
    return [x for x in out if x[1]] or [("", text)]


def test_sections_are_linear_and_by_definition():
    import random

    rng = random.Random(3)
    for _ in range(200):
        text = "\n".join(rng.choice(["# A", "## B", "### C", "#### D", "x", "", "#no", " ## E ", "####### F", "#", "##\tG"]) for _ in range(rng.randint(0, 30)))
        assert [(s["crumb"], s["body"]) for s in chunk.sections_of(text)] == by_definition(text)
    def took(n):
        start = time.process_time()
        assert len(chunk.sections_of("\n".join(f"{'#' * (k % 6 + 1)} h{k}\ntext" for k in range(n)))) == n
        return time.process_time() - start

    took(1000)
    assert took(40_000) < 12 * max(took(10_000), 0.01)


def test_case_folding_is_pythons(spark):
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    lines = ["".join(map(chr, points[k : k + 500])) for k in range(0, len(points), 500)]
    rows = spark.createDataFrame(list(enumerate([*lines, "Straße ΑΣ ﬃ İ", "PLAIN ascii", "", None])), "i long, s string").repartition(4)
    got = {r["i"]: r["f"] for r in rows.select("i", T.casefold(F.col("s")).alias("f")).collect()}
    for i, s in enumerate([*lines, "Straße ΑΣ ﬃ İ", "PLAIN ascii", ""]):
        assert got[i] == s.casefold()
    assert got[len(lines) + 3] is None
