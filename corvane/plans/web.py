"""Queries on URLs, pages, blocks, chunks and change detection, each with its SQL.

The pages' own URLs have no path that the skip, category or rendering rules know, so some are given one by
their id; documents stand for cleaned texts, with a line's end as the block separator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import html as H
from corvane.functions import lexicon as X
from corvane.functions import text as T
from corvane.functions import urls as U
from corvane.operators import chunk, clean, crawl, state
from corvane.runtime import cut, widen
from corvane.sources import readers, sinks

from . import html_sql as HS
from . import oracle as O
from .search import docs

PATHS = ["/oferta/studia-1-stopnia/informatyka/", "/Feedback/x", "/TAG/a", "/en", "/en/offer/master/x/", "/kalkulator-czesnego/", "/kontakt/erasmus/", "/uk/logistyka/", "/RU/aktualnosci/1", "/ru/predlozhenie/magistratura/x/", ""]
DOMAINS = ["blog.tionsh.example.com", "blog.tionsh.example.net", "m.tionsh.example.net", "thther.example.org", "thther.example.com", "tionble.example.org"]
ROBOTS = [("blog.tionsh.example.net", "/en/", False), ("blog.tionsh.example.net", "/en/4", True), ("tionble.example.org", "/", False), ("thther.example.org", "/en/", False)]
MARKERS = ["License", "the", "version 2.0", "zł", "©", "All Rights Reserved"]
KEYWORDS = ["license", "rights reserved"]
BANNER = "\n\nWe use Cookies here.\nAccept all\n\n\n\nPierwszego dnia: zarezerwuj\n\nkept  block\n\n kept block \n\n"
WIDGET = "start pierwszego zarezerwuj liczba miejsc start 1 : 2 : 3 : 4 studiów października swoje miejsce ograniczona studiów"


def pages(spark: SparkSession, d: str) -> DataFrame:
    return widen(spark.read.parquet(f"{d}/pages.parquet"))


def _given(key: str = "page_id") -> Column:
    """The URL with one of PATHS, by the id; the last stands for the URL's own."""
    path = F.element_at(F.array(*map(F.lit, PATHS)), (F.col(key) % len(PATHS) + 1).cast("int"))
    return F.when(path == "", F.col("url")).otherwise(F.concat(F.regexp_extract("url", r"^https?://[^/?#]*", 0), path, F.lit("?q=/search#f")))


_GIVEN = f"(SELECT page_id, CASE WHEN p = '' THEN url ELSE regexp_extract(url, '^https?://[^/?#]*') || p || '?q=/search#f' END AS url FROM (SELECT page_id, url, {O.array(PATHS)}[page_id % {len(PATHS)} + 1] AS p FROM pages))"
_PATH = r"regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
_AUTH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)"

# ---- URLs ----


def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", U.normalize(_given()).alias("normal"), U.normalize(F.col("url")).alias("normal_own"))


def url_language(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", U.language(_given()).alias("language"))


def url_skip(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", U.is_skipped(_given()).alias("skipped"))


def url_dynamic(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", U.is_dynamic(_given()).alias("dynamic"))


def url_category(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", U.category(_given()).alias("category"))


def allow_domain(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", U.bare_host(F.col("url")).alias("host"), U.is_allowed(F.col("url"), DOMAINS).alias("allowed"))


def robots_filter(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(ROBOTS, "host string, prefix string, allow boolean")
    return crawl.allowed_by_rules(pages(spark, d), "url", rules).select("page_id", "allowed")


def price_predicates(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.col("html"), F.element_at(F.array(*map(F.lit, [" 1200 zł", " 12 zł", " 350PLN Cennik w przygotowaniu", " ZŁ/M-C", ' 999 pln "ctaMore"', ""])), (F.col("page_id") % 6 + 1).cast("int")))
    return pages(spark, d).select("page_id", clean.price_ready(text).alias("price_ready"), clean.is_price_response(_given()).alias("price_response"))


# ---- pages ----


def _links(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", "url", F.posexplode(H.links(F.col("html"))).alias("pos", "href"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).select("page_id", F.col("pos").cast("long").alias("pos"), "href", U.resolve(F.col("url"), F.col("href")).alias("target"))


def link_routes(spark: SparkSession, d: str) -> DataFrame:
    href = F.when(F.col("pos") % 3 == 0, F.concat(F.col("href"), F.lit(".PDF?a=1#p"))).when(F.col("pos") % 3 == 1, F.concat(F.lit("/search"), F.col("href"))).otherwise(F.col("href"))
    rows = _links(spark, d).withColumn("u", U.resolve(F.col("url"), href))
    return crawl.route(rows, "u", DOMAINS).select("page_id", F.col("pos").cast("long").alias("pos"), "route", "target")


def pdf_links(spark: SparkSession, d: str) -> DataFrame:
    return sinks.pdf_records(link_routes(spark, d).where("route = 'pdf'").select(F.col("target").alias("url")))


def html_title(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", H.title(F.col("html")).alias("title"))


def html_text(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", H.text(F.col("html")).alias("text"))


def html_markdown(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", H.markdown(F.col("html")).alias("markdown"))


def fetch_ladder(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id")
    body, place = crawl.fetch_ladder(F.when(i % 3 == 0, F.col("html")), F.when(i % 3 == 1, F.col("url")).otherwise(""), F.when(i % 5 != 0, F.lit("static")))
    return pages(spark, d).select("page_id", F.sha2(body, 256).alias("body_sha256"), place.cast("long").alias("attempt"))


def clean_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = clean.clean_html(pages(spark, d), "html", "markdown")
    rendered = F.when(F.col("page_id") % 4 == 0, F.lit(" Price: 1200 zł \n"))
    return rows.select("page_id", clean.with_dynamic(F.col("markdown"), rendered, "Prices").alias("markdown"))


def crawl_frontier(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d).select(F.col("page_id").alias("src"))
    n = p.agg(F.count(F.lit(1))).scalar()
    edges = p.select("src", F.explode(F.array((F.col("src") * 2 + 1) % n, (F.col("src") * 3 + 2) % n)).alias("dst"))
    return crawl.frontier(edges, p.where("src = 0").select(F.col("src").alias("node")), 5).select(F.col("node").alias("page_id"), "level")


def _robots(host: Column) -> Column:
    """A robots.txt for each host, one of three kinds by the length of its name."""
    kinds = ["User-agent: *\nAllow: /en/4\nDisallow: /en/\n", "User-agent: *\nDisallow: /en/\nAllow: /en/4\n", "User-agent: other\nDisallow: /\n\nUser-agent: corvane\nDisallow: /de/ # all\nDisallow:\n\nUser-agent: *\nDisallow: /\n"]
    return F.element_at(F.array(*map(F.lit, kinds)), F.char_length(host) % 3 + 1)


def robots_order(spark: SparkSession, d: str) -> DataFrame:
    """Rules are read from files, and the first that fits decides."""
    rows = pages(spark, d).select("page_id", "url")
    files = rows.select(U.bare_host(F.col("url")).alias("host")).distinct().withColumn("body", _robots(F.col("host")))
    return crawl.allowed_in_order(rows, "url", crawl.robots_rules(files, "corvane/1.0")).select("page_id", "allowed")


def link_reach(spark: SparkSession, d: str) -> DataFrame:
    """All that is reached from page 0 by the pages' own links, from a page to what it links to and on to the pages that link there, until nothing is new."""
    links = pages(spark, d).select(F.col("page_id").cast("string").alias("page"), F.explode(H.links(F.col("html"))).alias("href")).distinct()
    edges = links.select(F.col("page").alias("src"), F.concat(F.lit("to "), "href").alias("dst"))
    edges = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    start = spark.createDataFrame([("0",)], "node string")
    return crawl.frontier(cut(edges), start).where(~F.startswith("node", F.lit("to "))).select(F.col("node").cast("long").alias("page_id"), F.lit(True).alias("reached"))


def crawl_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = pages(spark, d).select("page_id", U.bare_host(F.col("url")).alias("host"))
    return crawl.budget(rows, "host", 3, "page_id")


# ---- blocks ----


def dedupe_blocks(spark: SparkSession, d: str) -> DataFrame:
    return clean.dedupe_blocks(docs(spark, d).select("doc_id", "text"), "text", "kept", "\n").select("doc_id", F.char_length("kept").cast("long").alias("n_chars"), F.sha2("kept", 256).alias("kept_sha256"))


def _noisy(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit(WIDGET)).otherwise(F.lit("")), F.col("text"), F.when(F.col("doc_id") % 3 == 0, F.lit(BANNER)).otherwise(F.lit("")))
    return docs(spark, d).select("doc_id", text.alias("text"))


def noise_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _noisy(spark, d).select("doc_id", F.sha2(clean.remove_noise(F.col("text")), 256).alias("clean_sha256"))


def clean_texts(spark: SparkSession, d: str) -> DataFrame:
    return clean.clean_text(_noisy(spark, d), "text", "clean").select("doc_id", F.sha2("clean", 256).alias("clean_sha256"))


def marker_matrix(spark: SparkSession, d: str) -> DataFrame:
    found = clean.found_markers(F.col("text"), MARKERS)
    return docs(spark, d).select("doc_id", F.array_join(found, "|").alias("markers"), F.size(found).cast("long").alias("n_markers"))


def keyword_context(spark: SparkSession, d: str) -> DataFrame:
    return clean.keyword_context(docs(spark, d), "doc_id", "text", KEYWORDS).select("doc_id", "line", F.sha2(F.array_join("window", "\n"), 256).alias("window_sha256"))


# ---- chunks ----


def _packed(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d).select("*", F.posexplode(chunk.pack(F.col("text"), separator="\n")).alias("seq", "piece"))
    return rows.withColumn("chunk", T.strip(F.col("piece"))).where(F.char_length("chunk") >= X.CHUNK_LEAST).withColumn("seq", F.col("seq").cast("long"))


def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).select("doc_id", "seq", F.char_length("chunk").cast("long").alias("n_chars"), F.sha2("chunk", 256).alias("chunk_sha256"))


def chunk_headings(spark: SparkSession, d: str) -> DataFrame:
    rows = clean.clean_html(pages(spark, d).withColumn("title", H.title(F.col("html"))), "html", "markdown")
    return chunk.chunk_pages(rows.select("page_id", "title", "markdown"), "page_id", "title", "markdown").select("page_id", "seq", "section", "chunk")


def chunk_records(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("https://example.com/"), F.col("lang"), F.lit("/kontakt/"), F.col("doc_id").cast("string"))
    rows = _packed(spark, d).withColumn("section", F.col("source"))
    out = chunk.chunk_records(rows, url, F.col("source"), F.col("lang"), F.col("text"), F.lit("2026-01-01T00:00:00+00:00"))
    extra = chunk.sparse_metadata(F.col("lastUpdated"), F.when(F.col("seq") == 0, F.col("source")).otherwise(""))
    key = chunk.chunk_hash(*[F.col(c) for c in ("url", "title", "section", "language", "text")])
    return out.select("url", "title", "section", "faculty", "language", "lastUpdated", "source", "content_hash", F.sha2("text", 256).alias("text_sha256"), "seq", key.alias("chunk_hash"), F.size(extra).cast("long").alias("n_metadata"))


def valid_records(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    rows = docs(spark, d).select(F.when(i % 7 != 0, F.concat(F.lit(" u"), i.cast("string"), F.lit(" "))).alias("url"), F.when(i % 3 != 0, F.lit(" T ")).alias("title"), F.lit(" s ").alias("section"), F.lit(None).cast("string").alias("faculty"), F.when(i % 5 != 0, F.upper("lang")).alias("language"), F.when(i % 11 == 0, F.lit(" \n ")).otherwise(F.col("text")).alias("text"))
    return readers.valid(rows).select("url", "title", "section", "faculty", "language", F.sha2("text", 256).alias("text_sha256"))


# ---- change detection ----


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", chunk.page_hash(F.col("text")).alias("content_hash"))


def _before(now: DataFrame) -> DataFrame:
    """A state of the run before: some ids are missing, some hashes differ, some ids are gone since."""
    old = now.where("doc_id % 7 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 5 == 0, F.lit("stale")).otherwise(F.col("content_hash")))
    return old.unionByName(now.where("doc_id % 11 = 0").withColumn("doc_id", -F.col("doc_id") - 1))


def change_rows(spark: SparkSession, d: str) -> DataFrame:
    now = content_hash(spark, d)
    return state.changes(now, _before(now), "doc_id", "content_hash")


def change_report(spark: SparkSession, d: str) -> DataFrame:
    return state.report(change_rows(spark, d))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    key = chunk.chunk_hash(F.lit(""), F.lit(None).cast("string"), F.lit(""), F.col("lang"), F.col("text"))
    return docs(spark, d).select(key.alias("content_hash"), "doc_id", "source", F.col("doc_id").alias("ord"))


def chunk_hash_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return state.last_wins(_stored(spark, d), "content_hash", "ord").select("content_hash", "doc_id", "source")


def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = _stored(spark, d)
    old = state.last_wins(rows.where("doc_id % 3 = 0"), "content_hash", "ord").withColumn("source", F.lit("old"))
    return state.upsert(old, rows.where("doc_id % 2 = 0"), "content_hash", "ord").select("content_hash", "doc_id", "source")


def merge_crawl(spark: SparkSession, d: str) -> DataFrame:
    rows = pages(spark, d).select(U.bare_host(F.col("url")).alias("url"), "page_id", H.title(F.col("html")).alias("title"))
    return crawl.merge_crawls(rows, "url", "page_id", "title").select("url", "title", "first")


def lang_counts(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).groupBy(U.language(_given()).alias("language")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "url_normalize": url_normalize, "url_language": url_language, "url_skip": url_skip, "url_dynamic": url_dynamic, "url_category": url_category, "allow_domain": allow_domain, "robots_filter": robots_filter, "price_predicates": price_predicates,
    "page_links": page_links, "link_routes": link_routes, "pdf_links": pdf_links, "html_title": html_title, "html_text": html_text, "html_markdown": html_markdown, "fetch_ladder": fetch_ladder, "clean_pages": clean_pages, "crawl_frontier": crawl_frontier, "robots_order": robots_order, "link_reach": link_reach, "crawl_budget": crawl_budget,
    "dedupe_blocks": dedupe_blocks, "noise_blocks": noise_blocks, "clean_texts": clean_texts, "marker_matrix": marker_matrix, "keyword_context": keyword_context,
    "chunk_pack": chunk_pack, "chunk_headings": chunk_headings, "chunk_records": chunk_records, "valid_records": valid_records,
    "content_hash": content_hash, "change_rows": change_rows, "change_report": change_report, "chunk_hash_dedupe": chunk_hash_dedupe, "upsert_merge": upsert_merge, "merge_crawl": merge_crawl, "lang_counts": lang_counts,
}

_CAT = "CASE " + " ".join(f"WHEN contains(p, {O.q(h)}) THEN {O.q(v)}" for h, v in X.CATEGORY_HINTS.items()) + f" ELSE {O.q(X.CATEGORY_DEFAULT)} END"
_HOST = r"regexp_replace(lower(" + _AUTH + r"), '^www\.', '')"
_LANG = "CASE WHEN starts_with(lower(p), '/en/') THEN 'en' WHEN starts_with(lower(p), '/uk/') THEN 'uk' WHEN starts_with(lower(p), '/ru/') THEN 'ru' ELSE 'pl' END"
_LINKROWS = r"""(SELECT page_id, url, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS pos, unnest(l) AS href FROM (SELECT page_id, url, regexp_extract_all(html, '(?i)<a\b[^>]*?href="([^"]*)"', 1) AS l FROM pages))"""
_ORIGIN = "regexp_extract(url, '^https?://[^/?#]*')"
_ROUTES = f"""(SELECT page_id, pos, {_ORIGIN} || CASE WHEN pos % 3 = 0 THEN href || '.PDF?a=1#p' WHEN pos % 3 = 1 THEN '/search' || href ELSE href END AS u, url FROM {_LINKROWS})"""
_ROUTED = f"""(SELECT page_id, pos, route, CASE route WHEN 'pdf' THEN split_part(u, '#', 1) WHEN 'page' THEN {_ORIGIN} || rtrim(regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1), '/') || '/' END AS target FROM (
  SELECT *, CASE WHEN {_HOST} NOT IN {O.listed(DOMAINS)} THEN 'foreign' WHEN pos % 3 = 0 THEN 'pdf' WHEN pos % 3 = 1 THEN 'skipped' ELSE 'page' END AS route FROM {_ROUTES}))"""
_CONTENT = r"regexp_matches(html, '(?i)<(main|body)\b')"
_TITLE = r"CASE WHEN regexp_matches(html, '(?is)<title\b[^>]*>(.*?)</title\s*>') THEN regexp_replace(" + HS.sql(r"regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1)", [(e, c) for e, c in HS.ENTITIES]) + r", '^\s+|\s+$', '', 'g') ELSE 'Untitled' END"
_SQUEEZE = r"trim(regexp_replace(b, '\s+', ' ', 'g'))"


def _distinct_blocks(rows: str, key: str, c: str, separator: str) -> str:
    """key, kept: first of equal blocks of rows' column c."""
    return rf"""(SELECT {key}, coalesce(string_agg(trim(b, E' \t\n\r\x0b\x0c'), {separator} ORDER BY pos) FILTER (WHERE rn = 1 AND k <> ''), '') AS kept FROM (
      SELECT {key}, pos, b, k, row_number() OVER (PARTITION BY {key}, k ORDER BY pos) AS rn FROM (SELECT {key}, pos, b, {_SQUEEZE} AS k FROM (
        SELECT {key}, generate_subscripts(l, 1) AS pos, unnest(l) AS b FROM (SELECT {key}, string_split({c}, {separator}) AS l FROM {rows})))) GROUP BY {key})"""


_NL2 = "chr(10) || chr(10)"
_NOISY = f"(SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {O.q(WIDGET)} ELSE '' END || text || CASE WHEN doc_id % 3 = 0 THEN {O.q(BANNER)} ELSE '' END AS text FROM documents)"
_LOW = r"lower(trim(regexp_replace(b, '\s+', ' ', 'g')))"
_HAS = lambda ms: "(" + " OR ".join(f"contains({_LOW}, {O.q(m)})" for m in ms) + ")"
_COUNT = "(" + " + ".join(f"CAST(contains({_LOW}, {O.q(m)}) AS INT)" for m in X.COUNTDOWN_MARKERS) + ")"
_QUIET = rf"""(SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(text, {O.q('(?is)' + X.COUNTDOWN_WIDGET)}, ''), '\n\s*\n'), lambda b: {O.strip('b')}),
  lambda b: b <> '' AND {_COUNT} < 2 AND NOT ({_HAS(X.COOKIE_MARKERS)} AND {_HAS(X.CONSENT_MARKERS)})), {_NL2}) AS quiet FROM {_NOISY})"""
_SEP = "chr(1)"
_PACKED = rf"""(SELECT doc_id, lang, source, text, CAST(seq AS BIGINT) AS seq, chunk FROM (SELECT doc_id, lang, source, text, generate_subscripts(ps, 1) - 1 AS seq, {O.strip('unnest(ps)')} AS chunk FROM (
  SELECT doc_id, lang, source, text, CASE WHEN length(text) <= 1800 OR len(pars) = 0 THEN [text] ELSE string_split(list_reduce(pars, lambda a, p: CASE
    WHEN length(string_split(a, {_SEP})[-1]) + length(p) + 1 > 1800 THEN a || {_SEP} || p ELSE a || chr(10) || p END), {_SEP}) END AS ps
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda p: {O.strip('p')} <> '') AS pars FROM documents))) WHERE length(chunk) >= 15)"""
_MD = f"CASE WHEN {_CONTENT} THEN {HS.sql('html', HS.MARKDOWN)} ELSE '' END"
_QUIET_MD = rf"""(SELECT page_id, array_to_string(list_filter(list_transform(string_split_regex(m, '\n\s*\n'), lambda b: {O.strip('b')}),
  lambda b: b <> '' AND {_COUNT} < 2 AND NOT ({_HAS(X.COOKIE_MARKERS)} AND {_HAS(X.CONSENT_MARKERS)})), {_NL2}) AS quiet FROM (SELECT page_id, {_MD} AS m FROM pages))"""
_HEADINGS = rf"""WITH md AS (SELECT page_id, kept, title FROM {_distinct_blocks(_QUIET_MD, 'page_id', 'quiet', _NL2)} JOIN (SELECT page_id, {_TITLE} AS title FROM pages) USING (page_id)),
ln AS (SELECT page_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT page_id, string_split(kept, chr(10)) AS l FROM md)),
hd AS (SELECT *, regexp_matches({O.strip('line')}, '^#{{1,6}}\s+.*$') AS head FROM ln),
sc AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS sec FROM hd),
hs AS (SELECT page_id, sec, length(regexp_extract({O.strip('line')}, '^(#{{1,6}})\s', 1)) AS level, {O.strip(f"regexp_extract({O.strip('line')}, '^#+(.*)$', 1)")} AS name FROM sc WHERE head),
up AS (SELECT s.page_id, s.sec, string_agg(h.name, ' > ' ORDER BY h.sec) AS crumb FROM hs s JOIN hs h ON h.page_id = s.page_id AND h.sec <= s.sec
  WHERE NOT EXISTS (SELECT 1 FROM hs k WHERE k.page_id = h.page_id AND k.sec > h.sec AND k.sec <= s.sec AND k.level <= h.level) GROUP BY s.page_id, s.sec),
bd AS (SELECT page_id, sec, {O.strip('b')} AS body FROM (SELECT page_id, sec, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT head), '') AS b FROM sc GROUP BY page_id, sec)),
se AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY sec) - 1 AS s, coalesce(crumb, '') AS crumb, body FROM bd LEFT JOIN up USING (page_id, sec) WHERE body <> ''
  UNION ALL SELECT page_id, 0, '', kept FROM md WHERE page_id NOT IN (SELECT page_id FROM bd WHERE body <> '')),
pc AS (SELECT page_id, s, crumb, generate_subscripts(ps, 1) - 1 AS p, {O.strip('unnest(ps)')} AS chunk FROM (SELECT page_id, s, crumb, CASE WHEN length(body) <= 1800 OR len(pars) = 0 THEN [body] ELSE string_split(list_reduce(pars, lambda a, p: CASE
    WHEN length(string_split(a, {_SEP})[-1]) + length(p) + 2 > 1800 THEN a || {_SEP} || p ELSE a || {_NL2} || p END), {_SEP}) END AS ps
  FROM (SELECT *, list_filter(string_split(body, {_NL2}), lambda p: {O.strip('p')} <> '') AS pars FROM se)))
SELECT page_id, (s * 1000000 + p)::BIGINT AS seq, CASE WHEN crumb = '' THEN title WHEN lower(crumb) = lower(title) OR starts_with(lower(crumb), lower(title) || ' > ') THEN crumb ELSE title || ' > ' || crumb END AS section, chunk
FROM pc JOIN md USING (page_id) WHERE length(chunk) >= 15"""
_HASH = "sha256(text)"
_PRIOR = f"(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'stale' ELSE {_HASH} END AS h FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT -doc_id - 1, {_HASH} FROM documents WHERE doc_id % 11 = 0)"
_CHANGES = f"(SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.h, o.h) AS content_hash, CASE WHEN o.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'deleted' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS status FROM (SELECT doc_id, {_HASH} AS h FROM documents) n FULL JOIN {_PRIOR} o ON n.doc_id = o.doc_id)"
_KEY = f"sha256(chr(10) || chr(10) || chr(10) || lang || chr(10) || {O.strip('text')})"
_LASTOF = lambda where: f"(SELECT {_KEY} AS content_hash, max(doc_id) AS doc_id, max_by(source, doc_id) AS source FROM documents WHERE {where} GROUP BY 1)"

ORACLE = {
    "url_normalize": f"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) || '://' || {_AUTH} || rtrim({_PATH}, '/') || '/' AS normal, (SELECT regexp_extract(o.url, '^[a-z]+://[^/?#]*') || rtrim(regexp_extract(o.url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') || '/' FROM pages o WHERE o.page_id = g.page_id) AS normal_own FROM {_GIVEN} g",
    "url_language": f"SELECT page_id, {_LANG} AS language FROM (SELECT page_id, {_PATH} AS p FROM {_GIVEN})",
    "url_skip": f"SELECT page_id, {' OR '.join(f'contains(p, {O.q(s)})' for s in X.SKIPPED_PATHS)} AS skipped FROM (SELECT page_id, lower({_PATH}) AS p FROM {_GIVEN})",
    "url_dynamic": f"SELECT page_id, regexp_matches({_PATH}, {O.q('|'.join(X.DYNAMIC_PATHS))}) AS dynamic FROM {_GIVEN}",
    "url_category": f"SELECT page_id, {_CAT} AS category FROM (SELECT page_id, lower({_PATH}) AS p FROM {_GIVEN})",
    "allow_domain": f"SELECT page_id, {_HOST} AS host, {_HOST} IN {O.listed(DOMAINS)} AS allowed FROM pages",
    "robots_filter": "SELECT page_id, CASE WHEN h = 'blog.tionsh.example.net' THEN NOT starts_with(p, '/en/') OR starts_with(p, '/en/4') WHEN h = 'tionble.example.org' THEN NOT starts_with(p, '/') WHEN h = 'thther.example.org' THEN NOT starts_with(p, '/en/') ELSE TRUE END AS allowed FROM (SELECT page_id, " + _HOST + " AS h, " + _PATH + " AS p FROM pages)",
    "price_predicates": f"SELECT page_id, regexp_matches(t, {O.q('(?i)' + X.PRICE_PATTERN)}) AND NOT contains(t, {O.q(X.PRICE_PENDING)}) AND NOT contains(t, {O.q(X.PRICE_RAW)}) AS price_ready, {' OR '.join(f'contains(lower(url), {O.q(k)})' for k in X.RESPONSE_KEYWORDS)} AS price_response FROM (SELECT p.page_id, g.url, html || [' 1200 zł', ' 12 zł', ' 350PLN Cennik w przygotowaniu', ' ZŁ/M-C', ' 999 pln \"ctaMore\"', ''][p.page_id % 6 + 1] AS t FROM pages p JOIN {_GIVEN} g USING (page_id))",
    "page_links": f"SELECT page_id, pos, href, {_ORIGIN} || href AS target FROM {_LINKROWS}",
    "link_routes": f"SELECT * FROM {_ROUTED}",
    "pdf_links": f"SELECT DISTINCT url, {_LANG} AS language FROM (SELECT target AS url, regexp_extract(target, '^https?://[^/?#]*([^?#]*)', 1) AS p FROM {_ROUTED} WHERE route = 'pdf')",
    "html_title": f"SELECT page_id, {_TITLE} AS title FROM pages",
    "html_text": f"SELECT page_id, CASE WHEN {_CONTENT} THEN {HS.sql('html', HS.TEXT)} ELSE '' END AS text FROM pages",
    "html_markdown": f"SELECT page_id, CASE WHEN {_CONTENT} THEN {HS.sql('html', HS.MARKDOWN)} ELSE '' END AS markdown FROM pages",
    "fetch_ladder": "SELECT page_id, sha256(CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN url ELSE CASE WHEN page_id % 5 <> 0 THEN 'static' END END) AS body_sha256, CASE page_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE CASE WHEN page_id % 5 <> 0 THEN 2 END END::BIGINT AS attempt FROM pages",
    "clean_pages": f"SELECT page_id, kept || CASE WHEN page_id % 4 = 0 THEN chr(10) || chr(10) || '## Prices' || chr(10) || chr(10) || 'Price: 1200 zł' ELSE '' END AS markdown FROM {_distinct_blocks(f'(SELECT page_id, CASE WHEN {_CONTENT} THEN {HS.sql(chr(104) + chr(116) + chr(109) + chr(108), HS.MARKDOWN)} ELSE {O.q(str())} END AS m FROM pages)', 'page_id', 'm', _NL2)}",
    "robots_order": "SELECT page_id, CASE length(h) % 3 WHEN 0 THEN starts_with(p, '/en/4') OR NOT starts_with(p, '/en/') WHEN 1 THEN NOT starts_with(p, '/en/') ELSE NOT starts_with(p, '/de/') END AS allowed FROM (SELECT page_id, " + _HOST + " AS h, " + _PATH + " AS p FROM pages)",
    "link_reach": f"WITH RECURSIVE l AS MATERIALIZED (SELECT DISTINCT page_id, href FROM {_LINKROWS}), hop AS MATERIALIZED (SELECT DISTINCT a.page_id AS src, b.page_id AS dst FROM l a JOIN l b USING (href)), walk AS (SELECT 0::BIGINT AS page_id UNION SELECT dst FROM walk JOIN hop ON src = page_id) SELECT page_id, TRUE AS reached FROM walk",
    "crawl_frontier": "WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages), walk AS (SELECT 0::BIGINT AS page_id, 0::BIGINT AS level UNION SELECT (CASE WHEN k = 0 THEN page_id * 2 + 1 ELSE page_id * 3 + 2 END) % n, level + 1 FROM walk, n, (SELECT unnest([0, 1]) AS k) WHERE level < 5) SELECT page_id, min(level) AS level FROM walk GROUP BY page_id",
    "crawl_budget": f"SELECT page_id, host FROM (SELECT page_id, {_HOST} AS host, row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) AS n FROM pages) WHERE n <= 3",
    "dedupe_blocks": f"SELECT doc_id, CAST(length(kept) AS BIGINT) AS n_chars, sha256(kept) AS kept_sha256 FROM {_distinct_blocks('documents', 'doc_id', 'text', 'chr(10)')}",
    "noise_blocks": f"SELECT doc_id, sha256(quiet) AS clean_sha256 FROM {_QUIET}",
    "clean_texts": f"SELECT doc_id, sha256(kept) AS clean_sha256 FROM {_distinct_blocks(_QUIET, 'doc_id', 'quiet', _NL2)}",
    "marker_matrix": f"SELECT doc_id, array_to_string(m, '|') AS markers, CAST(len(m) AS BIGINT) AS n_markers FROM (SELECT doc_id, list_filter({O.array(MARKERS)}, lambda x: contains(lower(text), lower(x))) AS m FROM documents)",
    "keyword_context": f"SELECT doc_id, CAST(i - 1 AS BIGINT) AS line, sha256(array_to_string(l[greatest(i - 3, 1):i + 3], chr(10))) AS window_sha256 FROM (SELECT doc_id, l, generate_subscripts(l, 1) AS i, unnest(l) AS own FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE {' OR '.join(f'contains(lower(own), {O.q(k)})' for k in KEYWORDS)}",
    "chunk_pack": f"SELECT doc_id, seq, CAST(length(chunk) AS BIGINT) AS n_chars, sha256(chunk) AS chunk_sha256 FROM {_PACKED}",
    "chunk_headings": _HEADINGS,
    "chunk_records": f"""SELECT url, source AS title, source AS section, 'Kontakt' AS faculty, lang AS language, '2026-01-01T00:00:00+00:00' AS "lastUpdated", 'website' AS source, sha256(text) AS content_hash, sha256(chunk) AS text_sha256, seq,
      sha256(url || chr(10) || source || chr(10) || source || chr(10) || lang || chr(10) || chunk) AS chunk_hash, CASE WHEN seq = 0 THEN 2 ELSE 1 END::BIGINT AS n_metadata FROM (SELECT *, 'https://example.com/' || lang || '/kontakt/' || doc_id AS url FROM {_PACKED})""",
    "valid_records": f"SELECT 'u' || doc_id AS url, CASE WHEN doc_id % 3 <> 0 THEN 'T' ELSE 'Untitled' END AS title, 's' AS section, '' AS faculty, CASE WHEN doc_id % 5 <> 0 THEN lang ELSE 'pl' END AS language, sha256({O.strip('text')}) AS text_sha256 FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND {O.strip('text')} <> ''",
    "content_hash": f"SELECT doc_id, {_HASH} AS content_hash FROM documents",
    "change_rows": f"SELECT * FROM {_CHANGES}",
    "change_report": f"SELECT status, count(*) AS n FROM {_CHANGES} GROUP BY status",
    "chunk_hash_dedupe": f"SELECT * FROM {_LASTOF('TRUE')}",
    "upsert_merge": f"SELECT * FROM {_LASTOF('doc_id % 2 = 0')} UNION ALL SELECT content_hash, doc_id, 'old' FROM {_LASTOF('doc_id % 3 = 0')} WHERE content_hash NOT IN (SELECT content_hash FROM {_LASTOF('doc_id % 2 = 0')})",
    "merge_crawl": f"SELECT {_HOST} AS url, max_by({_TITLE}, page_id) AS title, min(page_id) AS first FROM pages GROUP BY 1",
    "lang_counts": f"SELECT {_LANG} AS language, count(*) AS n FROM (SELECT {_PATH} AS p FROM {_GIVEN}) GROUP BY 1",
}
