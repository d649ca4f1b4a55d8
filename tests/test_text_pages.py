"""URLs, pages, blocks and chunks."""

from pyspark.sql import functions as F

from corvane.functions import html as H
from corvane.functions import text as T
from corvane.functions import urls as U
from corvane.operators import chunk, clean, crawl


def one(spark, values, make):
    """make(column) for each value."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string").select("i", make(F.col("v")).alias("o"))
    return [r["o"] for r in rows.orderBy("i").collect()]


def test_urls(spark):
    assert one(spark, ["https://A.b:80/x//?q#f", "//h/p", "https://h", "https://h/a.html"], U.normalize) == ["https://A.b:80/x/", "https://h/p/", "https://h/", "https://h/a.html/"]
    assert one(spark, ["https://h/en/x", "https://h/en", "https://h/RU/x", ""], U.language) == ["en", "pl", "ru", "pl"]
    assert one(spark, ["https://h/feedback/", "https://h/x?/tag/", "https://h/TAG/x"], U.is_skipped) == [True, False, True]
    assert one(spark, ["https://h/studia-mba/x/", "https://h/studia-mba/x/y/", "https://h/Studia-mba/x/"], U.is_dynamic) == [True, False, False]
    assert one(spark, ["https://h/kontakt/informatyka/", "https://h/x"], U.category) == ["Informatyka", "Ogólne"]
    assert one(spark, ["https://WWW.a.b/", "https://a.b:8/"], lambda c: U.is_allowed(c, ["a.b"])) == [True, False]


def test_links(spark):
    base = "https://h.org/a/b.html?x=1#y"
    links = ["/c/../d", "e", "./f?q", "../g", "#z", "?k", "//o.org/p", "mailto:x@y", ""]
    wanted = ["https://h.org/d", "https://h.org/a/e", "https://h.org/a/f?q", "https://h.org/g", "https://h.org/a/b.html?x=1#z", "https://h.org/a/b.html?k", "https://o.org/p", "mailto:x@y", base]
    assert one(spark, links, lambda c: U.resolve(F.lit(base), c)) == wanted


PAGE = """<html><head><title> T &amp; x </title><script>var t="</p>";</script></head><body><nav>n</nav><main><h2 class="a">Head</h2>
<p>One <b>two</b> <a href="/l">three</a><img src="i"></p><ul><li>four</li><li>five</li></ul><!-- c --></main><footer>f</footer></body></html>"""


def test_html(spark):
    assert one(spark, [PAGE, "<p>x</p>", "<title></title>"], H.title) == ["T & x", "Untitled", ""]
    assert one(spark, [PAGE, "<p>x</p>"], H.markdown) == ["## Head\n\nOne **two** [three](/l)\n\n* four\n* five", ""]
    assert one(spark, [PAGE], H.text) == ["Head\nOne two three\nfour\nfive"]
    assert one(spark, [PAGE], H.links) == [["/l"]]


def test_blocks(spark):
    rows = spark.createDataFrame([(1, "a  b\n\n\n\n c \n\na b\n\nC"), (2, None), (3, "")], "i long, t string")
    got = clean.dedupe_blocks(rows, "t", "o").orderBy("i").collect()
    assert [r["o"] for r in got] == ["a  b\n\nc\n\nC", "", ""]
    noise = "x\n\nUse COOKIES, settings\n\nPierwszego zarezerwuj\n\npierwszego\n \ncookie only"
    assert one(spark, [noise, None], clean.remove_noise) == ["x\n\npierwszego\n\ncookie only", ""]
    widget = "Start Pierwszego zarezerwuj liczba  miejsc start 1:2:3:4 studiów Października swoje miejsce ograniczona studiów"
    assert one(spark, [f"a {widget} b\n\n{widget}"], clean.remove_noise) == ["a  b"]
    assert one(spark, ["cena 1200 ZŁ", "12 zł", "900 pln Cennik w przygotowaniu"], clean.price_ready) == [True, False, False]
    assert one(spark, ["a"], lambda c: clean.with_dynamic(c, F.lit(" b "), "P")) == ["a\n\n## P\n\nb"]


def test_keyword_context(spark):
    rows = spark.createDataFrame([(1, "\n".join("abcdefghi"))], "i long, t string")
    got = clean.keyword_context(rows, "i", "t", ["B", "h"], 2).orderBy("line").collect()
    assert [(r["line"], "".join(r["window"])) for r in got] == [(1, "abcd"), (7, "fghi")]


def test_packing(spark):
    body = lambda *n: "\n\n".join("x" * k for k in n)
    sizes = [[len(p) for p in o] for o in one(spark, [body(1000, 797, 2, 1801, 10), body(1000, 798, 2, 1801, 10), body(1000, 799)], lambda c: chunk.pack(c))]
    assert sizes == [[1799, 2, 1801, 10], [1800, 2, 1801, 10], [1000, 799]]
    assert one(spark, [" \n\n " * 400], lambda c: F.size(chunk.pack(c))) == [1]


def test_headings(spark):
    rows = spark.createDataFrame([(1, "# A\nx\n### C\ny\n## B\nz\n# A2\nw"), (2, "plain"), (3, None), (4, "pre\n#no\n# H\n\n# I\nlast")], "i long, m string")
    got = {r["i"]: [(s["crumb"], s["body"]) for s in r["s"]] for r in chunk.sections(rows, "m", "s").collect()}
    assert got == {1: [("A", "x"), ("A > C", "y"), ("A > B", "z"), ("A2", "w")], 2: [("", "plain")], 3: [("", "")], 4: [("", "pre\n#no"), ("I", "last")]}


def test_chunk_pages(spark):
    demo = "# Admissions\n\nThe admission process starts in June.\n\n## Required documents\n\n- ID card\n- Diploma\n- Photo\n\n## Deadlines\n\nApplications close on September 30.\n\n## Tiny\n\nshort"
    rows = spark.createDataFrame([(1, "Admissions 2026", demo), (2, "Admissions", demo)], "i long, title string, m string")
    got = chunk.chunk_pages(rows, "i", "title", "m").orderBy("i", "seq").collect()
    assert [r["section"] for r in got if r["i"] == 1] == ["Admissions 2026 > Admissions", "Admissions 2026 > Admissions > Required documents", "Admissions 2026 > Admissions > Deadlines"]
    assert [r["section"] for r in got if r["i"] == 2][:2] == ["Admissions", "Admissions > Required documents"]


def test_text_functions(spark):
    assert one(spark, ["Straße ﬁn ΟΔΟΣ"], T.casefold) == ["strasse fin οδοσ"]
    assert one(spark, ["  English ", "TÜRKÇE", "xx"], T.language_code) == ["en", "tr", "xx"]
    assert one(spark, ["7", "-1", "x", None], lambda c: T.positive_int(c, 5)) == [7, 5, 5, 5]


def test_frontier(spark):
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (3, 0), (2, 2), (5, 6)], "src long, dst long")
    got = crawl.frontier(edges, spark.createDataFrame([(0,)], "node long"), 9)
    assert {(r["node"], r["level"]) for r in got.collect()} == {(0, 0), (1, 1), (2, 1), (3, 2)}


def test_frontier_without_a_depth(spark):
    links = [(x, y) for x in range(60) for y in ((x + 1) % 60, x * 2 % 60)]
    want, last = {0: 0}, [0]
    while last:
        last = sorted({y for x, y in links if x in last} - set(want))
        want |= dict.fromkeys(last, max(want.values()) + 1)
    assert max(want.values()) > 5
    got = crawl.frontier(spark.createDataFrame(links, "src long, dst long"), spark.createDataFrame([(0,)], "node long"))
    assert {(r["node"], r["level"]) for r in got.collect()} == set(want.items())


def test_merge_and_ladder(spark):
    rows = spark.createDataFrame([("u", 1, "a"), ("u", 3, "b"), ("v", 2, "c")], "url string, ord long, title string")
    assert {tuple(r) for r in crawl.merge_crawls(rows, "url", "ord", "title").collect()} == {("u", "b", 1), ("v", "c", 2)}
    body, place = crawl.fetch_ladder(F.lit(""), F.lit(None).cast("string"), F.lit("x"))
    assert tuple(spark.range(1).select(body, place).first()) == ("x", 2)


def test_html_of_other_pages(spark):
    """Written by hand: entities of all kinds, quotings of links, cells of tables."""
    page = "<html><title>A &amp;lt; &#8211; &#x41;&eacute; &nope; & b&hellip;</title><body><p>O&oacute;p &ndash; x&#8217;s &#0; &#1114112;</p><a class=x href='/one?a=1&amp;b=2'>one</a> <a href=/two>two</a> <A HREF = \"/three\">three</A><table><tr><td>a</td><td>b</td></tr><tr><th>c</th> <td>d</td></tr></table></body></html>"
    row = spark.createDataFrame([(page,)], "h string").select(H.title(F.col("h")).alias("title"), H.text(F.col("h")).alias("text"), H.markdown(F.col("h")).alias("md"), H.links(F.col("h")).alias("links")).first()
    assert row["title"] == "A &lt; – Aé &nope; & b…"
    assert row["links"] == ["/one?a=1&b=2", "/two", "/three"]
    assert "Oóp – x’s &#0; &#1114112;" in row["text"] and "a b\nc d" in row["text"]
    assert "[one](/one?a=1&b=2)" in row["md"] and "[two](/two)" in row["md"] and "[three](/three)" in row["md"] and "a | b" in row["md"]
