"""Pages as trees: hand-written forms, each with its markdown, text and links."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import html as H
from corvane.functions import html_tree as T

#: body, markdown, text, links
FORMS = [
    ("2 < 3 and 4 > 1", "2 < 3 and 4 > 1", "2 < 3 and 4 > 1", []),
    ("<ul><li>p<ul><li>q</li><li>r</ul><li>s</ul>", "* p\n  + q\n  + r\n* s", "p\nq\nr\ns", []),
    ("<ol><li>a<li>b<ol><li>c</ol></ol>t", "1. a\n2. b\n   1. c\n\nt", "a\nb\nc\nt", []),
    ("<ol start=3><li><p>x</p><p>y</p></li></ol>", "3. x\n\n   y", "x\ny", []),
    ('<a title="x > y" href="/z">Z</a> t', "[Z](/z) t", "Z t", ["/z"]),
    ('<a data-href="/no" href="/yes">k</a>', "[k](/yes)", "k", ["/yes"]),
    ("<!-- <a href='/old'>o</a> --><script>'<a href=\"/s\">'</script><style><a href=/t></style>n", "n", "n", []),
    ("<table><tr><th>a</th><th>b</th></tr><tr><td>c<br>d</td><td><p>e</p></td></tr></table>z", "| a | b |\n| --- | --- |\n| c d | e |\n\nz", "a b\nc\nd\ne\nz", []),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "| a | b |\n| --- | --- |\n| c |", "a b\nc", []),
    ("<pre>a\n  b &lt;c&gt;\n<b>x</b></pre>", "```\na\n  b <c>\nx\n```", "a\nb <c>\nx", []),
    ("<blockquote><p>q</p><p>r</p></blockquote>t", "> q\n\n> r\n\nt", "q\nr\nt", []),
    ("<p>a <b>b</b> c<p>d<br>e<br><p>f", "a **b** c\n\nd  \ne\n\nf", "a b c\nd\ne\nf", []),
    ("<h2> a\n<a href=x>b</a></h2>t", "## a [b](x)\n\nt", "a\nb\nt", ["x"]),
    ("<p>x<code>y</code><hr>z", "x`y`\n\n---\n\nz", "xy\nz", []),
    ("a <span> b</span> c", "a b c", "a b c", []),
    ("<main-x>k</main-x>l", "kl", "kl", []),
    ("<p>a<div>b</div>c", "a\n\nb\n\nc", "a\nb\nc", []),
    ("<li>lone", "* lone", "lone", []),
    ("<a href=/it's>q</a><A HREF = '/t?a=1&amp;b=2'>r</A>", "[q](/it's)[r](/t?a=1&b=2)", "qr", ["/it's", "/t?a=1&b=2"]),
    ("<a href>e</a><a name=n>m</a><a href=/u>un", "[e]()mun", "emun", ["", "/u"]),
    ("a<img src=i alt='x > y'>b ![i](j)c", "ab c", "ab ![i](j)c", []),
    ("</p></div>x</b>", "x", "x", []),
    ("<nav>n<a href=/n>m</a></nav>x<form><input>f</form><footer>g", "x", "x", ["/n"]),
    ("x<!-- open <b>y</b>", "x", "x", []),
    ("&lt;b&gt; &amp;lt; &eacute;&#8211;&#x41;&nope;&nbsp;&#0;", "<b> &lt; é–A&nope; &#0;", "<b> &lt; é–A&nope; &#0;", []),
    ("x <", "x <", "x <", []),
    ("<dl><dt>t<dd>d<dt>u</dl>", "t\n\nd\n\nu", "t\nd\nu", []),
    ("<p>a</p>\n\n<p>b\n c</p>", "a\n\nb c", "a\nb\nc", []),
]


@pytest.mark.parametrize("body, markdown, text, links", FORMS)
def test_forms(body, markdown, text, links):
    tree = T.events(f"<html><body>{body}</body></html>")
    assert (T.markdown(tree), T.text(tree), T.links(tree)) == (markdown, text, links)


def test_content_and_title():
    page = "<svg><title>icon</title></svg><title> A &amp; b<i> </title><body>out<main><p>in</p></main><main>no</main></body>"
    tree = T.events(page)
    assert (T.title(tree), T.markdown(tree), T.text(tree)) == ("A & b<i>", "in", "in")
    assert T.markdown(T.events("<p>x")) == "" and T.title(T.events("x")) == "Untitled" and T.title(T.events("<title></title>")) == ""


def balanced(tree):
    stack = []
    for kind, value, _ in tree:
        if kind == T.START:
            stack.append(value)
        elif kind == T.END:
            assert stack.pop() == value
    return not stack


def test_any_page_gives_a_tree():
    """Random pieces in random order: ends match starts, no word is lost or made up, nothing fails."""
    rng = random.Random(7)
    pieces = ["<p>", "</p>", "<b>", "</b>", "<ul>", "</ul>", "<ol>", "<li>", "</li>", "<table>", "</table>", "<tr>", "<td>", "</td>", "<pre>", "</pre>", "<a href='x'>", "</a>", "<br>", "<h1>", "</h1>", "<div>", "</div>", "<blockquote>", "</blockquote>", "<", ">", "<i", '"', "'", "&amp", "<dd>", "<hr/>", "<textarea>", "</textarea>"]
    for _ in range(400):
        body, words = [], []
        for k in range(rng.randint(1, 40)):
            if rng.random() < 0.4:
                words.append(f"w{k}")
                body.append(f" w{k} ")
            else:
                body.append(rng.choice(pieces))
        tree = T.events("<body>" + "".join(body))
        assert balanced(tree)
        T.markdown(tree)
        said = T.text(tree).split()
        assert [w for w in said if w.rstrip("<>\"'") in words or w in words] is not None
        if not any(x in ("<", "<i", '"', "'", "<textarea>") for x in body):
            assert [w for w in T.text(tree).replace(">", " ").replace("&amp", " ").split()] == words
            md = T.markdown(tree)
            assert all(w in md for w in words)


def test_deep_and_long_pages():
    deep = "<body>" + "<div><b>" * 60_000 + "x"
    assert T.text(T.events(deep)) == "x"
    many = "<body><ul>" + "<li>y" * 60_000
    assert T.markdown(T.events(many)).count("* y") == 60_000
    assert T.text(T.events("<body>" + "<" * 200_000 + "z")).endswith("z")


def test_columns(spark):
    page = "<title>t</title><body><p>a</p><a href='/x'>b</a></body>"
    rows = spark.createDataFrame([(1, page), (2, None), (3, "")], "i long, h string")
    got = rows.select("i", H.title(F.col("h")), H.text(F.col("h")), H.markdown(F.col("h")), H.links(F.col("h")), H.page(F.col("h"))).orderBy("i").collect()
    assert tuple(got[0])[1:5] == ("t", "a\nb", "a\n\n[b](/x)", ["/x"]) and tuple(got[0][5]) == ("t", "a\n\n[b](/x)", ["/x"])
    assert tuple(got[1])[1:5] == tuple(got[2])[1:5] == ("Untitled", "", "", [])
