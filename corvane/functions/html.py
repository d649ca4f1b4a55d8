"""Column functions on pages: plain text, markdown, titles and links, by the tree of html_tree. Pages go to Python in Arrow batches.

A null page says nothing: no text, no links, the default title.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from corvane.runtime import ship

from . import html_tree as tree


def _each(make: Callable, kind: str, arrow: pa.DataType) -> Callable[[Column], Column]:
    """A column function of make(events of a page)."""

    def of(html: pa.Array) -> pa.Array:
        return pa.array([make(tree.events(x or "")) for x in html.to_pylist()], arrow)

    of.__annotations__ = {"html": pa.Array, "return": pa.Array}

    def call(html: Column) -> Column:
        ship(SparkSession.active())
        return F.arrow_udf(of, kind)(html)

    return call


def text(html: Column) -> Column:
    """What a page says, block by line; empty without a body."""
    return _each(tree.text, "string", pa.string())(html)


def markdown(html: Column) -> Column:
    """The content with headings as #, links, emphasis, lists, tables, quotes and preformatted text; empty without a body."""
    return _each(tree.markdown, "string", pa.string())(html)


def title(html: Column, default: str = "Untitled") -> Column:
    """The stripped title; the default only where there is no title element."""
    return _each(lambda events: tree.title(events, default), "string", pa.string())(html)


def links(html: Column) -> Column:
    """All hrefs of a page, in order, as they are written but for entities."""
    return _each(tree.links, "array<string>", pa.list_(pa.string()))(html)


#: What page() gives.
PAGE = pa.struct([("title", pa.string()), ("markdown", pa.string()), ("links", pa.list_(pa.string()))])


def page(html: Column) -> Column:
    """title, markdown and links of a page, which is read once."""
    return _each(lambda e: {"title": tree.title(e), "markdown": tree.markdown(e), "links": tree.links(e)}, "struct<title:string,markdown:string,links:array<string>>", PAGE)(html)
