"""Sections by heading, in Arrow batches, and long sections packed from paragraphs, as expressions inside a row."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import lexicon as X
from corvane.functions import text as T
from corvane.functions import urls as U
from corvane.runtime import ship

LINE_END = re.compile("\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")
HEADING = re.compile(r"(#{1,6})\s+(.*)$")


def pack(body: Column, most: int = X.CHUNK_MOST, separator: str = "\n\n") -> Column:
    """Non-blank paragraphs, packed greedily up to `most` characters; a paragraph is never split.

    A body of up to `most` characters, or without paragraphs, is one piece.
    """
    parts = F.filter(F.split(body, "\\Q" + separator + "\\E"), lambda p: T.strip(p) != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(s: Column, p: Column) -> Column:
        full = (s["now"] != "") & (F.char_length(s["now"]) + F.char_length(p) + len(separator) > most)
        done = F.when(full, F.concat(s["done"], F.array(T.strip(s["now"])))).otherwise(s["done"])
        now = F.when(full | (s["now"] == ""), p).otherwise(F.concat(s["now"], F.lit(separator), p))
        return F.struct(done.alias("done"), now.alias("now"))

    def finish(s: Column) -> Column:
        out = F.when(T.strip(s["now"]) != "", F.concat(s["done"], F.array(T.strip(s["now"])))).otherwise(s["done"])
        return F.when(F.size(out) > 0, out).otherwise(F.array(body))

    return F.when(F.char_length(body) > most, F.aggregate(parts, start, step, finish)).otherwise(F.array(body))


def sections_of(text: str) -> list[dict[str, str]]:
    """(crumb, body): the text under each heading that has any; without one, the whole text under ''.

    A crumb is the heading after those above it: of each level the last one, as long as no heading of a lesser level came since. Each line is looked at once.
    """
    above: list[tuple[int, str]] = []  # levels grow, so at most six
    out, crumb, lines = [], "", []

    def close() -> None:
        if body := "\n".join(lines).strip():
            out.append({"crumb": crumb, "body": body})

    for line in LINE_END.split(text):
        found = HEADING.match(bare) if (bare := line.strip()).startswith("#") else None
        if found is None:
            lines.append(line)
            continue
        close()
        level = len(found[1])
        while above and above[-1][0] >= level:
            above.pop()
        above.append((level, found[2].strip()))
        crumb, lines = " > ".join(name for _, name in above), []
    close()
    return out or [{"crumb": "", "body": text}]


def _sections(markdown: pa.Array) -> pa.Array:
    return pa.array([sections_of(x or "") for x in markdown.to_pylist()], pa.list_(pa.struct([("crumb", pa.string()), ("body", pa.string())])))


def sections(df: DataFrame, markdown: str, into: str) -> DataFrame:
    """df with `into`, the sections_of() its markdown; of a null those of an empty text. All columns of df go through Python, so it should have no others than are needed."""
    ship(df.sparkSession)
    at, schema = df.columns.index(markdown), df.withColumn(into, F.lit(None).cast("array<struct<crumb:string,body:string>>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, _sections(b.column(at))], names=schema.names)

    return df.mapInArrow(run, schema)


def breadcrumb(crumb: Column, title: Column) -> Column:
    """The page's title before the crumb, unless the crumb is the title or starts with it."""
    low, head = F.lower(T.strip(crumb)), F.lower(T.strip(title))
    return F.when(crumb == "", title).when((low == head) | F.startswith(low, F.concat(head, F.lit(" > "))), crumb).otherwise(F.concat(title, F.lit(" > "), crumb))


def chunk_pages(pages: DataFrame, key: str, title: str, markdown: str, most: int = X.CHUNK_MOST, least: int = X.CHUNK_LEAST) -> DataFrame:
    """One row for each chunk of at least `least` characters: all columns of pages, seq, section, chunk."""
    rows = sections(pages, markdown, "_sections").select("*", F.posexplode("_sections").alias("_s", "_section")).drop("_sections")
    rows = rows.select("*", F.posexplode(pack(F.col("_section.body"), most)).alias("_p", "_piece"))
    rows = rows.withColumn("chunk", T.strip(F.col("_piece"))).where(F.char_length("chunk") >= least)
    return rows.withColumn("section", breadcrumb(F.col("_section.crumb"), F.col(title))).withColumn("seq", F.col("_s").cast("long") * 1_000_000 + F.col("_p")).drop("_s", "_p", "_section", "_piece")


def page_hash(markdown: Column) -> Column:
    return F.sha2(markdown, 256)


def chunk_hash(url: Column, title: Column, section: Column, language: Column, body: Column) -> Column:
    """The key of a stored chunk: a digest of its stripped parts, a line each."""
    parts = [T.strip(F.coalesce(c, F.lit(""))) for c in (url, title, section, language, body)]
    return F.sha2(F.concat_ws("\n", *parts), 256)


def chunk_records(chunks: DataFrame, url: Column, title: Column, language: Column, markdown: Column, updated: Column) -> DataFrame:
    """Chunks of chunk_pages() as records for storing and citing."""
    return chunks.select(
        url.alias("url"), title.alias("title"), F.col("section"), U.category(url).alias("faculty"), F.coalesce(T.blank_to_null(language), F.lit("pl")).alias("language"),
        updated.alias("lastUpdated"), F.lit("website").alias("source"), page_hash(markdown).alias("content_hash"), F.col("chunk").alias("text"), F.col("seq"),
    )


def sparse_metadata(updated: Column, source: Column) -> Column:
    """A map of those that are neither null nor empty."""
    return F.map_filter(F.create_map(F.lit("lastUpdated"), updated, F.lit("source"), source), lambda k, v: v.isNotNull() & (v != ""))
