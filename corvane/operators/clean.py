"""Cleaning of text blocks, as expressions inside a row: nothing is exchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import html as H
from corvane.functions import lexicon as X
from corvane.functions import text as T


def contains_any(c: Column, markers: list[str]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(c, F.lit(m))
    return out


def count_markers(c: Column, markers: list[str]) -> Column:
    return sum((F.contains(c, F.lit(m)).cast("int") for m in markers), F.lit(0))


def found_markers(c: Column, markers: list[str]) -> Column:
    """The markers that the text holds, whatever their case, in the markers' order."""
    return F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(F.lower(c), F.lower(m)))


def dedupe_blocks(df: DataFrame, text: str, into: str, separator: str = "\n\n") -> DataFrame:
    """df with `into`: the text's blocks, stripped; of blocks that are equal but for white space the first stays, blank ones go.

    Blocks are sorted by their key within the row, so long texts take n log n steps.
    """
    blocks = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), _literal(separator)), lambda b, i: F.struct(T.squeeze(b).alias("key"), i.alias("at"), T.strip(b).alias("block")))

    def join(some: Column) -> Column:
        first = F.filter(some, lambda b, i: (i == 0) | (F.get(some, i - 1)["key"] != b["key"]))
        kept = F.array_sort(F.transform(first, lambda b: F.struct(b["at"].alias("at"), b["block"].alias("block"))))
        return F.array_join(F.transform(kept, lambda b: b["block"]), separator)

    return df.withColumn(into, T.let(F.array_sort(F.filter(blocks, lambda b: b["key"] != "")), join))


def _literal(s: str) -> str:
    return "\\Q" + s + "\\E"


def remove_noise(c: Column) -> Column:
    """Without the first countdown widget, and without blocks that are countdowns or consent banners."""
    pattern = "(?isu)" + X.COUNTDOWN_WIDGET

    def unhook(t: Column) -> Column:
        at, n = F.regexp_instr(t, F.lit(pattern)), F.char_length(F.regexp_extract(t, pattern, 0))
        return F.when(at > 0, F.concat(F.substr(t, F.lit(1), at - 1), F.substr(t, at + n))).otherwise(t)

    c = T.let(F.coalesce(c, F.lit("")), unhook)
    blocks = F.transform(F.split(c, r"(?U)\n\s*\n"), T.strip)

    def keep(b: Column) -> Column:
        def fine(low: Column) -> Column:
            return (count_markers(low, X.COUNTDOWN_MARKERS) < 2) & ~(contains_any(low, X.COOKIE_MARKERS) & contains_any(low, X.CONSENT_MARKERS))

        return (b != "") & T.let(F.lower(T.squeeze(b)), fine)

    return F.array_join(F.filter(blocks, keep), "\n\n")


def clean_text(df: DataFrame, text: str, into: str) -> DataFrame:
    """Noise removed, blank lines collapsed, blocks made distinct."""
    out = df.withColumn("_clean", F.regexp_replace(remove_noise(F.col(text)), r"\n{3,}", "\n\n"))
    return dedupe_blocks(out, "_clean", into).drop("_clean")


def clean_html(df: DataFrame, html: str, into: str) -> DataFrame:
    """A page's content as cleaned markdown."""
    return clean_text(df.withColumn("_md", H.markdown(F.col(html))), "_md", into).drop("_md")


def with_dynamic(markdown: Column, dynamic: Column, heading: str) -> Column:
    """A rendered section under a heading of its own, after the page's cleaned text; only where there is one."""
    extra = T.strip(F.coalesce(dynamic, F.lit("")))
    return F.when(extra != "", F.concat(markdown, F.lit(f"\n\n## {heading}\n\n"), extra)).otherwise(markdown)


def price_ready(c: Column) -> Column:
    """A rendered price, neither the placeholder nor raw data."""
    return c.rlike("(?iu)" + X.PRICE_PATTERN) & ~F.contains(c, F.lit(X.PRICE_PENDING)) & ~F.contains(c, F.lit(X.PRICE_RAW))


def is_price_response(url: Column) -> Column:
    return contains_any(F.lower(url), X.RESPONSE_KEYWORDS)


def keyword_context(df: DataFrame, key: str, text: str, keywords: list[str], around: int = 3, separator: str = "\n") -> DataFrame:
    """key, line, window: for each line with a keyword the lines up to `around` before and after it; windows may overlap."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), _literal(separator))
    rows = df.select(F.col(key), lines.alias("lines"))
    rows = rows.select(key, "lines", F.posexplode("lines").alias("line", "own")).where(contains_any(F.lower("own"), [k.lower() for k in keywords]))
    first = F.greatest(F.col("line") - around, F.lit(0))
    return rows.select(key, F.col("line").cast("long").alias("line"), F.slice("lines", first + 1, F.col("line") + around + 1 - first).alias("window"))
