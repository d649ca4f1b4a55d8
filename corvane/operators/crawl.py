"""Crawling as DataFrame operations: allow rules, routing, and breadth-first search over a link table."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import urls as U
from corvane.runtime import cut, ship


def allowed_by_rules(pages: DataFrame, url: str, rules: DataFrame) -> DataFrame:
    """pages with `allowed`: by rules (host, prefix, allow) the longest prefix of the path decides; hosts without rules allow all."""
    rows = pages.withColumn("_host", U.bare_host(F.col(url)))
    own = rules.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.char_length("prefix")).alias("n"), F.col("allow"), "prefix"))).alias("_rules"))
    # one row for each host that has rules; a site's own rules are few
    rows = rows.join(own, F.col("_host") == F.col("host"), "left").drop("host", "_host")
    fits = F.filter("_rules", lambda r: F.startswith(U.path(F.col(url)), r["prefix"]))
    most = F.get(fits, F.lit(0))["n"]
    verdict = F.exists(F.filter(fits, lambda r: r["n"] == most), lambda r: r["allow"])
    return rows.withColumn("allowed", F.when(F.col("_rules").isNull() | (F.size(fits) == 0), F.lit(True)).otherwise(verdict)).drop("_rules")


def robots_lines(body: str, agent: str) -> list[tuple[str, bool]]:
    """(prefix, allow) of the robots.txt lines that hold for an agent, in their order.

    The first group that names a part of the agent's own name holds, else the first group for all (*); groups are parted
    by agent lines after rules and by empty lines. A Disallow line without a path allows everything.
    """
    groups: list[tuple[list[str], list[tuple[str, bool]]]] = []
    names: list[str] = []
    rules: list[tuple[str, bool]] = []
    for line in [*body.splitlines(), ""]:
        bare = line.split("#", 1)[0].strip()
        field, colon, value = (x.strip() for x in bare.partition(":"))
        field = field.lower()
        if not line.strip() or (field == "user-agent" and rules):
            if names and rules:
                groups.append((names, rules))
            names, rules = [], []
        if not colon:
            continue
        if field == "user-agent":
            names.append(value.lower())
        elif field in ("allow", "disallow") and names:
            rules.append((unquote(value), field == "allow" or not value))
    own = agent.split("/")[0].lower()
    for names, rules in groups:
        if any(n != "*" and n in own for n in names) and "*" not in names:
            return rules
    return next((rules for names, rules in groups if "*" in names), [])


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """Rules (host, prefix, allow, place) from robots.txt files (host, body); a null body gives none. For allowed_in_order()."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(h, *rule, k) for h, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, rule in enumerate(robots_lines(body or "", agent))]
            kinds = {"host": pa.string(), "prefix": pa.string(), "allow": pa.bool_(), "place": pa.int32()}
            yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(kinds.items())})

    return files.select("host", "body").mapInArrow(run, "host string, prefix string, allow boolean, place int")


def allowed_in_order(pages: DataFrame, url: str, rules: DataFrame) -> DataFrame:
    """pages with `allowed`: of the host's rules the first whose prefix fits path and query decides; without one all is allowed. Prefixes are plain text, without wildcards."""
    rows = pages.withColumn("_host", U.bare_host(F.col(url)))
    own = rules.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "prefix", "allow"))).alias("_rules"))
    rows = rows.join(own, F.col("_host") == F.col("host"), "left").drop("host", "_host")
    rest = F.regexp_extract(F.col(url), "^[^:/?#]+://[^/?#]*([^#]*)", 1)
    # escapes are read as the characters that they stand for, as in the rules; a + is no escape
    target = F.coalesce(F.try_url_decode(F.replace(F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest)), F.lit("+"), F.lit("%2B"))), rest)
    fits = F.filter("_rules", lambda r: F.startswith(target, r["prefix"]))
    return rows.withColumn("allowed", F.coalesce(F.get(fits, F.lit(0))["allow"], F.lit(True))).drop("_rules")


def fetch_ladder(*attempts: Column) -> tuple[Column, Column]:
    """The first attempt that gave anything, and its place from 0 (null where none did)."""
    body = F.coalesce(*[F.nullif(a, F.lit("")) for a in attempts])
    chain = F.lit(None).cast("int")
    for i, a in reversed(list(enumerate(attempts))):
        chain = F.when(F.nullif(a, F.lit("")).isNotNull(), F.lit(i)).otherwise(chain)
    return body, chain


def route(links: DataFrame, url: str, domains: list[str]) -> DataFrame:
    """links with `route`: pdf (allowed domains only, tested before the skip rules), page, skipped or foreign; and `target`."""
    u = F.col(url)
    kind = F.when(~U.is_allowed(u, domains), "foreign").when(U.is_pdf(u), "pdf").when(U.is_skipped(u), "skipped").otherwise("page")
    return links.withColumn("route", kind).withColumn("target", F.when(F.col("route") == "pdf", U.without_fragment(u)).when(F.col("route") == "page", U.normalize(u)))


def frontier(edges: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """Breadth-first levels: node, level of all nodes that `start` (node) reaches over edges (src, dst), within `depth` steps if that is given.

    Each round joins the last level only and drops what was visited; its result is stored, so rounds don't compute each other again. While a level, and what
    it leads to, are narrow rows of a checked number (FEW), they go to the edges and to the visited nodes, which stay where they are: what is exchanged follows the
    frontier. A wider level is joined by an exchange. Null nodes lead nowhere and aren't reached.
    """
    last = cut(start.select("node").where("node is not null").distinct().withColumn("level", F.lit(0).cast("long")))
    seen, size = last, last.count()
    for n in count(1) if depth is None else range(1, depth + 1):
        step = cut(_steps(edges, last, size).distinct())
        wide = step.count()
        last = cut(step.join(_small(_known(seen, step, wide), wide), "node", "left_anti").withColumn("level", F.lit(n).cast("long")))
        size = last.count()
        if not size:
            break
        seen = seen.unionByName(last)
    return seen


#: Nodes up to which a level goes to all tasks, some 50 bytes each.
FEW = 1_000_000


def _small(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= FEW else rows


def _steps(edges: DataFrame, last: DataFrame, n: int) -> DataFrame:
    """The nodes that a level of n leads to."""
    return edges.join(_small(last, n), F.col("node") == F.col("src")).where("dst is not null").select(F.col("dst").alias("node"))


def _known(seen: DataFrame, step: DataFrame, n: int) -> DataFrame:
    """Those of n distinct nodes that were visited; no more than n rows."""
    return seen.select("node").join(_small(step, n), "node", "left_semi")


def budget(visits: DataFrame, per: str, most: int, *order: str) -> DataFrame:
    """The first `most` visits for each value of `per`: a crawl's allowance."""
    return visits.withColumn("_n", F.row_number().over(W.partitionBy(per).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def merge_crawls(pages: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """One row for each key: the last crawl's values, at the place where the key was first seen (`first`)."""
    return pages.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(F.col(order).isNotNull(), F.col(order))).alias("v"), F.min(order).alias("first")).select(key, *[F.col(f"v.{v}").alias(v) for v in values], "first")
