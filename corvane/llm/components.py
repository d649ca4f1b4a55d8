"""Connected components of a distributed edge list, by alternating star contractions.

Large star: every node hands its larger neighbours its smallest neighbour; small star: it hands its
smaller ones the smallest of them. Both keep the components and shorten paths; when a round changes
nothing, every node hangs on the smallest of its component. Minima are combined before the exchange,
and no node's neighbours are gathered in one place. A round's tasks are as many as its edges are worth,
since each of them writes files for each exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TASKS, cut, packed, stored

__all__ = ["TASKS", "connected_components"]

#: Edges of one task; TASKS is what the fewest edges get.
EDGES = 50_000


def _mark(df: DataFrame) -> tuple[int, int, int]:
    got = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1))), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
    return tuple(got)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b: long, not null) to (node, root): every node of an edge with the smallest node of its component."""
    now, _ = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), EDGES)
    mark = _mark(now)

    def few(df: DataFrame) -> DataFrame:
        return packed(df, mark[0], EDGES)  # mark is of the round before

    for _ in range(rounds):
        if not mark[0]:
            break
        # large star: a is the larger end of each edge, so b is among its neighbours
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = few(both.groupBy("a").agg(F.min("b").alias("m"))).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = now.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = few(few(large).distinct())
        # small star: each node with its smaller neighbours
        least = few(large.groupBy("a").agg(F.min("b").alias("m"))).select(F.col("a").alias("u"), "m")
        small = few(large.select(F.col("a").alias("u"), F.col("b").alias("v")).join(least, "u"))
        nxt = small.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e"))
        nxt = cut(few(nxt.select("e.a", "e.b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()))
        new = _mark(nxt)
        now, same, mark = nxt, new == mark, new
        if same:
            break
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    roots = few(now.groupBy("a").agg(F.min("b").alias("root"))).select(F.col("a").alias("node"), "root")
    tops = few(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    return few(roots.unionByName(few(tops.join(roots.select("node"), "node", "left_anti"))).distinct())
