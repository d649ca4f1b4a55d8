"""Exact nearest neighbours by cosine similarity, and the pieces of a vector index.

Queries are a stated set: they are sent to every task of the table's scan, and each task keeps its best k of
each query before anything is exchanged. Similarities are sums in double precision: products of matrices tell which rows
can be among the k best, and of these the sums are made again in order, so equal vectors have equal similarities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import best
from corvane.runtime import ship

#: Queries that go to the tasks at once; more are taken in blocks.
BLOCK = 10_000


def nearest(table: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", same: str | None = None, most: int = BLOCK) -> DataFrame:
    """q, key, similarity (clamped to 0..1), rank of the k nearest rows of every query (q, vector, and `same` if rows must agree in it).

    Ties go by key. Queries are counted, and beyond `most` they go to the tasks block by block. With `same`, only rows with the queries' own
    values are read: of a table that store_by() wrote, only the partitions that hold them.
    """
    return reduce(DataFrame.unionByName, [_nearest(table, block, k, key, vector, same) for block in bounded_queries(queries, most)])


def _nearest(table: DataFrame, queries: DataFrame, k: int, key: str, vector: str, same: str | None) -> DataFrame:
    if same:
        table = table.where(F.col(same).isin([r[0] for r in queries.select(same).where(F.col(same).isNotNull()).distinct().collect()]))  # no more values than queries in a block
    spark = table.sparkSession
    ship(spark)
    asked = queries.select("q", F.col("vector").cast("array<double>").alias("u"), *([F.col(same).alias("s")] if same else [])).collect()  # a block of queries
    groups: dict[tuple, tuple[list[int], list]] = {}
    for i, r in enumerate(asked):
        if r["u"] and None not in r["u"]:
            if not same or r["s"] is not None:
                held = groups.setdefault((r["s"] if same else None, len(r["u"])), ([], []))
                held[0].append(i)
                held[1].append(r["u"])
    sent = spark.sparkContext.broadcast({g: (np.array(i), np.array(u, np.float64)) for g, (i, u) in groups.items()})
    rows = table.select(F.col(key).alias("ord"), F.col(vector).cast("array<double>").alias("v"), *([F.col(same).alias("s")] if same else []))
    found = rows.mapInArrow(_scorer(sent, len(asked), k), f"i int, ord {rows.schema['ord'].dataType.simpleString()}, score double")
    names = spark.createDataFrame([(i, r["q"]) for i, r in enumerate(asked)], f"i int, q {queries.schema['q'].dataType.simpleString()}")
    scored = found.join(F.broadcast(names), "i").select("q", F.col("ord").alias("key"), F.col("score").alias("similarity"))
    order = W.partitionBy("q").orderBy(F.round("similarity", 9).desc(), "key")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt(np.cumsum(m * m, axis=1)[:, -1])


def _clamped(c: np.ndarray) -> np.ndarray:
    """0 to 1; what is no number counts as the greatest, as in Spark's order."""
    return np.where(np.isnan(c), 1.0, np.clip(c, 0.0, 1.0))


def _scorer(sent, asked: int, k: int):
    """Scores batches of rows for all queries; yields the best of each query once, at the end of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, floor = None, np.full(asked, -np.inf)
        for b in batches:
            lists = b.column(1)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            start = np.cumsum(size) - size
            values = flat.to_numpy(zero_copy_only=False)
            usable = size > 0
            if flat.null_count:
                usable[np.repeat(np.arange(len(size)), size)[flat.is_null().to_numpy(zero_copy_only=False)]] = False
            of = b.column(2).to_pylist() if b.num_columns > 2 else None
            for (s, length), (who, u) in sent.value.items():
                rows = np.flatnonzero(usable & (size == length))
                if of is not None:
                    rows = np.array([r for r in rows.tolist() if of[r] == s], np.int64)
                nu = _norms(u)
                step = max(1, best.CELLS // len(who))
                for a in range(0, len(rows), step):
                    own = rows[a : a + step]
                    v = values[start[own][:, None] + np.arange(length)]
                    nv = _norms(v)
                    with np.errstate(all="ignore"):
                        scale = nv[:, None] * nu
                        near = _clamped((v @ u.T) / scale)
                        near[scale == 0] = -1.0
                        passing = near >= np.maximum(floor[who] - best.NEAR, 0.0)
                        if len(own) > k and np.count_nonzero(passing) > 2 * k * len(who):
                            passing &= near >= np.partition(near, len(own) - k, axis=0)[len(own) - k] - best.NEAR
                        row, col = np.nonzero(passing)
                        for c in range(0, len(row), 50_000):
                            r, q = row[c : c + 50_000], col[c : c + 50_000]
                            score = _clamped(np.cumsum(v[r] * u[q], axis=1)[:, -1] / (nv[r] * nu[q]))
                            new = pa.table({"i": pa.array(who[q], pa.int32()), "ord": b.column(0).take(pa.array(own[r])), "score": score})
                            kept, floor = best.keep(new if kept is None else pa.concat_tables([kept, new]), k, floor)
        if kept is not None:
            yield from kept.combine_chunks().to_batches()

    return run


def store_by(table: DataFrame, path: str, same: str, files: int = 1) -> DataFrame:
    """The table stored in partitions by a column (a language, say), each in as many files; what is read back."""
    dealt = table.withColumn("_file", F.pmod(F.xxhash64(*[c for c in table.columns if c != same][:1]), F.lit(files)))
    dealt.repartition(F.col(same), F.col("_file")).drop("_file").write.mode("overwrite").partitionBy(same).parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def bounded_queries(queries: DataFrame, most: int = BLOCK) -> list[DataFrame]:
    """Queries in blocks of a checked size, for tables of queries of any length."""
    n = queries.count()
    blocks = max(1, -(-n // most))
    return [queries] if blocks == 1 else [queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b) for b in range(blocks)]


def top_similarity(found: DataFrame) -> DataFrame:
    """q, top: the greatest similarity of each query."""
    return found.groupBy("q").agg(F.max("similarity").alias("top"))


def embedding_text(title: Column, section: Column, faculty: Column, body: Column) -> Column:
    """What is embedded for a chunk: its non-empty parts, a line each."""
    return T.join_parts("\n", title, section, faculty, body)


def embed(chunks: DataFrame, text: Column, embedder: Callable[[list[str]], list[list[float]]], dimension: int, batch: int = 32) -> DataFrame:
    """chunks with an `embedding`, by a callable that takes texts in batches; another length than `dimension` raises."""
    ship(chunks.sparkSession)
    rows = chunks.withColumn("_text", text)
    at = rows.columns.index("_text")
    schema = rows.drop("_text").withColumn("embedding", F.lit(None).cast("array<float>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            found = [v for i in range(0, len(texts), batch) for v in embedder(texts[i : i + batch])]
            if len(found) != len(texts) or any(len(v) != dimension for v in found):
                raise ValueError(f"the embedder must give one vector of {dimension} numbers for each text")
            columns = [c for i, c in enumerate(b.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(pa.float32()))], names=schema.names)

    return rows.mapInArrow(run, schema)


class HashEmbedder:
    """A deterministic embedder without a model: signed hashed words, of length one."""

    def __init__(self, dimension: int = 384):
        self.dimension = dimension

    def __call__(self, texts: list[str]) -> list[list[float]]:
        import re
        import zlib

        out = []
        for t in texts:
            v = [0.0] * self.dimension
            for w in re.findall(r"[^\W_]+", (t or "").casefold()):
                h = zlib.crc32(w.encode())
                v[h % self.dimension] += 1.0 if h >> 31 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out


def build_embedder(provider: str, dimension: int = 384, client: Callable | None = None) -> Callable[[list[str]], list[list[float]]]:
    """"hash" needs nothing; "local" and "remote" need a callable that embeds a list of texts."""
    if provider == "hash":
        return HashEmbedder(dimension)
    if provider in ("local", "remote"):
        if client is None:
            raise ValueError(f"the {provider} provider needs a callable")
        return client
    raise ValueError(f"unknown provider of embeddings: {provider}")

