"""A stored index of vectors for approximate nearest neighbours by cosine similarity.

Cells are trained by k-means on a bounded sample; then every row goes to its nearest cell, and cells are the partitions of the stored
table. Beside its vector a row keeps a code, four bits for each component of how it differs from its cell's centroid. A search visits the cells nearest to each query, scores their
codes in the scan, keeps each task's best of a query, and reads the vectors of what is left (`refine` rows a query) from the partitions
that hold them. With exact=True a second pass visits every cell that can hold a better row by the cell's radius, and compares vectors, so
nothing is lost.

Cases: rows whose vector is null, empty, zero or of another length than the index's, or has a component that is null or not finite, have no similarity and aren't indexed;
null keys are; equal keys all are rows; ties go by key; an empty table makes an index without cells, in which nothing is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import vectors as V
from corvane.operators.vector import bounded_queries
from corvane.runtime import cut, ship

#: Cells at most, rows of the sample for each, rows that one file of a cell holds.
MOST_CELLS, SAMPLED, A_FILE = 4096, 256, 1_000_000
#: The share of the cells that a query visits, rows of which it reads the vectors, and queries that are sent to the tasks at once.
SHARE, REFINE, BLOCK = 0.3, 60, 10_000


@dataclass(frozen=True)
class Index:
    """A stored index: its folder, the vectors' length and the number of rows."""

    path: str
    size: int
    n: int
    kind: str  # of the keys


# ---- codes ----


def encode(rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two components a byte, each as one of 15 steps of the row's greatest; and what a step is worth."""
    step = np.maximum(np.abs(rest).max(axis=1), 1e-30) / 7
    q = np.rint(rest / step[:, None]).astype(np.int8) + 8
    if q.shape[1] % 2:
        q = np.concatenate([q, np.full((len(q), 1), 8, np.int8)], axis=1)
    return (q[:, ::2] << 4 | q[:, 1::2]).astype(np.uint8), step.astype(np.float32)


def decode(codes: np.ndarray, step: np.ndarray, size: int) -> np.ndarray:
    q = np.empty((len(codes), codes.shape[1] * 2), np.float32)
    q[:, ::2], q[:, 1::2] = codes >> 4, codes & 15
    return (q[:, :size] - 8) * step[:, None]


# ---- building ----


def usable(vector: Column, size: int | None = None) -> Column:
    fit = (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & (V.norm(vector) > 0)
    return F.coalesce(fit if size is None else fit & (F.size(vector) == size), F.lit(False))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _assigned(centroids: np.ndarray, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            u = _matrix(b.column(1), size)
            alike = u @ centroids.T
            cell = alike.argmax(axis=1)
            codes, step = encode(u - centroids[cell])
            raw = codes.tobytes()
            w = codes.shape[1]
            columns = [b.column(0), b.column(1), pa.array([raw[i * w : (i + 1) * w] for i in range(len(u))], pa.binary()), pa.array(step), pa.array(alike[np.arange(len(u)), cell]), pa.array(cell.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "vector", "code", "step", "alike", "cell"])

    return run


def train(rows: DataFrame, cells: int, seed: int = 3) -> np.ndarray:
    """Centroids of unit length, from at most SAMPLED rows a cell (key, vector) taken by hash."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = rows.count()
    if not n:
        return np.empty((0, 0))
    parts = max(1, n // (cells * SAMPLED))
    sample = rows.where(F.pmod(F.xxhash64("key", "vector"), F.lit(parts)) == 0).limit(2 * cells * SAMPLED)
    rows_ = cut(sample.select(array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("features")))
    model = KMeans(k=cells, seed=seed, maxIter=6, distanceMeasure="cosine").fit(rows_)
    found = np.array(model.clusterCenters())
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def build(table: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", cells: int | None = None, seed: int = 3) -> Index:
    """Stores the index of all rows under `path`; its list of cells comes last. Without `cells` there are as many as the square root of the rows, MOST_CELLS at most."""
    spark = table.sparkSession
    ship(spark)
    first = table.select(F.col(vector).alias("v")).where(usable(F.col("v"))).select(F.size("v").alias("size")).groupBy("size").count().orderBy(F.desc("count"), "size").first()
    size = first["size"] if first else 0
    rows = table.select(F.col(key).alias("key"), F.col(vector).alias("vector")).where(usable(F.col("vector"), size))
    n = first["count"] if first else 0
    centroids = train(rows, cells or min(MOST_CELLS, max(1, round(n**0.5))), seed)
    schema = rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("code", "binary"), ("step", "float"), ("alike", "double"), ("cell", "int"))]).schema
    made = rows.mapInArrow(_assigned(centroids, size), schema) if n else spark.createDataFrame([], schema)
    made.withColumn("file", F.pmod(F.xxhash64("key"), F.lit(max(1, n // (max(1, len(centroids)) * A_FILE))))).repartition("cell", "file").drop("file").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    about = spark.read.schema("alike double, cell int").parquet(f"{path}/rows").groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.min("alike").alias("least"))
    heads = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
    heads.join(about, "cell").withColumn("size", F.lit(size)).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    told = spark.read.parquet(f"{path}/cells").agg(F.coalesce(F.max("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()
    kind = spark.read.parquet(f"{path}/rows").schema["key"].dataType.simpleString() if told["n"] else "bigint"
    return Index(path, told["size"], told["n"], kind)


def cells(spark: SparkSession, index: Index) -> DataFrame:
    """cell, centroid, rows, least (the smallest similarity of a row to its centroid), size."""
    return spark.read.parquet(f"{index.path}/cells")


# ---- searching ----


class Best:
    """The best `keep` rows of each query so far, as arrays that are cut when they have grown to twice that."""

    def __init__(self, queries: int, keep: int):
        self.keep = keep
        self.rows: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(queries)]
        self.held, self.floor = np.zeros(queries, np.int64), np.full(queries, -np.inf)

    def add(self, q: int, score: np.ndarray, cell: int, at: np.ndarray) -> None:
        ok = score >= self.floor[q]
        if ok.any():
            self.rows[q].append((score[ok], np.full(int(ok.sum()), cell), at[ok]))
            self.held[q] += int(ok.sum())
            if self.held[q] > 4 * self.keep:
                self._cut(q)

    def _cut(self, q: int) -> None:
        score, cell, at = map(np.concatenate, zip(*self.rows[q], strict=True))
        if len(score) > self.keep:
            floor = np.partition(score, len(score) - self.keep)[len(score) - self.keep]
            best = score >= floor - 1e-9  # rows that tie with the last stay
            score, cell, at, self.floor[q] = score[best], cell[best], at[best], floor - 1e-9
        self.rows[q], self.held[q] = [(score, cell, at)], len(score)

    def all(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for q in range(len(self.rows)):
            if self.rows[q]:
                self._cut(q)
                yield q, *self.rows[q][0]


def _scores(sent, size: int, keep: int, exact: bool):
    """Scans rows (key, code or vector, step, cell); gives the task's best (place of the query, key, cell, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, visits, heads = sent.value
        best, keys, start = Best(len(units), keep), [], 0
        for b in batches:
            if not b.num_rows:
                continue
            if exact:
                rows = _matrix(b.column(1), size)
            else:
                raw = b.column(1)
                rows = decode(np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(b.num_rows, -1), b.column(2).to_numpy(), size)
            of = b.column(3).to_numpy()
            for c in np.unique(of).tolist():
                own = np.flatnonzero(of == c)
                asked = visits.get(c, ())
                if len(asked):
                    base = 0 if exact else (units[asked] @ heads[c])[:, None]  # codes are of what is left beside the centroid
                    for q, s in zip(asked, base + units[asked].astype(rows.dtype) @ rows[own].T, strict=True):
                        best.add(q, s, c, start + own)
            keys.append(b.column(0))
            start += b.num_rows
        if keys:
            every = pa.chunked_array(keys)
            for q, score, cell, at in best.all():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), q)), every.take(pa.array(at)).combine_chunks(), pa.array(cell.astype(np.int32)), pa.array(score.astype(np.float64))], names=["place", "key", "cell", "score"])

    return run


def _visits(units: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """For each query, which of the cells are its nearest `probes`."""
    alike = units @ centroids.T
    out = np.zeros(alike.shape, bool)
    np.put_along_axis(out, np.argsort(-alike, axis=1, kind="stable")[:, :probes], True, axis=1)
    return out


def _within(units: np.ndarray, centroids: np.ndarray, least: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Which cells can hold a row at least as near as floor: the angle to the centroid less the cell's own is a bound."""
    angle = np.arccos(np.clip(units @ centroids.T, -1, 1)) - np.arccos(np.clip(least, -1, 1)) - 1e-9
    return np.cos(np.clip(angle, 0, np.pi)) >= floor[:, None] - 1e-9


def _scan(spark: SparkSession, index: Index, units: np.ndarray, visit: np.ndarray, centroids: dict[int, np.ndarray], keep: int, exact: bool) -> DataFrame:
    cell = np.array(list(centroids))
    wanted = cell[visit.any(axis=0)].tolist()
    visits = {c: np.flatnonzero(visit[:, k]) for k, c in enumerate(cell.tolist()) if visit[:, k].any()}
    sent = spark.sparkContext.broadcast((units, visits, centroids))
    rows = spark.read.parquet(f"{index.path}/rows").where(F.col("cell").isin(wanted)).select("key", "vector" if exact else "code", "step", "cell")
    return rows.mapInArrow(_scores(sent, index.size, keep, exact), f"place long, key {index.kind}, cell int, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("place").orderBy(F.round("score", 9).desc(), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(spark: SparkSession, index: Index, queries: DataFrame, k: int, share: float = SHARE, refine: int = REFINE, exact: bool = False, most: int = BLOCK) -> DataFrame:
    """q, key, similarity (clamped to 0..1) and rank of the k nearest rows of each query (q, vector), of those that its cells' codes let through.

    share: of the cells, how many a query visits, nearest first; refine: rows of which it reads the vectors. exact: as vector.nearest(), with the cells'
    bounds in place of a whole scan. Queries are a stated set; more than `most` are taken in blocks.
    """
    return reduce(DataFrame.unionByName, [_search(spark, index, block, k, share, max(refine, k), exact) for block in bounded_queries(queries, most)])


def _search(spark: SparkSession, index: Index, queries: DataFrame, k: int, share: float, refine: int, exact: bool) -> DataFrame:
    kind = f"q {queries.schema['q'].dataType.simpleString()}, key {index.kind}, similarity double, rank int"
    own = queries.select("q", "vector").where(usable(F.col("vector"), index.size)).toArrow() if index.n else None
    if own is None or not own.num_rows:
        return spark.createDataFrame([], kind)
    ship(spark)
    units = np.concatenate([_matrix(c, index.size) for c in own["vector"].chunks if len(c)])
    told = cells(spark, index).orderBy("cell").toArrow()
    cell, least = told["cell"].to_numpy(), told["least"].to_numpy()
    centroids = np.array(told["centroid"].to_pylist())
    heads = dict(zip(cell.tolist(), centroids, strict=True))
    visit = _visits(units, centroids, max(1, round(share * len(cell))))
    near = _top(_scan(spark, index, units, visit, heads, k if exact else refine, exact), k if exact else refine)
    names = spark.createDataFrame(pa.table({"place": pa.array(np.arange(len(units))), "q": own["q"].combine_chunks()}))
    if exact:
        near = cut(near)
        floor = np.full(len(units), -np.inf)
        for r in near.where(F.col("rank") == k).select("place", "score").collect():
            floor[r["place"]] = r["score"]
        more = _within(units, centroids, least, floor) & ~visit
        if more.any():
            near = near.drop("rank").unionByName(_top(_scan(spark, index, units, more, heads, k, True), k).drop("rank"))
        scored = near.select("place", "key", V.clamp(F.col("score")).alias("score"))
    else:
        # the vectors of what is left, from the partitions that hold them
        near = cut(near.select("place", "key", "cell").distinct())
        asked = F.broadcast(names.join(queries.select("q", F.col("vector").alias("u")), "q").select("place", "u"))
        held = [r["cell"] for r in near.select("cell").distinct().collect()]
        rows = spark.read.parquet(f"{index.path}/rows").where(F.col("cell").isin(held)).select("key", "cell", "vector")
        some = near.select("key", "cell").distinct()
        rows = rows.join(F.broadcast(some), rows["key"].eqNullSafe(some["key"]) & (rows["cell"] == some["cell"]), "left_semi")
        pairs = near.join(rows.withColumnRenamed("key", "own"), (F.col("key").eqNullSafe(F.col("own"))) & (near["cell"] == rows["cell"])).join(asked, "place")
        scored = pairs.select("place", "key", V.clamp(V.cosine(F.col("vector"), F.col("u"))).alias("score"))
    return _top(scored, k).join(F.broadcast(names), "place").select("q", "key", F.col("score").alias("similarity"), "rank")
