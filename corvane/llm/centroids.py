"""Lloyd's rounds over integer vectors with two trees.

Vectors are gathered in blocks, and each block gets a cover tree: a node's children are picked farthest first until all
of its points lie within the children's level, which shrinks by SHRINK from level to level. The blocks are written once, as
rows of bytes in a table of the shared folder. A round sends the centroids (as many as there are clusters, a parameter) to all
tasks, which make a tree over them and walk pairs of nodes of both trees, breadth first. A pair goes when its least distance is
above the greatest distance from the vectors' node to any centroid; a node of vectors that only one centroid is left for adds
its stored sums at once; where leaves meet, vectors and centroids are compared exactly.

All decisions are exact: components are whole numbers, bounds have room for rounding, and where numbers are too large for
exact floating point they are compared as Python's integers. Sums travel as limbs of 32 bits, so they don't overflow.

Cases: rows whose vector is null, has another length, or holds a null, NaN or infinite component (or one that overflows when scaled)
are left out; null ids take part and are last among those that may be centroids at the start; equal ids or equal vectors
all count; fewer vectors than clusters make fewer clusters; an empty table gives no rows; other columns aren't read. A distance or an
inertia that doesn't fit a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_table, quoted, ship

SIZE, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Vectors of a block and of a leaf; by how much a level of a tree is narrower than the one above.
BLOCK, LEAF, SHRINK = 2048, 8, 0.7
#: Components up to which distances of SIZE components are exact in floating point.
EXACT = 1 << 22
LIMBS = 6


# ---- trees ----


class Tree:
    """A cover tree over the rows of points. Nodes stand level by level: centre (a row), radius, and the range [a, b) of `order` below each."""

    def __init__(self, points: np.ndarray, leaf: int):
        n = len(points)
        order = np.arange(n)
        nodes, kids = [], []
        todo = [(0, n, 0, np.linalg.norm(points - points[0], axis=1), None, -1)] if n else []
        while todo:
            a, b, centre, away, level, parent = todo.pop()
            radius = float(away.max())
            me = len(nodes)
            nodes.append((centre, radius, a, b))
            kids.append([])
            if parent >= 0:
                kids[parent].append(me)
            if b - a <= leaf or radius == 0:
                continue
            level = (radius if level is None else min(level, radius)) * SHRINK
            own = order[a:b].copy()
            near, owner, heads = away.copy(), np.zeros(b - a, np.int64), [centre]
            while near.max() > level:
                k = int(near.argmax())
                heads.append(int(own[k]))
                d = np.linalg.norm(points[own] - points[own[k]], axis=1)
                closer = d < near
                near[closer], owner[closer] = d[closer], len(heads) - 1
            by = np.argsort(owner, kind="stable")
            order[a:b], near = own[by], near[by]
            ends = np.searchsorted(owner[by], np.arange(len(heads) + 1))
            for h, (i, j) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                todo.append((a + i, a + j, heads[h], near[i:j], level, me))
        self.order = order
        self.centre = np.array([x[0] for x in nodes], np.int64)
        self.radius = np.array([x[1] for x in nodes])
        self.a, self.b = (np.array([x[k] for x in nodes], np.int64) for k in (2, 3))
        self.many = np.array([len(k) for k in kids], np.int64)
        self.first = np.cumsum(self.many) - self.many
        self.kids = np.array([k for ks in kids for k in ks], np.int64)

    def pack(self) -> bytes:
        return np.concatenate([[len(self.centre)], self.order, self.centre, self.radius.view(np.int64), self.a, self.b, self.many, self.first, self.kids]).astype("<i8").tobytes()

    @classmethod
    def unpack(cls, blob: bytes, n: int) -> Tree:
        x, out = np.frombuffer(blob, "<i8"), cls.__new__(cls)
        m, x = int(x[0]), x[1:]
        out.order, x = x[:n], x[n:]
        out.centre, out.radius, out.a, out.b, out.many, out.first = x[:m], x[m : 2 * m].view(np.float64), *(x[k * m : (k + 1) * m] for k in range(2, 6))
        out.kids = x[6 * m :]
        return out


def spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[0] and so on up, many[0] numbers, then first[1] and so on."""
    return np.repeat(first - np.cumsum(many) + many, many) + np.arange(int(many.sum()))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows x[i] and y[i]: whole numbers as floats, or Python's integers if these are too large."""
    if x.dtype != object and (not len(x) or max(np.abs(x).max(), np.abs(y).max()) <= EXACT):
        return ((x - y) ** 2).sum(axis=1)
    d = whole(x) - whole(y)
    return (d * d).sum(axis=1)


def whole(x: np.ndarray) -> np.ndarray:
    """x as Python's integers."""
    return x if x.dtype == object else np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def nearest(points: np.ndarray, tree: Tree, centroids: np.ndarray, over: Tree) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """For each node of tree the centroid that all below it have (or -1), for each place of its order likewise, and what was compared.

    points are floats; centroids may be Python's integers.
    """
    near = centroids.astype(np.float64)
    node, place = np.full(len(tree.centre), -1, np.int64), np.full(len(points), -1, np.int64)
    told = {"pairs": 0, "pruned": 0, "exact": 0}
    q, r = np.zeros(min(1, len(points)), np.int64), np.zeros(min(1, len(points)), np.int64)
    size = max([1.0, *(float(np.abs(x).max()) for x in (points, near) if x.size)])
    while len(q):
        told["pairs"] += len(q)
        d = np.linalg.norm(points[tree.centre[q]] - near[over.centre[r]], axis=1)
        wide, rim = tree.radius[q], over.radius[r]
        room = 1e-9 * (d + wide + rim) + 1e-11 * size
        most = np.full(len(tree.centre), np.inf)
        np.minimum.at(most, q, d + wide + room)
        keep = d - wide - rim - room <= most[q]
        told["pruned"] += int((~keep).sum())
        q, r, wide, rim = q[keep], r[keep], wide[keep], rim[keep]
        # a node of vectors is done when one centroid is left; else the wider one of both nodes is opened
        left, inner = np.zeros((2, len(tree.centre)), np.int64)
        np.add.at(left, q, over.b[r] - over.a[r])
        done = left[q] == 1
        node[q[done]] = over.order[over.a[r[done]]]
        q, r, wide, rim = q[~done], r[~done], wide[~done], rim[~done]
        np.maximum.at(inner, q, (over.many[r] > 0).astype(np.int64))
        broad = np.zeros(len(tree.centre))
        np.maximum.at(broad, q, np.where(over.many[r] > 0, rim, 0))
        split_r = (inner[q] > 0) & ((broad[q] >= wide) | (tree.many[q] == 0))
        ends = ~split_r & (tree.many[q] == 0)
        if ends.any():
            _leaves(points, tree, centroids, over, q[ends], r[ends], place, told)
        split_q = ~split_r & ~ends
        # a centroids' leaf stays as it is while its neighbours are opened
        many = np.maximum(over.many[r[split_r]], 1)
        at = spread(np.where(over.many[r[split_r]] > 0, over.first[r[split_r]], 0), many)
        opened = np.where(np.repeat(over.many[r[split_r]] > 0, many), over.kids[at] if len(over.kids) else 0, np.repeat(r[split_r], many))
        fan = tree.many[q[split_q]]
        below = tree.kids[spread(tree.first[q[split_q]], fan)]
        q, r = np.concatenate([np.repeat(q[split_r], many), below]), np.concatenate([opened, np.repeat(r[split_q], fan)])
    return node, place, told


def _leaves(points, tree, centroids, over, q, r, place, told) -> None:
    """Compares the vectors of leaves q with the centroids of leaves r, and sets the place of each."""
    many, few = tree.b[q] - tree.a[q], over.b[r] - over.a[r]
    pair = np.repeat(np.arange(len(q)), many * few)
    step = spread(np.zeros(len(q), np.int64), many * few)
    at, c = tree.a[q[pair]] + step // few[pair], over.order[over.a[r[pair]] + step % few[pair]]
    told["exact"] += len(at)
    d = distances(points[tree.order[at]], centroids[c])
    by = np.lexsort((c, d, at)) if d.dtype != object else np.array(sorted(range(len(at)), key=lambda k: (at[k], d[k], c[k])), np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[by][1:] != at[by][:-1]])) if len(by) else by
    place[at[by[first]]] = c[by[first]]


def assign(points: np.ndarray, tree: Tree, centroids: np.ndarray, over: Tree) -> np.ndarray:
    """The centroid of each vector, in the tree's order."""
    node, place, _ = nearest(points, tree, centroids, over)
    for k in np.flatnonzero(node >= 0).tolist():
        place[tree.a[k] : tree.b[k]] = node[k]
    return place


class Sums:
    """Sums and counts by cluster: whole ranges of a tree's order by running sums, single vectors by their own."""

    def __init__(self, clusters: int, size: int):
        self.total = np.zeros((clusters, size), object)
        self.count = np.zeros(clusters, np.int64)

    def add(self, points: np.ndarray, tree: Tree, centroids: np.ndarray, over: Tree) -> None:
        node, place, _ = nearest(points, tree, centroids, over)
        rows = points[tree.order]
        rows = rows.astype(np.int64) if not len(rows) or np.abs(rows).max() < 1 << 50 else whole(rows)
        run = np.concatenate([np.zeros((1, rows.shape[1]), rows.dtype), np.cumsum(rows, axis=0)])
        at = np.flatnonzero(node >= 0)
        for c in np.unique(node[at]).tolist():
            own = at[node[at] == c]
            self.total[c] += (run[tree.b[own]] - run[tree.a[own]]).sum(axis=0)
            self.count[c] += int((tree.b[own] - tree.a[own]).sum())
        for c in np.unique(place[place >= 0]).tolist():
            own = place == c
            self.total[c] += rows[own].sum(axis=0)
            self.count[c] += int(own.sum())


# ---- Spark ----


def scaled(vector: Column, size: int, scale: int) -> Column:
    """The vector times scale, not yet rounded down; null unless it has `size` components, all finite."""
    times = F.transform(vector, lambda x: x.cast("double") * F.lit(float(scale)))
    fit = (F.size(vector) == size) & F.forall(times, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(F.coalesce(fit, F.lit(False)), times)


def narrow(points: np.ndarray) -> tuple[str, bytes]:
    """The smallest type that holds these whole numbers, and their bytes."""
    most = np.abs(points).max() if points.size else 0
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return kind, points.astype(kind).tobytes()


BLOCKS = "ids array<bigint>, kind string, points binary, tree binary"


def _blocks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list[np.ndarray] = []

        def out():
            points = np.floor(np.concatenate(held))
            kind, raw = narrow(points)
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([kind]), pa.array([raw], pa.binary()), pa.array([Tree(points, LEAF).pack()], pa.binary())], names=["ids", "kind", "points", "tree"])

        for b in batches:
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            own = b.column(0).to_pylist()
            at = 0
            while at < len(own):
                n = min(BLOCK - len(ids), len(own) - at)
                ids += own[at : at + n]
                held.append(v[at : at + n])
                at += n
                if len(ids) == BLOCK:
                    yield out()
                    ids, held = [], []
        if ids:
            yield out()

    return run


def _read(b: pa.RecordBatch, size: int) -> Iterator[tuple[list, np.ndarray, Tree]]:
    for ids, kind, raw, tree in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
        points = np.frombuffer(raw, kind).reshape(-1, size).astype(np.float64)
        yield ids, points, Tree.unpack(tree, len(points))


def _told(centroids: list[list[int]]) -> tuple[np.ndarray, Tree]:
    x = np.array(centroids, object).reshape(len(centroids), -1)
    near = x.astype(np.float64)
    return near if np.abs(near).max() <= EXACT else x, Tree(near, 1)


def _limbs(value: int) -> list[int]:
    """value as digits of 32 bits, the last of which has the sign."""
    return [value >> 32 * k & 0xFFFFFFFF for k in range(LIMBS - 1)] + [value >> 32 * (LIMBS - 1)]


def _round(centroids: list[list[int]], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, over = _told(centroids)
        sums = Sums(len(centroids), size)
        for b in batches:
            for _, points, tree in _read(b, size):
                sums.add(points, tree, c, over)
        rows = [(k, j, i, v) for k in range(len(centroids)) if sums.count[k] for j in range(size) for i, v in enumerate(_limbs(int(sums.total[k, j]))) if v]
        rows += [(k, -1, 0, int(n)) for k, n in enumerate(sums.count) if n]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["cluster", "part", "limb", "value"])

    return run


def _final(centroids: list[list[int]], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, over = _told(centroids)
        for b in batches:
            for ids, points, tree in _read(b, size):
                of = assign(points, tree, c, over)
                d = [int(x) for x in distances(points[tree.order], c[of])]
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in tree.order.tolist()], pa.int64()), pa.array(of, pa.int32()), pa.array([x if x < 1 << 63 else None for x in d], pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = SIZE, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every vector that can be clustered, and the centroids."""
    spark = vectors.sparkSession
    ship(spark)
    kept = vectors.select(quoted(key).cast("long").alias("vec_id"), scaled(quoted(vector), size, scale).alias("v")).where("v is not null")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = kept.orderBy(name.isNull(), name, "v").limit(clusters).select("v").collect()
    centroids = [[int(np.floor(x)) for x in r["v"]] for r in start]
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    at = new_table(spark, "vectors")
    kept.mapInArrow(_blocks(size), BLOCKS).write.parquet(at)
    blocks = spark.read.parquet(at)
    for _ in range(rounds):
        got = blocks.mapInArrow(_round(centroids, size), "cluster long, part long, limb long, value long").groupBy("cluster", "part", "limb").agg(F.sum("value").alias("value")).collect()
        total: dict[tuple[int, int], int] = {}
        for r in got:
            total[r["cluster"], r["part"]] = total.get((r["cluster"], r["part"]), 0) + (r["value"] << 32 * r["limb"])
        centroids = [[total.get((k, j), 0) // total[k, -1] for j in range(size)] if (k, -1) in total else c for k, c in enumerate(centroids)]
    return blocks.mapInArrow(_final(centroids, size), "vec_id long, cluster int, distance long"), centroids


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = cut(found)
    by = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"), F.max(F.col("distance").isNull()).alias("odd"))
    told = {r["cluster"]: None if r["odd"] else int(r["d"]) for r in by.collect()}
    fit = lambda x: x if x is not None and x < 1 << 63 else None
    inertia = None if None in told.values() else sum(told.values())
    rows = [(k, fit(told.get(k)), fit(inertia), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids)]
    names = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(names), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """Lloyd's rounds as a chain of common table expressions."""
    steps = [
        f"kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('{SEED}:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {CLUSTERS}))",
    ]
    nearest_ = "SELECT vec_id, v, (w % 1000)::INT AS c, w // 1000 AS d FROM (SELECT k.vec_id, k.v, min(list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT * 1000 + c.c) AS w FROM kept k, c{0} c GROUP BY k.vec_id, k.v)"
    for i in range(ROUNDS):
        steps.append(f"a{i} AS MATERIALIZED ({nearest_.format(i)})")
        steps.append(f"u{i} AS (SELECT c, unnest(v) AS x, unnest(range({SIZE})) AS j FROM a{i})")
        steps.append(f"m{i} AS (SELECT c, list(m ORDER BY j) AS v FROM (SELECT c, j, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m FROM u{i} GROUP BY c, j) GROUP BY c)")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN m{i} m ON m.c = o.c)")
    steps.append(f"last AS MATERIALIZED ({nearest_.format(ROUNDS)})")
    return "WITH " + ",\n".join(steps) + f"\nSELECT l.vec_id, l.c AS cluster, l.d::BIGINT AS distance, (sum(l.d) OVER (PARTITION BY l.c))::BIGINT AS cluster_inertia, (sum(l.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM last l JOIN c{ROUNDS} c ON c.c = l.c"


ORACLE_OP13 = _oracle()
