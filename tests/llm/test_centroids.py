import hashlib
import json
import math

import numpy as np
import pytest

from corvane.llm import centroids as C


def brute(rows, size, k, rounds, seed=3):
    """rows of (id, vector): id, cluster, distance of each, and the centroids, by plain loops over whole numbers."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in kept[:k]]

    def of(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        groups = [[] for _ in cents]
        for _, v in kept:
            groups[of(v)[1]].append(v)
        cents = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, cents)]
    return [(i, of(v)[1], of(v)[0]) for i, v in kept], cents


def rows_of(rng, n, size, spread=0.1):
    heads = rng.normal(size=(5, size))
    return [(i, [float(np.float32(x)) for x in heads[i % 5] + spread * rng.normal(size=size)]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, distance int, `a.b` string")


@pytest.mark.parametrize("block, leaf", [(2048, 8), (7, 1)])
def test_rounds_are_the_plain_loops(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "LEAF", leaf)
    rows = rows_of(np.random.default_rng(1), 230, 6) + [(900 + k, [0.5] * 6) for k in range(40)] + [(None, [0.25] * 6), (3, [1.0] * 6), (3, [1.0] * 6)]
    odd = [(800, None), (801, []), (802, [1.0] * 5), (803, [1.0] * 7), (804, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (805, [math.nan] * 6), (806, [math.inf] + [0.0] * 5)]
    df = frame(spark, [(i, v, 1, 2, "x") for i, v in rows + odd])
    got, cents = C.cluster(df, size=6, clusters=4, rounds=5)
    want, wanted = brute(rows, 6, 4, 5)
    assert cents == wanted
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_few_and_none(spark, tmp_path):
    df = frame(spark, [(1, [1.0, 2.0], 1, 1, ""), (2, [1.0, 2.0], 1, 1, ""), (3, None, 1, 1, "")])
    got, cents = C.cluster(df, size=2)
    assert cents == [[1024, 2048], [1024, 2048]]
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0), (2, 0, 0)]  # of equal distances the smaller number
    assert C.cluster(df.limit(0), size=2)[0].collect() == []
    df.limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert C.op13_centroids(spark, str(tmp_path)).collect() == []


def test_huge_components(spark):
    rows = [(1, [3e38, 1.0]), (2, [3e38, 2.0]), (3, [-3e38, 1.0]), (4, [1.0, 1.0]), (5, [70000.5, -90000.25]), (6, [70001.5, -90000.25])]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    got, cents = C.cluster(frame(spark, [(i, v, 0, 0, "") for i, v in rows]), size=2, clusters=3, rounds=4)
    want, wanted = brute(rows, 2, 3, 4)
    assert cents == wanted
    assert sorted(map(tuple, got.collect())) == sorted((i, c, d if d < 1 << 63 else None) for i, c, d in want)


def test_trees_prune_and_cover():
    rng = np.random.default_rng(2)
    points = np.floor((rng.normal(size=(6, 16))[rng.integers(0, 6, 900)] + 0.02 * rng.normal(size=(900, 16))) * 1024)
    tree = C.Tree(points, 8)
    for k in range(len(tree.centre)):
        below = tree.order[tree.a[k] : tree.b[k]]
        assert (np.linalg.norm(points[below] - points[tree.centre[k]], axis=1) <= tree.radius[k] + 1e-6).all()
        own = tree.kids[tree.first[k] : tree.first[k] + tree.many[k]]
        assert sorted(np.concatenate([np.arange(tree.a[j], tree.b[j]) for j in own]).tolist()) == list(range(tree.a[k], tree.b[k])) if len(own) else True
    cents, over = C._told([[int(x) for x in points[k]] for k in (0, 1, 2, 3, 4, 5, 6, 7)])
    _, _, told = C.nearest(points, tree, cents, over)
    assert told["pruned"] and told["exact"] < 900 * 8 / 4
    want = ((points[:, None] - cents[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (C.assign(points, tree, cents, over) == want[tree.order]).all()


def test_ties_go_to_the_smaller_number():
    points = np.array([[0.0, 0.0], [2.0, 0.0], [1.0, 0.0], [1.0, 5.0]])
    tree = C.Tree(points, 1)
    cents, over = C._told([[2, 0], [0, 0], [2, 0]])
    assert dict(zip(tree.order.tolist(), C.assign(points, tree, cents, over).tolist())) == {0: 1, 1: 0, 2: 0, 3: 0}


def test_limbs():
    for v in (0, 1, -1, 1 << 31, -(1 << 40), 3**90, -(3**90)):
        assert sum(x << 32 * k for k, x in enumerate(C._limbs(v))) == v
        assert all(-(1 << 63) <= x < 1 << 63 for x in C._limbs(v))


def test_query_digests(spark, tmp_path):
    rows = rows_of(np.random.default_rng(4), 120, 64)
    frame(spark, [(i, v, 1, 2, "x") for i, v in rows]).write.parquet(f"{tmp_path}/embeddings.parquet")
    want, cents = brute(rows, 64, 8, 10)
    sha = [hashlib.sha256(json.dumps(c, separators=(",", ":"))[1:-1].encode()).hexdigest() for c in cents]
    total = sum(d for *_, d in want)
    wanted = sorted((i, c, d, sum(e for _, k, e in want if k == c), total, sha[c]) for i, c, d in want)
    assert sorted(map(tuple, C.op13_centroids(spark, str(tmp_path)).collect())) == wanted
