"""The stored index of vectors: recall, bounds, pruned partitions, and odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import vector
from corvane.operators import vector_index as VI
from corvane.plans import search


def pairs(df):
    return {(r["q"], r["key"]) for r in df.collect()}


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    heads = rng.normal(size=(40, 16))
    rows = [(i, (heads[i % 40] + 0.25 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(4000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    return table, VI.build(table, str(tmp_path_factory.mktemp("cells")), cells=40)


def queries(table, every=100):
    return table.where(f"vec_id % {every} = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vector"))


def test_a_tenth_of_the_rows_is_enough(spark, clustered):
    table, index = clustered
    q = queries(table)
    exact = pairs(vector.nearest(table, q, 10))
    found = VI.search(spark, index, q, 10, share=0.1, refine=40)
    assert len(exact & pairs(found)) >= 0.9 * len(exact)
    # the share of the rows whose codes are read for one query
    own = {r["cell"]: r["rows"] for r in VI.cells(spark, index).collect()}
    assert sum(sorted(own.values())[-4:]) <= 0.25 * 4000 and np.mean(list(own.values())) * 4 <= 0.1 * 4000 + 1
    assert sum(own.values()) == 4000


def test_bounds_lose_nothing(spark, clustered):
    table, index = clustered
    q = queries(table)
    got = VI.search(spark, index, q, 10, share=0.025, exact=True)
    want = vector.nearest(table, q, 10)
    key = lambda df: sorted((r["q"], r["key"], round(r["similarity"], 6), r["rank"]) for r in df.collect())
    assert key(got) == key(want)
    units = np.array([r["vector"] for r in q.collect()])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    told = VI.cells(spark, index).orderBy("cell").toArrow()
    within = VI._within(units, np.array(told["centroid"].to_pylist()), told["least"].to_numpy(), np.full(len(units), 0.9))
    assert within.mean() < 0.5  # bounds rule most cells out


def test_only_some_partitions_are_read(spark, clustered):
    _, index = clustered
    one = spark.createDataFrame([(0, [1.0] * 16)], "q long, vector array<float>")
    units = np.array([[0.25] * 16])
    visit = np.zeros((1, 40), bool)
    visit[0, 3] = True
    plan = VI._scan(spark, index, units, visit, {k: np.zeros(16) for k in range(40)}, 5, False)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0] and "vector" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert VI.search(spark, index, one, 3, share=0.05).count() == 3


def test_recall_on_the_table(spark):
    """These vectors lie evenly on a sphere, the worst case: cells rule little out, codes nearly all."""
    d = "/root/testdata/sf0.01"
    got = {(r["q"], r["vec_id"]) for r in search.knn_index(spark, d).collect()}
    want = {(r["q"], r["vec_id"]) for r in search.knn_batch(spark, d).collect()}
    assert len(got & want) >= 0.9 * len(want)
    cells = search.vector_cells(spark, d).collect()
    assert sum(r["rows"] for r in cells) == 500 and len(cells) <= 22


def test_odd_rows(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0]), (6, [math.nan, 1.0]), (7, [1.0, None]), (8, []), (None, [1.0, 1.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = VI.build(table, f"{tmp_path}/a", cells=2)
    assert (index.n, index.size) == (5, 2)
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [1.0])], "q string, vector array<float>")
    for exact in (False, True):
        got = VI.search(spark, index, q, 9, share=1.0, exact=exact)
        assert [(r["q"], r["key"], round(r["similarity"], 4)) for r in got.orderBy("rank").collect()] == [("a", 1, 1.0), ("a", 9, 1.0), ("a", 9, 1.0), ("a", None, 0.7071), ("a", 2, 0.0)]
    none = VI.build(table.limit(0), f"{tmp_path}/b")
    assert none.n == 0 and VI.search(spark, none, q, 3).collect() == []


def test_codes():
    rng = np.random.default_rng(1)
    for size in (1, 5, 64):
        x = rng.normal(size=(200, size))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        codes, step = VI.encode(x)
        assert codes.shape[1] == (size + 1) // 2
        assert (np.abs(VI.decode(codes, step, size) - x) <= step[:, None] / 2 + 1e-6).all()


def test_best_keeps_ties():
    best = VI.Best(1, 3)
    for k in range(20):
        best.add(0, np.array([1.0, 0.5, 0.5, 0.1]), 0, np.arange(4) + 4 * k)
    ((_, score, _, at),) = best.all()
    assert sorted(at[score == 1.0].tolist()) == list(range(0, 80, 4))


def test_a_table_written_again_has_another_version(spark, tmp_path):
    from corvane.runtime import version_of

    spark.range(3).write.parquet(f"{tmp_path}/t")
    one = version_of(spark, f"{tmp_path}/t")
    assert version_of(spark, f"{tmp_path}/t") == one
    spark.range(3).write.mode("overwrite").parquet(f"{tmp_path}/t")
    assert version_of(spark, f"{tmp_path}/t") != one


def test_only_the_partitions_of_asked_values_are_read(spark, tmp_path):
    rows = spark.createDataFrame([(i, [1.0, i / 9], "abc"[i % 3] if i % 7 else None) for i in range(40)], "vec_id long, embedding array<float>, lang string")
    stored = vector.store_by(rows, f"{tmp_path}/t", "lang")
    assert sorted(map(str, stored.collect())) == sorted(map(str, rows.collect()))
    q = spark.createDataFrame([(1, [1.0, 0.0], "b"), (2, [0.0, 1.0], "b"), (3, [1.0, 1.0], None), (4, [1.0, 1.0], "zz")], "q long, vector array<float>, lang string")
    got = vector.nearest(stored, q, 3, same="lang")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, vector.nearest(rows, q, 3, same="lang").collect()))
    assert {r["q"] for r in got.collect()} == {1, 2}
    plan = got._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "lang" in filters and "IN (b,zz)" in filters
