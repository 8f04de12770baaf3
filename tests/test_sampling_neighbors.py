"""Splits, folds, exact neighbours and oversampling invariants."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from surveylab.operators.neighbors import knn
from surveylab.operators.sampling import (class_weights, repeated_folds, smote, stratified_folds,
                                          stratified_split)


def _labels(spark, n=503, pos_every=4):
    return spark.createDataFrame([(i, int(i % pos_every == 0)) for i in range(n)], "id long, y int")


def test_split_exact_per_class_and_partition_independent(spark):
    df = _labels(spark)
    s = stratified_split(df, "y", "id", test=0.2, seed=1, buckets=7)
    counts = {(r.y, r.split): r["count"] for r in s.groupBy("y", "split").count().collect()}
    n1, n0 = 126, 377
    assert counts[(1, "test")] == math.floor(n1 * 0.2 + 0.5) and counts[(0, "test")] == math.floor(n0 * 0.2 + 0.5)
    s2 = stratified_split(df.repartition(5), "y", "id", test=0.2, seed=1, buckets=64)
    a = {r.id for r in s.filter("split = 'test'").collect()}
    b = {r.id for r in s2.filter("split = 'test'").collect()}
    assert a == b


def test_folds_differ_by_at_most_one_per_class(spark):
    f = stratified_folds(_labels(spark), "y", "id", k=5, seed=3)
    for y in (0, 1):
        sizes = [r["count"] for r in f.filter(F.col("y") == y).groupBy("fold").count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    r = repeated_folds(_labels(spark, 50), "y", "id", k=5, repeats=3, seed=3)
    assert r.count() == 150 and r.select("repeat").distinct().count() == 3


def test_single_class_split_and_weights(spark):
    df = spark.createDataFrame([(i, 0) for i in range(10)], "id long, y int")
    assert stratified_split(df, "y", "id").filter("split = 'test'").count() == 2
    w = class_weights(_labels(spark, 8, 4), "y")   # 2 positives, 6 negatives
    got = {r.y: r.weight for r in w.select("y", "weight").distinct().collect()}
    assert math.isclose(got[1], 8 / 4) and math.isclose(got[0], 8 / 12)


def _brute(points, k):
    out = {}
    for i, p in points:
        d = sorted((float(np.linalg.norm(np.array(p) - np.array(q))), j) for j, q in points if j != i)
        out[i] = [j for _, j in d[:k]]
    return out


def test_knn_exact_with_hot_duplicate_group(spark):
    rnd = random.Random(5)
    pts = [(i, [rnd.random(), rnd.random(), rnd.random()]) for i in range(60)]
    pts += [(100 + i, [0.5, 0.5, 0.5]) for i in range(40)]          # a hot group of copies
    df = spark.createDataFrame(pts, "id long, v array<double>")
    nn = knn(df, df.withColumnRenamed("id", "t"), "id", "t", "v", k=4, pivots=6, seed=2)
    got = {}
    for r in nn.orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.t)
    exp = _brute(pts, 4)
    # distances may tie only inside the copy group, where ties break by id
    assert got == exp
    small = knn(df, df.withColumnRenamed("id", "t"), "id", "t", "v", k=4, pivots=3, seed=2, block=4)
    got2 = {}
    for r in small.orderBy("id", "rank").collect():
        got2.setdefault(r.id, []).append(r.t)
    assert got2 == exp


def test_knn_by_columns_in_blocks_equals_plain_search(spark):
    """More dimensions than columns, cells that a query passes over, ids that repeat, vectors without a number."""
    rng = np.random.default_rng(3)
    for dims, block in ((70, 16), (3, 8)):
        x = np.repeat(rng.normal(0, 9, (12, dims)), 15, axis=0) + rng.normal(0, 1, (180, dims))
        df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>").repartition(3)
        odd = spark.createDataFrame([(900, None), (901, [float("nan")] * dims), (902, [None] * dims)], df.schema)
        nn = knn(df, df.union(odd).withColumnRenamed("id", "t"), "id", "t", "v", k=4, block=block, pivots=60)
        got = {}
        for r in nn.orderBy("id", "rank").collect():
            got.setdefault(r.id, []).append(r.t)
            assert math.isclose(r.distance, float(np.linalg.norm(x[r.id] - x[r.t])), rel_tol=1e-12)
        assert got == _brute([(i, r.tolist()) for i, r in enumerate(x)], 4)
        # an id that stands twice counts twice, the query's own id for nothing
        twice = knn(df.where("id = 0"), df.union(df).withColumnRenamed("id", "t"), "id", "t", "v", k=4, block=block)
        assert [r.t for r in twice.orderBy("rank").collect()] == [t for t in got[0][:2] for _ in range(2)]
    plan = nn._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and "zip_with(" not in plan  # distances are compiled


def test_knn_plans_do_not_grow_with_the_vectors_and_tiles_find_all(spark, monkeypatch):
    """64 columns for each side of a pair once filled the driver's memory; parts of queries meet all blocks of targets."""
    from surveylab.operators import neighbors
    plans = []

    def seen(df, keep=neighbors.kept):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return keep(df)

    monkeypatch.setattr(neighbors, "kept", seen)
    monkeypatch.setattr(neighbors, "PART", 40)
    x = np.random.default_rng(7).normal(0, 1, (90, 64))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>").repartition(3)
    nn = knn(df, df.withColumnRenamed("id", "t"), "id", "t", "v", k=4, block=16)
    got = {}
    for r in nn.orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.t)
    assert got == _brute([(i, r.tolist()) for i, r in enumerate(x)], 4)
    plans.append(nn._jdf.queryExecution().optimizedPlan().toString())
    assert max(map(len, plans)) < 15_000


def test_knn_classes_of_long_vectors_without_a_long_plan(spark):
    from surveylab.operators.modeling import knn_classify
    rng = np.random.default_rng(8)
    x, y = rng.normal(0, 1, (80, 64)), rng.integers(0, 2, 80)
    df = spark.createDataFrame([(i, r.tolist(), int(c)) for i, (r, c) in enumerate(zip(x, y))], "id long, v array<double>, y int")
    out = knn_classify(df.where("id >= 20"), df.where("id < 20"), "id", "id", "v", "y", k=5)
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 15_000
    got = {r.id: r.p for r in out.collect()}
    for i in range(20):
        near = np.argsort(np.linalg.norm(x[20:] - x[i], axis=1))[:5] + 20
        assert math.isclose(got[i], y[near].mean())


def test_knn_fewer_rows_than_k(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [3.0])], "id long, v array<double>")
    nn = knn(df, df.withColumnRenamed("id", "t"), "id", "t", "v", k=5, pivots=2)
    assert nn.groupBy("id").count().collect() and all(r["count"] == 2 for r in nn.groupBy("id").count().collect())


def test_smote_balances_and_points_on_segments(spark):
    rnd = random.Random(1)
    rows = [(i, int(i < 12), rnd.random() * 10, rnd.random()) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double")
    out = smote(df, "y", ["a", "b"], "id", k=3, seed=9)
    c = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert c[0] == c[1] == 38
    pos = {r.id: (r.a, r.b) for r in df.filter("y = 1").collect()}
    for r in out.filter("is_synthetic").collect():
        x = np.array(pos[r.id])
        p = np.array((r.a, r.b))
        # collinear with the parent and one other minority point, between them
        ok = False
        for q in pos.values():
            q = np.array(q)
            d = q - x
            if np.allclose(d, 0):
                continue
            t = float(np.dot(p - x, d) / np.dot(d, d))
            if -1e-9 <= t <= 1 + 1e-9 and np.allclose(x + t * d, p, atol=1e-9):
                ok = True
                break
        assert ok
