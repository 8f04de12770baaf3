"""k-means distances with restarts in step, against a plain version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveylab.functions.expr import uniform
from surveylab.operators.features import KMeansDistance, KMeansDistanceModel


def plain(x, starts, rounds):
    best = None
    for s in starts:
        c = x[s].astype(float)
        for _ in range(rounds):
            near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
        cost = ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum()
        if best is None or cost < best[0]:
            best = (cost, c)
    return best[1]


def test_restarts_advance_together_and_the_best_is_kept(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(0, 1, (60, 2)), rng.normal(6, 1, (50, 2)), rng.normal((0, 9), 1, (40, 2))]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id int, a double, b double").repartition(3)
    draws = df.select("id", *[uniform(5, "id", F.lit(r)).alias(f"u{r}") for r in range(4)]).orderBy("id").collect()
    starts = [[i for _, i in sorted((row[f"u{r}"], row["id"]) for row in draws)[:3]] for r in range(4)]
    holes = df.unionByName(spark.createDataFrame([(999, None, 1.0), (998, float("nan"), 2.0)], df.schema))
    model = KMeansDistance(inputCols=["a", "b"], k=3, seed=5, restarts=4, maxIter=6, tol=0.0, keyCols=["id"]).fit(holes)
    want = plain(x, starts, 6)
    assert np.allclose(np.array(model.getOrDefault(model.centre)).reshape(3, 2), want)
    out = {r["id"]: r for r in model.transform(holes).collect()}
    assert out[999]["kmeans_dist_0"] is None
    assert [out[4][f"kmeans_dist_{j}"] for j in range(3)] == pytest.approx(np.sqrt(((x[4] - want) ** 2).sum(1)).tolist())
    model.write().overwrite().save(str(tmp_path / "m"))
    again = KMeansDistanceModel.load(str(tmp_path / "m")).transform(df).orderBy("id").first()
    assert again["kmeans_dist_1"] == out[0]["kmeans_dist_1"]


def test_few_rows_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (4.0,)], "a double")
    m = KMeansDistance(inputCols=["a", "absent"], k=5, restarts=2).fit(df)
    assert m.getOrDefault(m.k) == 3 and set(m.getOrDefault(m.centre)) == {1.0, 4.0}
    assert KMeansDistance(inputCols=["a"], k=2).fit(df.limit(0)).transform(df).columns == ["a"]


def test_rounds_need_no_sort_of_the_rows_and_no_expression_for_each_centre(spark, monkeypatch):
    """A round is one pass in numpy over a task's rows, the starts are the least rows of each task."""
    import pyspark.sql.classic.dataframe as frames
    plans = []
    collect = frames.DataFrame.collect
    monkeypatch.setattr(frames.DataFrame, "collect", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or collect(df))
    df = spark.range(500).selectExpr("CAST(id % 7 AS DOUBLE) AS a", "CAST(id % 11 AS DOUBLE) AS b").repartition(4)
    KMeansDistance(inputCols=["a", "b"], k=3, restarts=2, maxIter=2).fit(df)
    assert plans and not [p for p in plans if "lambdafunction" in p or "WindowGroupLimit" in p]
    assert sum("TakeOrderedAndProject" in p for p in plans) == 1 and any("MapInArrow" in p for p in plans)
