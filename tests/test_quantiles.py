"""Distributed exact quantiles agree with numpy at any bracket width."""

import math
import random

import numpy as np

from surveylab.operators.quantiles import exact_quantiles, quantiles_by


def test_selection_path_matches_numpy_with_hot_value(spark):
    rnd = random.Random(11)
    rows = [(rnd.random() * 1e6, 7.0 if i % 3 == 0 else rnd.gauss(0, 1), None if i % 5 == 0 else float(i))
            for i in range(6001)]
    df = spark.createDataFrame(rows, "a double, hot double, n double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    for accuracy in (20, 1000, 100_000):   # wide brackets, narrow brackets, sketch exact
        got = exact_quantiles(df, ["a", "hot", "n"], probs, accuracy)
        for j, c in enumerate(["a", "hot", "n"]):
            exp = np.quantile([r[j] for r in rows if r[j] is not None], probs)
            assert all(math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-12) for x, y in zip(got[c], exp)), (c, accuracy)


def test_small_groups_nulls_and_infinities(spark):
    rows = [(g, float(v)) for g in range(400) for v in range(g % 11 + 1)] + [(None, 1.0), (None, 2.0)]
    rows += [(1000, float("inf")), (1000, 1.0), (1000, float("nan")), (1000, None), (1001, float("-inf")), (1001, 5.0), (1001, 7.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: (r.n, r.q) for r in quantiles_by(df, ["g"], "v", [0.0, 0.3, 0.5, 1.0]).collect()}
    for g in range(400):
        want = np.quantile(range(g % 11 + 1), [0.0, 0.3, 0.5, 1.0])
        assert got[g][0] == g % 11 + 1 and np.allclose(got[g][1], want)
    assert got[None] == (2, [1.0, 1.3, 1.5, 2.0])
    assert got[1000][0] == 2 and got[1000][1][0] == 1.0 and math.isinf(got[1000][1][3])
    assert got[1001][1][2] == 5.0 and got[1001][1][0] == -math.inf


def test_all_null_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5]) == {"x": [None]}


def test_rows_are_not_dealt_by_group(spark):
    """Few groups: the brackets go to the rows, so that no task gets a whole group."""
    from surveylab.operators.stats import boxplot_stats
    df = spark.range(30_000).selectExpr("id % 3 AS g", "CAST(id * 7919 % 30011 AS DOUBLE) AS v")
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        # Plans as at size: the rows themselves are too many to be sent, a row per group is not.
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
        for out in (quantiles_by(df, ["g"], "v", [0.5]), boxplot_stats(df, "v", "g")):
            assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_brackets_are_compared_by_compiled_code(spark):
    """Functions over arrays run interpreted, for each row of the table."""
    df = spark.range(2_000).selectExpr("id % 3 AS g", "CAST(id * 7919 % 2003 AS DOUBLE) AS v")
    for probs in ([0.5], [0.1, 0.5, 0.9]):
        plan = quantiles_by(df, ["g"], "v", probs)._jdf.queryExecution().executedPlan().toString()
        assert "lambda" not in plan
