"""Exact attribution of tree models against full enumeration of the coalitions."""

import re
from itertools import combinations
from math import factorial

import pytest
from pyspark.sql import functions as F

from surveylab.functions.expr import uniform
from surveylab.operators.attribution import attribute
from surveylab.operators.modeling import ModelSpec, fit
from surveylab.operators.scoring import ModelScorer
from surveylab.operators.tree_attribution import attribute_trees, leaves

FEATURES = ["a", "b", "c", "d", "e", "f"]


@pytest.fixture(scope="module")
def data(spark):
    df = spark.range(400).select("id", *[F.round(uniform(7, "id", F.lit(c)) * 10, 1).alias(c) for c in FEATURES])
    df = df.withColumn("a", F.when(F.col("id") % 11 == 0, None).otherwise(F.col("a")))
    return df.withColumn("y", (F.coalesce(F.col("a"), F.lit(5.0)) * F.col("b") + 3 * F.col("c") + 4 * uniform(8, "id") > 40).cast("int"))


def output(model, df, kind):
    out = model.transform(df)
    if kind == "gbt":
        return out.select("*", F.element_at(_array(out), 2).alias("o"))
    return out.select("*", F.element_at(_array(out, "probability"), 2).alias("o"))


def _array(df, col="rawPrediction"):
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(F.col(col))


@pytest.mark.parametrize("kind,params", [("rf", {"numTrees": 6, "maxDepth": 5}), ("dt", {"maxDepth": 6}),
                                         ("gbt", {"maxIter": 4, "maxDepth": 3})])
def test_trees_equal_all_coalitions(spark, data, kind, params):
    model = fit(ModelSpec(kind, kind, params), data, FEATURES, "y")
    rows, bg = data.where("id in (0, 3, 11, 200)"), data.where("id % 57 = 0")
    medians = dict(zip(FEATURES, model.stages[0].getOrDefault(model.stages[0].surrogates)))
    own = {r["id"]: {c: medians[c] if r[c] is None else r[c] for c in FEATURES} for r in rows.collect()}
    other = [{c: medians[c] if r[c] is None else r[c] for c in FEATURES} for r in bg.collect()]
    points = [(i, k, s, *[own[i][c] if s >> j & 1 else o[c] for j, c in enumerate(FEATURES)])
              for i in own for k, o in enumerate(other) for s in range(64)]
    table = spark.createDataFrame(points, "id long, k int, s int, " + ", ".join(f"{c} double" for c in FEATURES))
    mean = {(r["id"], r["s"]): r["m"] for r in output(model, table, kind).groupBy("id", "s").agg(F.avg("o").alias("m")).collect()}
    got = {(r["id"], r["feature_code"]): r for r in attribute_trees(rows, "id", FEATURES, model, bg).collect()}
    assert len(got) == 4 * 6
    for i in own:
        for j, c in enumerate(FEATURES):
            rest = [x for x in range(6) if x != j]
            want = sum(factorial(n) * factorial(5 - n) / factorial(6)
                       * (mean[i, sum(1 << x for x in s) | 1 << j] - mean[i, sum(1 << x for x in s)])
                       for n in range(6) for s in combinations(rest, n))
            assert got[i, c]["shap_value"] == pytest.approx(want, abs=1e-9)
        assert sum(got[i, c]["shap_value"] for c in FEATURES) == pytest.approx(mean[i, 63] - mean[i, 0], abs=1e-9)
    assert got[0, "a"]["value"] is None and got[3, "a"]["value"] is not None


def test_leaves_share_the_rows_among_them(spark, data):
    model = fit(ModelSpec("rf", "rf", {"numTrees": 3, "maxDepth": 4}), data, FEATURES, "y")
    found = leaves(spark, model.stages[-1]).collect()
    assert {r.tree for r in found} == {0, 1, 2} and all(len(r.features) == len(r.above) == len(r.upto) for r in found)
    x = [float(v) for v in data.where("id = 3").select(*FEATURES).first()]
    for t in range(3):
        hit = [r for r in found if r.tree == t and all(x[f] > lo and not x[f] > hi for f, lo, hi in zip(r.features, r.above, r.upto))]
        assert len(hit) == 1


def test_other_models_and_features_are_refused(spark, data):
    full = data.where("a is not null")
    with pytest.raises(ValueError, match="not a tree model"):
        attribute_trees(full, "id", FEATURES, fit(ModelSpec("lr", "lr"), full, FEATURES, "y"), full.limit(5))
    model = fit(ModelSpec("dt", "dt"), full, FEATURES, "y")
    with pytest.raises(ValueError, match="other features"):
        attribute_trees(full, "id", FEATURES[:-1], model, full.limit(5))
    with pytest.raises(ValueError, match="no rows"):
        attribute_trees(full, "id", FEATURES, model, full.where("false"))


def test_sampled_attribution_takes_a_fitted_pipeline(spark, data):
    model = fit(ModelSpec("dt", "dt", {"maxDepth": 3}), data, FEATURES, "y")
    rows, bg = data.where("id < 3"), data.where("id between 300 and 304")
    got = attribute(rows, "id", FEATURES, ModelScorer(model), bg, permutations=2).groupBy("id").agg(F.sum("shap_value").alias("s"))
    assert got.count() == 3
    with pytest.raises(ValueError, match="in the way"):
        ModelScorer(model).score(rows.withColumn("__model_vector", F.lit(1)))


def test_rows_are_dealt_by_the_leaves_they_pass(spark, data, monkeypatch):
    """A table of few bytes is many rows times leaves: it goes to several tasks, and repeated keys still count together."""
    from surveylab.operators import tree_attribution

    model = fit(ModelSpec("rf", "rf", {"numTrees": 4, "maxDepth": 4}), data, FEATURES, "y")
    rows, bg = data.where("id < 40").coalesce(1), data.where("id % 57 = 0")
    one = {(r["id"], r["feature_code"]): r["shap_value"] for r in attribute_trees(rows, "id", FEATURES, model, bg).collect()}
    monkeypatch.setattr(tree_attribution, "TASK_LEAVES", 100)
    monkeypatch.setattr(tree_attribution, "kept", lambda kept_rows: kept_rows)  # to see its plan
    got = attribute_trees(rows.unionByName(rows.where("id = 3")), "id", FEATURES, model, bg)
    tasks = re.findall(r"RoundRobinPartitioning\((\d+)\)", got._jdf.queryExecution().executedPlan().toString())
    assert tasks and int(tasks[0]) > 5
    for r in got.collect():
        assert r["shap_value"] == pytest.approx(one[r["id"], r["feature_code"]] * (2 if r["id"] == 3 else 1), abs=1e-12)
