"""Metric goldens, attribution and simulation invariants."""

import math
import random

from pyspark.sql import functions as F

from surveylab.operators import metrics
from surveylab.operators.attribution import attribute, attribute_linear, base_value, explain, waterfall
from surveylab.operators.scoring import LinearScorer, build_features
from surveylab.operators.simulate import Override, Package, best_scenario, diff_rows, simulate


def _confusion_rows(spark, tn, fp, fn, tp):
    rows = [(0, 0)] * tn + [(0, 1)] * fp + [(1, 0)] * fn + [(1, 1)] * tp
    return spark.createDataFrame(rows, "y int, pred int")


def test_recorded_confusion_golden(spark):
    m = metrics.binary_metrics(_confusion_rows(spark, 823, 52, 265, 38), "pred", "y").first()
    assert (round(m.precision, 2), round(m.recall, 2), round(m.f1, 2), round(m.accuracy, 2)) == (0.42, 0.13, 0.19, 0.73)


def test_forest_row_golden(spark):
    m = metrics.binary_metrics(_confusion_rows(spark, 838, 37, 285, 18), "pred", "y").first()
    assert (round(m.precision, 4), round(m.recall, 4), round(m.f1, 4), round(m.accuracy, 4)) == \
        (0.3273, 0.0594, 0.1006, 0.7267)
    cells = {(r.label, r.pred): r["count"] for r in
             metrics.confusion(_confusion_rows(spark, 0, 0, 5, 0), "pred", "y").collect()}
    assert cells == {(0, 0): 0, (0, 1): 0, (1, 0): 5, (1, 1): 0}


def test_zero_division_is_zero(spark):
    m = metrics.binary_metrics(_confusion_rows(spark, 5, 0, 3, 0), "pred", "y").first()
    assert m.precision == 0.0 and m.f1 == 0.0


def test_auc_ties_half_matches_brute_force(spark):
    rnd = random.Random(3)
    rows = [(round(rnd.random(), 1), int(rnd.random() < 0.3)) for _ in range(400)]
    df = spark.createDataFrame(rows, "s double, y int")
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    exp = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    got = metrics.roc_auc(df, "s", "y", per_bucket=3).first()["auc"]
    assert math.isclose(got, exp, rel_tol=1e-12)
    single = spark.createDataFrame([(0.1, 1), (0.2, 1)], "s double, y int")
    assert metrics.roc_auc(single, "s", "y").first()["auc"] is None
    curve = metrics.roc_curve(df, "s", "y", per_bucket=4).collect()
    with_null = df.union(spark.createDataFrame([(None, 1), (float("nan"), 0)], "s double, y int"))
    assert metrics.roc_curve(with_null, "s", "y").collect() == metrics.roc_curve(df, "s", "y").collect()
    assert curve[-1].tpr == 1.0 and curve[-1].fpr == 1.0


def test_auc_of_billions_of_rows_does_not_overflow(spark):
    many = 4_000_000_000
    big = spark.createDataFrame([(0.1, 0, many), (0.9, 1, many)], "s double, pos long, n long").selectExpr(
        "s", "if(pos = 1, n, 0L) as pos", "if(pos = 0, n, 0L) as neg", "if(pos = 1, 4000000000L, 0L) as neg_below")
    real, metrics._score_counts = metrics._score_counts, lambda *a: big
    try:
        assert metrics.roc_auc(None, "s", "y").first()["auc"] == 1.0
    finally:
        metrics._score_counts = real


def test_brier_and_report(spark):
    df = spark.createDataFrame([(0.9, 1, 1), (0.2, 0, 0), (0.6, 0, 1)], "p double, y int, pred int")
    assert math.isclose(metrics.brier(df, "p", "y").first()["brier"], (0.01 + 0.04 + 0.36) / 3)
    rep = {r["class"]: r for r in metrics.classification_report(df, "pred", "y").collect()}
    assert rep["1"].support == 1 and rep["0"].support == 2 and rep["weighted avg"].support == 3


SCORER = LinearScorer({"a": 0.8, "b": -1.5, "c": 0.3}, intercept=-0.2)


def _frame(spark, n=30, seed=1):
    rnd = random.Random(seed)
    return spark.createDataFrame([(i, rnd.random() * 3, rnd.random(), float(rnd.randint(0, 2))) for i in range(n)],
                                 "id long, a double, b double, c double")


def test_sampled_shapley_sums_to_score_minus_base(spark):
    df = _frame(spark)
    bg = df.filter("id < 5")
    attr = attribute(df.filter("id >= 20"), "id", ["a", "b", "c"], SCORER, bg, permutations=3, seed=4)
    sums = {r.id: r.s for r in attr.groupBy("id").agg(F.sum("shap_value").alias("s")).collect()}
    base = base_value(bg, SCORER).first()[0]
    p = {r.id: r.probability for r in SCORER.score(df.filter("id >= 20")).collect()}
    assert len(sums) == 10
    for k, s in sums.items():
        assert math.isclose(s, p[k] - base, abs_tol=1e-12)


def test_sampled_shapley_scores_each_coalition_once(spark, monkeypatch):
    """Rows, permutations and background rows that share a coalition's values share its score; parts of both sides meet."""
    from surveylab.functions.expr import uniform
    from surveylab.operators import attribution

    class Product:
        prob_col, seen = "p", []

        def score(self, df):
            self.seen.append(df)
            return df.withColumn("p", F.col("a") * F.col("b") + F.col("c") * F.col("c"))

    monkeypatch.setattr(attribution, "POINTS_PART", 7, raising=False)
    monkeypatch.setattr(attribution, "BACKGROUND_BLOCK", 5)
    monkeypatch.setattr(attribution, "TASK_PAIRS", 300, raising=False)
    rnd, names = random.Random(6), ["a", "b", "c"]
    data = [(i if i else None, float(i % 2), rnd.choice([None, 1.0, 2.0]), rnd.random()) for i in range(40)] + [(7, 1.0, 2.0, 0.5)]
    df = spark.createDataFrame(data, "id long, a double, b double, c double").repartition(3)
    scorer = Product()
    got = attribute(df, "id", names, scorer, df, permutations=2, seed=3).collect()
    orders = df.select("id", *names, *[uniform(3, "id", F.lit(p), F.lit(j)).alias(f"u{p}{j}") for p in range(2) for j in range(3)]).collect()
    full = [tuple(x or 0.0 for x in r[1:]) for r in data]
    want = {}
    for r in orders:
        x = [r[c] or 0.0 for c in names]
        for p in range(2):
            order, v = sorted(range(3), key=lambda j: r[f"u{p}{j}"]), []
            for t in range(4):
                pts = [[x[j] if j in order[:t] else b[j] for j in range(3)] for b in full]
                v.append(sum(a * b + c * c for a, b, c in pts) / len(pts))
            for t, j in enumerate(order):
                want[r.id, names[j]] = want.get((r.id, names[j]), 0.0) + (v[t + 1] - v[t]) / 2
    assert len(got) == len(want) == 3 * 40  # a repeated key counts together
    for r in got:
        assert math.isclose(r.shap_value, want[r.id, r.feature_code], abs_tol=1e-12)
    assert scorer.seen[0].count() < 41 * 2 * 41 * 4 / 3


def test_linear_attribution_sums_to_margin_minus_base(spark):
    df = _frame(spark)
    bg = df.filter("id < 5")
    attr = attribute_linear(df, "id", ["a", "b", "c"], SCORER, bg)
    sums = {r.id: r.s for r in attr.groupBy("id").agg(F.sum("shap_value").alias("s")).collect()}
    base = bg.select(F.avg(SCORER.margin(bg))).first()[0]
    m = {r.id: r.m for r in df.select("id", SCORER.margin(df).alias("m")).collect()}
    assert all(math.isclose(sums[k], m[k] - base, abs_tol=1e-12) for k in m)
    e = explain(attr, "id", top=2, side=1)
    assert e.filter("list = 'top'").groupBy("id").count().agg(F.max("count")).first()[0] == 2
    w = waterfall(attr, "id", base=base).filter("id = 3").orderBy("step").collect()
    assert math.isclose(w[-1].running_total, m[3], abs_tol=1e-12)


def test_simulation_recomputes_and_best_tie_break(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (2, 0.0, 0.0)], "id long, a double, b double")
    derive = lambda d: d.withColumn("c", F.col("a") * 2)
    pk = [Package("p_lower_a", "lower a", [Override.lower("a", 1.0)]),
          Package("p_same", "same", [Override.set("b", 1.0)]),
          Package("p_combo", "combo", [Override.raise_to("b", 0.0, 1.0)], base="p_lower_a")]
    sim = simulate(df, "id", pk, SCORER, derive=derive)
    assert sim.count() == 6
    best = {r.id: r.best_package for r in best_scenario(sim, "id").collect()}
    assert best[1] in ("p_combo", "p_lower_a")
    zero = sim.filter("id = 2 AND package_id = 'p_lower_a'").first()
    assert zero.risk_reduction_pct == 0.0   # a is already at the floor 0


def test_diff_rows_null_safe(spark):
    a = spark.createDataFrame([(1, None, 1.0)], "id long, x double, y double")
    b = spark.createDataFrame([(1, None, 2.0)], "id long, x double, y double")
    got = [(r.feature, r["from"], r["to"]) for r in diff_rows(a, b, "id", ["x", "y"]).collect()]
    assert got == [("y", 1.0, 2.0)]


def test_build_features_defaults_errors_and_unknown_level(spark):
    df = spark.createDataFrame([(1, "7", "toilet_type_31"), (2, "abc", "toilet_type_99"), (3, None, None)],
                               "id long, age string, toilet string")
    out = build_features(df, ["child_age_months", "toilet_type_31", "mother_bmi"],
                         numeric={"child_age_months": "age"}, categorical={"toilet_type": "toilet"}, keep=["id"])
    rows = {r.id: r for r in out.collect()}
    assert rows[1].child_age_months == 7.0 and rows[1].toilet_type_31 == 1.0 and rows[1].error == ""
    assert rows[2].child_age_months == 24.0 and rows[2].error == "child_age_months" and rows[2].toilet_type_31 == 0.0
    assert rows[3].mother_bmi == 21.5 and rows[3].error == ""


def test_quality_gate_bands(spark):
    from surveylab.operators.modeling import quality_gate
    df = spark.createDataFrame([("a", 0.59), ("b", 0.60), ("c", 0.649), ("d", 0.65), ("e", None)],
                               "model string, auc double")
    got = {r.model: (r.gate, r.attribution_allowed) for r in quality_gate(df, "auc").collect()}
    assert got["a"][0] == "STOP" and got["b"][0] == "CAUTION" and got["c"] == ("CAUTION", False)
    assert got["d"] == ("PASS", True) and got["e"][0] == "STOP"
    forced = {r.model: r.attribution_allowed for r in quality_gate(df, "auc", override=True).collect()}
    assert forced["a"] is True


def test_packages_from_scenario_table_match_objects(spark):
    from surveylab.operators.simulate import SCENARIO_SCHEMA, packages_from_table
    table = spark.createDataFrame([
        ("p_lower_a", "lower a", 1, "lower", "a", None, 1.0, None),
        ("p_same", "same", 1, "set", "b", "1.0", None, None),
        ("p_combo", "combo", 1, "raise_to", "b", "0.0", 1.0, "p_lower_a")], SCENARIO_SCHEMA)
    pk = packages_from_table(table)
    objs = [Package("p_lower_a", "lower a", [Override.lower("a", 1.0)]),
            Package("p_same", "same", [Override.set("b", 1.0)]),
            Package("p_combo", "combo", [Override.raise_to("b", 0.0, 1.0)], base="p_lower_a")]
    df = spark.createDataFrame([(1, 2.0, 1.0), (2, 0.0, 0.0)], "id long, a double, b double")
    rows = lambda p: sorted(tuple(r) for r in simulate(df, "id", p, SCORER).collect())
    assert rows(pk) == rows(objs)
