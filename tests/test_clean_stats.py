"""Cleaning and statistics edge cases (FIXTURES §7)."""

import math

from pyspark.sql import Observation
from pyspark.sql import functions as F

from surveylab.operators import clean, stats
from surveylab.operators.impute import imputation_plan, apply_plan, medians, modes


def test_sentinels_both_range_ends_absent_column_and_counts(spark):
    df = spark.createDataFrame([(90.0,), (99.0,), (89.0,), (100.0,), (None,)], "v double")
    obs = Observation("s")
    out = clean.null_sentinels(df, {"v": (90, 99), "absent": (0, 1)}, obs=obs)
    assert [r[0] for r in out.collect()] == [None, None, 89.0, 100.0, None]
    assert obs.get["replaced_v"] == 2


def test_drop_missing_observes(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (None, 1.0)], "a int, b double")
    obs = Observation("d")
    out = clean.drop_missing(df, ["a", "b", "not_there"], obs=obs)
    assert out.count() == 1 and obs.get["rows_dropped"] == 2


def test_drop_sparse_strictly_above(spark):
    rows = [(None, 1.0)] * 4 + [(1.0, None)] * 6
    df = spark.createDataFrame(rows, "a double, b double")  # a: 40 % null (kept), b: 60 % (dropped)
    assert clean.drop_sparse_columns(df, 0.40).columns == ["a"]


def test_rescale_and_align(spark):
    df = spark.createDataFrame([(1950.0,)], "bmi_raw double")
    r = clean.rescale(df, {"bmi_raw": (100, "bmi")})
    assert r.columns == ["bmi"] and r.first()[0] == 19.5
    a = clean.align_columns(r, ["x", "bmi"])
    assert a.columns == ["x", "bmi"] and tuple(a.first()) == (0.0, 19.5)


def test_missingness_report_sorted_and_filtered(spark):
    df = spark.createDataFrame([(None, 1, None), (1, 1, None), (1, 1, 1), (None, 1, 1)], "a int, b int, c int")
    rows = stats.missingness_report(df, dp=2).collect()
    assert [(r.column, r.missing_count, r.missing_pct) for r in rows] == [("a", 2, 50.0), ("c", 2, 50.0)]
    assert stats.null_total(df).first()[0] == 4


def test_tied_modes_take_smallest_and_even_median(spark):
    df = spark.createDataFrame([(2.0, "b"), (1.0, "b"), (2.0, "a"), (1.0, "a"), (None, None)], "x double, s string")
    assert modes(df, ["x", "s"]) == {"x": 1.0, "s": "a"}
    assert medians(spark.createDataFrame([(1.0,), (1.0,), (2.0,), (2.0,)], "x double"), ["x"]) == {"x": 1.5}


def test_imputation_thresholds_lower_branch(spark):
    # exactly 10 % null in an ordinal -> mode (not the -1 category);
    # exactly 15 % in a continuous -> median (not MICE)
    ordv = [None] + [1] * 5 + [2] * 4
    cont = [None] * 3 + [float(i) for i in range(17)]
    df = spark.createDataFrame([(ordv[i % 10], cont[i]) for i in range(20)], "o int, c double")
    plan = {p["column"]: p for p in imputation_plan(df, continuous=["c"], ordinal=["o"])}
    assert plan["o"]["method"] == "mode" and plan["o"]["fill_value"] == 1
    assert plan["c"]["method"] == "median"
    out = apply_plan(df, list(plan.values()))
    assert out.filter(F.col("o").isNull() | F.col("c").isNull()).count() == 0


def test_missing_category_above_threshold(spark):
    df = spark.createDataFrame([(None,), (None,), (1,), (2,), (2,)], "o int")
    plan = imputation_plan(df, ordinal=["o"])
    assert plan[0]["method"] == "missing_category"
    assert sorted(r[0] for r in apply_plan(df, plan).collect()) == [-1, -1, 1, 2, 2]


def test_correlation_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 7.0, 5.0)], "a double, b double, k double")
    r = {(x.a, x.b): x.r for x in stats.correlation_matrix(df, ["a", "b", "k"]).collect()}
    assert r[("a", "k")] is None and math.isclose(r[("a", "a")], 1.0) and r[("a", "b")] == r[("b", "a")]


def test_histogram_right_edge_closed(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "x double")
    rows = stats.histogram(df, "x", bins=2).collect()
    assert [(r.bin, r["count"]) for r in rows] == [(0, 1), (1, 2)]


def test_value_shares_exclude_null(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "v string")
    got = {r.v: r.share_pct for r in stats.value_shares(df, "v").collect()}
    assert math.isclose(got["a"], 200 / 3) and None not in got


def test_class_ratio_single_class_is_null(spark):
    df = spark.createDataFrame([(0,), (0,)], "y int")
    assert stats.class_ratio(df, "y").first()["class_ratio"] is None


def test_leaderboard_nan_last(spark):
    df = spark.createDataFrame([("nn", float("nan")), ("rf", 0.59), ("lr", 0.59), ("gb", 0.57)], "model string, auc double")
    assert [r.model for r in stats.leaderboard(df, "auc").collect()] == ["lr", "rf", "gb", "nn"]


def test_top_k_per_and_first_match(spark):
    df = spark.createDataFrame([(1, "a", -3.0), (1, "b", 2.0), (1, "c", 1.0), (2, "a", 0.5)], "k int, f string, v double")
    got = [(r.k, r.f) for r in stats.top_k_per(df, "k", "v", 2, tie="f").orderBy("k", "rank").collect()]
    assert got == [(1, "a"), (1, "b"), (2, "a")]
    m = stats.first_match(df, F.col("v") > 10, F.col("v") > 0, ["k", "f"]).first()
    assert (m.k, m.f) == (1, "b")


def test_group_size_histogram(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (3,), (3,), (3,)], "g int")
    rows = [(r.group_size, r.n_groups) for r in stats.group_size_histogram(df, ["g"]).collect()]
    assert rows == [(1, 1), (2, 1), (3, 1)]
    assert stats.multi_member_share(df, ["g"]).first()["n_multi"] == 2


def test_top_k_on_hot_and_null_keys(spark):
    import random
    rnd = random.Random(2)
    rows = [(0, i, float(rnd.randint(0, 50))) for i in range(3000)]          # hot key with ties
    rows += [(k, i, rnd.random()) for k in range(1, 20) for i in range(5)]
    rows += [(None, i, float(i)) for i in range(7)]
    df = spark.createDataFrame(rows, "k int, i int, v double").repartition(5)
    got = sorted(((r.k is None, r.k or 0, r.rank, r.i) for r in stats.top_k_per(df, "k", "v", 4, tie="i").collect()))
    want = []
    for k in {r[0] for r in rows}:
        best = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1]))[:4]
        want += [(k is None, k or 0, n + 1, r[1]) for n, r in enumerate(best)]
    assert got == sorted(want)
    plan = stats.top_k_per(df, "k", "v", 4, tie="i")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b"), (2.0, "b")], "x double, t string")
    rep = {r["column"]: r.missing_count for r in stats.missingness_report(df).collect()}
    assert rep == {"x": 2, "t": 1} and stats.null_total(df).first()[0] == 3



def test_link_audit_counts_all_stages_in_one_pass(spark):
    from surveylab.operators import link

    def audit(child, mother):
        a = link.LinkAudit()
        left, right = a.watch("child", child), a.watch("mother", mother)
        return {r.stage: (r.step, r.rows) for r in a.rows(a.watch("linked", link.link_records(left, right, "k"))).collect()}

    child = spark.createDataFrame([(i % 4, i) for i in range(40)] + [(None, 99)], "k int, v int")
    mother = spark.createDataFrame([(0, "a"), (1, "b"), (9, "c")], "k int, m string")
    assert audit(child, mother) == {"child": (0, 41), "mother": (1, 3), "linked": (2, 20)}
    assert audit(child, mother.limit(0)) == {"child": (0, 41), "mother": (1, 0), "linked": (2, 0)}
    assert audit(child.where("k = 3"), mother) == {"child": (0, 10), "mother": (1, 3), "linked": (2, 0)}
