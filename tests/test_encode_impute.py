"""Estimators: fitted on one frame, applied to another; persistence."""

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from surveylab.operators.encode import OneHotColumns, RareCollapse, ZScore, label_codes
from surveylab.operators.impute import MedianImputer, mice


def test_rare_collapse_exactly_one_percent_kept(spark):
    rows = [("a",)] * 98 + [("b",)] + [("c",)] + [(None,)] * 5   # b, c: exactly 1 % of non-null -> kept
    rows2 = [("a",)] * 199 + [("z",)]                              # z: 0.5 % -> other
    df = spark.createDataFrame(rows, "v string")
    m = RareCollapse(inputCols=["v"], minShare=0.01).fit(df)
    assert sorted(m.getOrDefault(m.levels)[0]) == ["a", "b", "c"]
    df2 = spark.createDataFrame(rows2, "v string")
    got = {r.v for r in RareCollapse(inputCols=["v"]).fit(df2).transform(df2).collect()}
    assert got == {"a", "other"}


def test_one_hot_fixed_vocabulary_unseen_and_null(spark):
    train = spark.createDataFrame([(1.0,), (2.0,), (2.0,)], "v double")
    m = OneHotColumns(inputCols=["v"]).fit(train)
    assert m.output_columns() == ["v_1", "v_2"]       # canonical text, no '.0'
    test = spark.createDataFrame([(2.0,), (3.0,), (None,)], "v double")
    assert [tuple(r) for r in m.transform(test).collect()] == [(0, 1), (0, 0), (0, 0)]


def test_label_codes_alphabetical_with_null_level(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "s string")
    out, _ = label_codes(df, ["s"])
    assert [r.s for r in out.collect()] == [1, 0, 2, 1]   # a, b, nan


def test_zscore_population_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    got = [r.x for r in ZScore(inputCols=["x"]).fit(df).transform(df).collect()]
    assert math.isclose(got[2], 1 / math.sqrt(2 / 3))


def test_median_imputer_fit_on_train_persisted(spark, tmp_path):
    train = spark.createDataFrame([(1.0, 1.0), (2.0, None), (10.0, 3.0), (None, 4.0)], "a double, b double")
    test = spark.createDataFrame([(None, None)], "a double, b double")
    model = Pipeline(stages=[MedianImputer(inputCols=["a", "b"])]).fit(train)
    assert tuple(model.transform(test).first()) == (2.0, 3.0)   # medians of train only
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert tuple(again.transform(test).first()) == (2.0, 3.0)


def test_mice_single_column_is_mean_and_multi_fills(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 4.0), (3.0, None), (5.0, 10.0), (7.0, 14.0)], "a double, b double")
    one = mice(df.select("a"), ["a"])
    assert sorted(r.a for r in one.collect()) == [1.0, 3.0, 4.0, 5.0, 7.0]
    two = mice(df, ["a", "b"], rounds=3)
    assert two.filter(F.col("a").isNull() | F.col("b").isNull()).count() == 0
    # observed cells never change
    assert sorted(r.a for r in two.collect() if r.a in (1.0, 3.0, 5.0, 7.0)) == [1.0, 3.0, 5.0, 7.0]
