"""Expression helpers and golden values that need no data (FIXTURES §6)."""

import duckdb
import pytest
from pyspark.sql import functions as F

from surveylab.functions.expr import clamp, flag, map_values, uniform
from surveylab.operators.encode import recode, threshold_label
from surveylab.operators.features import age_group
from surveylab.operators.scoring import risk_index, risk_tier


def test_flag_null_is_false(spark):
    df = spark.createDataFrame([(1.0,), (None,), (5.0,)], "x double")
    assert [r[0] for r in df.select(flag(F.col("x") > 2)).collect()] == [0.0, 0.0, 1.0]


def test_clamp_keeps_null(spark):
    df = spark.createDataFrame([(-5.0,), (None,), (500.0,), (50.0,)], "x double")
    assert [r[0] for r in df.select(clamp("x", 0.0, 100.0)).collect()] == [0.0, None, 100.0, 50.0]


def test_map_values_pass_through_and_null(spark):
    df = spark.createDataFrame([(1,), (2,), (9,), (None,)], "x int")
    keep = [r[0] for r in df.select(map_values("x", {1: 10, 2: 20})).collect()]
    drop = [r[0] for r in df.select(map_values("x", {1: 10, 2: 20}, keep_unmapped=False)).collect()]
    assert keep == [10, 20, 9, None] and drop == [10, 20, None, None]


def test_uniform_matches_sql_formula(spark):
    df = spark.createDataFrame([(7,), (123,)], "k long")
    got = [r[0] for r in df.select(uniform(42, "k")).collect()]
    exp = [duckdb.sql(f"SELECT ('0x' || substr(md5('42:{k}'), 1, 8))::BIGINT / 4294967296.0").fetchall()[0][0]
           for k in (7, 123)]
    assert got == pytest.approx(exp, abs=0, rel=1e-15)
    assert all(0 <= u < 1 for u in got)


def test_age_group_golden(spark):
    df = spark.createDataFrame([(15.0,), (19.0,), (20.0,), (49.0,), (55.0,), (12.0,), (None,)], "a double")
    assert [r[0] for r in df.select(age_group(F.col("a"))).collect()] == [1, 1, 2, 7, 7, 1, None]


def test_risk_index_golden(spark):
    df = spark.createDataFrame([(0.0,), (0.129,), (0.258,), (0.429,), (0.60,), (0.9,), (None,)], "p double")
    got = [r[0] for r in df.select(F.round(risk_index("p"), 6)).collect()]
    assert got == [0.0, 20.0, 40.0, 70.0, 100.0, 100.0, None]


def test_risk_tier_golden(spark):
    df = spark.createDataFrame([(14.99,), (15.0,), (35.0,), (60.0,)], "i double")
    got = [r["tier"] for r in risk_tier(df, "i").collect()]
    assert got == ["Low Risk", "Moderate Risk", "High Risk", "Severe Risk"]


def test_anaemia_recode_golden(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (7,)], "a int")
    got = [r[0] for r in recode(df, "a", {1: 3, 2: 2, 3: 1, 4: 0}).collect()]
    assert got == [3, 2, 1, 0, 7]


def test_threshold_label_golden(spark):
    df = spark.createDataFrame([(-2.0,), (-2.01,), (None,), (float("nan"),)], "h double")
    assert [r["label"] for r in threshold_label(df, "h").collect()] == [0, 1, 0, 0]
