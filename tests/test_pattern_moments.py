"""Chained equations from pattern moments, the Gram-matrix correlations and distributed level codes, by plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveylab.operators.encode import dense_codes, label_codes
from surveylab.operators.impute import mice
from surveylab.operators.stats import correlation_matrix


def plain_mice(x, rounds):
    miss, x = np.isnan(x), x.copy()
    means = [x[~m, i].mean() if (~m).any() else np.nan for i, m in enumerate(miss.T)]
    usable = [i for i in range(x.shape[1]) if not np.isnan(means[i])]
    for i in usable:
        x[miss[:, i], i] = means[i]
    for _ in range(rounds):
        for c in usable:
            others = [i for i in usable if i != c]
            a = np.c_[np.ones(len(x)), x[:, others]]
            beta = np.linalg.lstsq(a[~miss[:, c]], x[~miss[:, c], c], rcond=None)[0]
            x[miss[:, c], c] = (a @ beta)[miss[:, c]]
    return x


def frame(spark, x):
    rows = [(i, *[None if math.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id int, " + ", ".join(f"c{i} double" for i in range(x.shape[1]))).repartition(4)


@pytest.mark.parametrize("k", [2, 3, 4])
def test_mice_equals_the_row_wise_rounds(spark, k):
    rng = np.random.default_rng(k)
    x = rng.normal(50, 3, (300, k)) + rng.normal(0, 5, (300, 1))
    x[rng.random(x.shape) < 0.25] = np.nan
    x[7] = np.nan  # nothing observed
    out = mice(frame(spark, x), [f"c{i}" for i in range(k)], rounds=6).orderBy("id").collect()
    assert np.allclose([[r[f"c{i}"] for i in range(k)] for r in out], plain_mice(x, 6), atol=1e-8)


def test_mice_reads_the_data_without_a_checkpoint_and_keeps_empty_columns(spark):
    x = np.array([[1.0, np.nan, 4.0], [np.nan, np.nan, 5.0], [3.0, np.nan, np.nan], [2.0, np.nan, 6.5]])
    df = frame(spark, x).withColumn("note", F.lit("k")).withColumn("nan", F.lit(float("nan")))
    out = mice(df, ["c0", "c1", "c2"], rounds=4)
    assert out.columns == df.columns
    rows = out.orderBy("id").collect()
    assert [r["c1"] for r in rows] == [None] * 4 and all(r["c0"] is not None and r["c2"] is not None for r in rows)
    plain = plain_mice(x, 4)
    assert np.allclose([r["c0"] for r in rows], plain[:, 0]) and np.allclose([r["c2"] for r in rows], plain[:, 2])
    assert mice(df.limit(0), ["c0", "c1"]).count() == 0
    full = mice(df.na.drop(subset=["c0"]).select("c0"), ["c0"]).collect()
    assert sorted(r["c0"] for r in full) == [1.0, 2.0, 3.0]


def test_correlations_are_pairwise_complete(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(1e6, 2, (200, 5)) + rng.normal(0, 1, (200, 1))
    x[:, 3] = 0.1  # constant
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 4] = np.nan
    got = {(r.a, r.b): r.r for r in correlation_matrix(frame(spark, x), [f"c{i}" for i in range(5)]).collect()}
    assert len(got) == 25
    for i in range(5):
        for j in range(5):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if 3 in (i, j) or 4 in (i, j):
                assert got[f"c{i}", f"c{j}"] is None
            else:
                assert got[f"c{i}", f"c{j}"] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    none = correlation_matrix(frame(spark, x).limit(0), ["c0", "c1"]).collect()
    assert len(none) == 4 and all(r.r is None for r in none)


def test_codes_of_many_levels_in_parts(spark):
    rng = random.Random(2)
    values = [rng.choice([None, "b", "é", "Z", "漢", f"v{rng.randrange(400)}"]) for _ in range(1500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, s string").repartition(5)
    levels = sorted({"nan" if v is None else v for v in values}, key=lambda s: s.encode())
    got = {r.level: r.code for r in dense_codes(df, "s", levels_a_part=20).collect()}
    assert got == {v: i for i, v in enumerate(levels)}
    out, tables = label_codes(df, ["s"], suffix="_code")
    assert out.columns == ["id", "s", "s_code"] and set(tables) == {"s"}
    assert {r.id: r.s_code for r in out.collect()} == {i: levels.index("nan" if v is None else v) for i, v in enumerate(values)}
    assert label_codes(df.limit(0), ["s"])[0].count() == 0
