"""Steps whose cost must follow the rows: no shuffle by a handful of names, no work for each row that grows with the table."""

import random

import pytest

from pyspark.sql import functions as F

from conftest import SF001
from surveylab.operators import metrics
from surveylab.operators.attribution import attribute_linear
from surveylab.operators.features import feature_labels
from surveylab.operators.scoring import LinearScorer
from surveylab.operators.simulate import diff_rows


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(3)
    rows = [(i // 2, rnd.choice([0.0, 1.0, -1.0]), rnd.gauss(0, 1), None if i % 4 == 0 else rnd.random(), 0.5) for i in range(80)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double").repartition(3)  # a key comes twice


_FEATURES = ["a", "b", "c", "d"]
_SCORER = LinearScorer({"a": 0.5, "b": -0.5, "c": 0.7, "d": 2.0}, intercept=0.1)


def test_differences_are_joined_by_key_alone(spark):
    a = spark.createDataFrame([(1, 1.0, None), (1, 2.0, 5.0), (2, 3.0, 3.0), (None, 1.0, 1.0)], "k long, x double, y double")
    b = spark.createDataFrame([(1, 1.0, 4.0, 7), (2, 3.0, None, 8), (None, 2.0, 2.0, 9)], "k long, x double, y double, cf_id int")
    out = diff_rows(a, b, "k", ["x", "y"], labels={"y": "second"})
    assert out.columns == ["k", "feature", "from", "cf_id", "to"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(
        [(1, "second", None, 7, 4.0), (1, "x", 2.0, 7, 1.0), (1, "second", 5.0, 7, 4.0), (2, "second", 3.0, 8, None)], key=repr)
    assert "feature" not in "".join(x for x in _plan(out).splitlines() if "Join" in x or "Exchange" in x)
def test_scores_are_cut_by_range_without_a_list_of_borders_in_each_row(spark):
    rnd = random.Random(8)
    rows = [(rnd.random(), rnd.randrange(2)) for _ in range(600)] + [(0.5, 1), (0.5, 0), (None, 1)]
    df = spark.createDataFrame(rows, "p double, y int")
    pos, neg = ([s for s, y in rows if y == k and s is not None] for k in (1, 0))
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert metrics.roc_auc(df, "p", "y", per_bucket=20).first()["auc"] == pytest.approx(want)
    assert "aggregate(" not in _plan(metrics._score_counts(df, "p", "y", per_bucket=20))


def test_names_are_sent_to_the_rows(spark, table):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    names = spark.createDataFrame([("a", "first")], "feature_code string, feature_name string")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = feature_labels(attribute_linear(table, "id", _FEATURES, _SCORER, table), names)
        assert "BroadcastHashJoin" in _plan(out) and "SortMergeJoin" not in _plan(out)
        assert {r.feature_code: r.feature_name for r in out.collect()} == {"a": "first", "b": "b", "c": "c", "d": "d"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_margin_attribution_is_against_the_whole_supplier_table(spark, tmp_path):
    from surveylab.plans.catalog_io import _SHAP_COEFS, q_margin
    rnd = random.Random(4)
    rows = [(i, rnd.randrange(25), round(rnd.uniform(-900, 9000), 2)) for i in range(1, 121)]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    values = [{"s_nationkey": float(n), "s_acctbal": a, "s_digits": float(k % 10)} for k, n, a in rows]
    mean = {c: sum(v[c] for v in values) / len(values) for c in _SHAP_COEFS}
    got = {(r.s_suppkey, r.feature_code): r.shap_value for r in q_margin(spark, str(tmp_path)).collect()}
    assert len(got) == 3 * len(rows)
    for (key, _, _), v in zip(rows, values):
        for c, w in _SHAP_COEFS.items():
            assert got[key, c] == pytest.approx(w * (v[c] - mean[c]), abs=1e-4)


def test_explanations_and_waterfalls_are_ranked_in_the_row_by_columns(spark, table):
    from surveylab.operators.attribution import explain, explain_arrays, waterfall, waterfall_arrays
    rows = table.withColumn("row_id", F.monotonically_increasing_id()).localCheckpoint()
    long, wide = (attribute_linear(rows, ["id", "row_id"], _FEATURES, _SCORER, rows, wide=w) for w in (False, True))
    key = ["id", "row_id"]
    got = explain_arrays(wide, key, top=3, side=1, features=_FEATURES)
    want = explain(long, key, top=3, side=1)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    steps, plain = waterfall_arrays(wide, key, 0.25, features=_FEATURES), waterfall(long, key, 0.25)
    assert sorted(map(tuple, steps.select(plain.columns).collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    for name in ("explain_top_features", "waterfall_linear"):
        import __spark_entry__ as E
        plan = _plan(E.queries()[name](spark, SF001))
        assert "Window" not in plan and "lambda" not in plan.split("attribution")[0], name


def test_a_joins_tasks_get_parts_of_bounded_size(spark):
    from surveylab.session import PART_MB, plan_settings
    part = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(part)
    try:
        for had, want in (("64m", f"{PART_MB}m"), ("67108864b", f"{PART_MB}m"), ("64MB", f"{PART_MB}m"), ("1g", f"{PART_MB}m"),
                          ("8m", "8m"), ("4096", "4096")):
            spark.conf.set(part, had)
            assert plan_settings(spark).conf.get(part) == want
    finally:
        spark.conf.set(part, before)


def _own_survey(spark, tmp_path, monkeypatch, columns):
    """The survey's frame replaced by a table of our own, whose scans a plan names."""
    from surveylab.plans import catalog_ml
    from surveylab.plans.tables import CHILD_KEY
    rnd = random.Random(12)
    names = [*CHILD_KEY, *columns, "stunting_label"]
    rows = [(i, 1, i, i, *[float(rnd.randrange(1, 40)) for _ in columns], int(rnd.random() < 0.4)) for i in range(300)]
    schema = ", ".join(f"{c} {'long' if c in CHILD_KEY else 'int' if c == 'stunting_label' else 'double'}" for c in names)
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "own_survey.parquet"))
    monkeypatch.setattr(catalog_ml, "survey_frame", lambda s, sf: s.read.parquet(f"{sf}/own_survey.parquet"))
    monkeypatch.setattr(catalog_ml, "derive", lambda df: df)
    return catalog_ml


def test_transformers_read_a_split_that_is_made_once(spark, tmp_path, monkeypatch):
    columns = ["mother_age", "mother_bmi", "wealth_index", "mother_education", "child_age_months", "sanitation_score", "share_toilet",
               "electricity"]
    ml = _own_survey(spark, tmp_path, monkeypatch, columns)
    out = ml.q_pca_km(spark, str(tmp_path))
    assert "own_survey" not in _plan(out) and "Window" not in _plan(out)
    rows = out.collect()
    assert len(rows) == 300 and sum(r.split == "test" for r in rows) in (59, 60, 61)
    assert all(r.kmeans_dist_0 >= 0 and r.pca_socio_wash_1 is not None for r in rows)


def test_document_features_match_runs_of_characters_at_once(spark, tmp_path):
    from surveylab.plans.catalog_ml import DOC_FEATURES, doc_model_frame
    texts = ["", None, "abc", "A1b2 C3", "2024", " x\n\tY 7 ", "Ümlaut ÄÖ 9٣", "AB" * 50 + "\n" + "12 " * 40]
    spark.createDataFrame([(i, t, len(t or ""), "en") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, lang string") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 1) for i in range(len(texts))], "doc_id long, toxic int, quality int") \
        .write.parquet(str(tmp_path / "labels.parquet"))
    out = doc_model_frame(spark, str(tmp_path))
    got = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(t or "" for t in texts):
        assert got[i].f_digit_share == pytest.approx(sum(c in "0123456789" for c in t) / max(1, len(t)))
        assert got[i].f_upper_share == pytest.approx(sum("A" <= c <= "Z" for c in t) / max(1, len(t)))
    assert set(DOC_FEATURES) <= set(out.columns)
    plan = _plan(out)
    assert "[^0-9]+" in plan and "[^A-Z]+" in plan  # a match for each character took most of the time
