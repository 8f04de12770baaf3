"""Registered queries: metrics, scoring and tiers, what-if, attribution.

The scorer is the fixed-coefficient logistic model of ``plans.survey`` so
each result has a closed-form SQL twin.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from surveylab.operators import metrics
from surveylab.operators.attribution import (attribute_linear, base_value, explain_arrays, global_importance_arrays,
                                             label_direction, waterfall_arrays)
from surveylab.operators.features import FEATURE_NAMES, feature_labels
from surveylab.operators.scoring import (BASE_RATE, KNEE_INDEX, REQUEST_CATEGORICAL, REQUEST_DEFAULTS,
                                         SHORT_FORM_FIELDS, SHORT_FORM_FIXED, TIERS, TOP_PROB, build_features, risk_worklist,
                                         score_and_tier)
from surveylab.operators.simulate import best_scenario, diff_rows, mutable_columns, simulate, tier_shift, _apply_sequential
from surveylab.plans.registry import register
from surveylab.plans.survey import (IMMUTABLE, PACKAGES, SCORE_FEATURES, SCORER, derive, features_sql_exprs,
                                    package_sql_overrides, survey_frame, survey_sql)
from surveylab.plans.tables import CHILD_KEY, table

DP = 6
KEYS = ", ".join(CHILD_KEY)
THRESHOLD = 0.35  # decision threshold of the fixed scorer


def scored(spark, sf):
    return SCORER.score(derive(survey_frame(spark, sf)))


def _feat_cols_sql(src: str = "survey") -> str:
    return f"SELECT {src}.*, " + ", ".join(f"{e} AS {n}" for n, e in features_sql_exprs().items()) + f" FROM {src}"


SCORED_SQL = (survey_sql() + f",\nfeat AS ({_feat_cols_sql()}),\n"
              f"sc AS (SELECT feat.*, {SCORER.sql_prob()} AS probability,"
              f" CAST(l_returnflag_r AS INTEGER) AS y FROM feat)")
# the label travels as stunting_label; alias used by the metric SQL
SCORED_SQL = SCORED_SQL.replace("CAST(l_returnflag_r AS INTEGER)", "stunting_label")


def _index_sql(p: str) -> str:
    raw = (f"CASE WHEN {p} < {BASE_RATE} THEN {p} / {BASE_RATE} * {KNEE_INDEX} "
           f"ELSE {KNEE_INDEX} + ({p} - {BASE_RATE}) / ({TOP_PROB} - {BASE_RATE}) * {100.0 - KNEE_INDEX} END")
    return f"CASE WHEN {p} IS NULL THEN NULL ELSE LEAST(100.0, GREATEST(0.0, {raw})) END"


def _tier_sql(idx: str, field: int) -> str:
    parts = " ".join(f"WHEN {idx} >= {lo} THEN {vals[field]!r}" for lo, *vals in reversed(TIERS))
    return f"CASE {parts} ELSE {TIERS[0][field + 1]!r} END"


TIERED_SQL = SCORED_SQL + (f",\nti AS (SELECT sc.*, round({_index_sql('probability')}, 2) AS risk_pct FROM sc),\n"
                           f"tt AS (SELECT ti.*, {_tier_sql('risk_pct', 0)} AS tier, {_tier_sql('risk_pct', 1)} AS badge,"
                           f" {_tier_sql('risk_pct', 2)} AS action FROM ti)")


# ------------------------------------------------------------------ scoring
@register("score_tiers", ids=("SCO2", "SCO3", "SCO4", "SCL1"), sql=f"""
{TIERED_SQL}
SELECT {KEYS}, round(probability, {DP}) AS probability, risk_pct, tier, badge, action FROM tt
""")
def q_score(spark, sf):
    s = score_and_tier(derive(survey_frame(spark, sf)), SCORER)
    return s.select(*CHILD_KEY, F.round("probability", DP).alias("probability"), "risk_pct", "tier", "badge", "action")


@register("risk_tier_counts_by_area", ids=("SCO5",), sql=f"""
{TIERED_SQL}
SELECT area, tier, count(*)::BIGINT AS n FROM tt GROUP BY area, tier
""")
def q_worklist_counts(spark, sf):
    s = score_and_tier(derive(survey_frame(spark, sf)), SCORER)
    counts, _ = risk_worklist(s, "area", CHILD_KEY, k=5)
    return counts


@register("risk_top5_per_area", ids=("SCO5", "TOP2"), sql=f"""
{TIERED_SQL}
SELECT * FROM (SELECT area, {KEYS}, round(probability, {DP}) AS probability, tier,
       row_number() OVER (PARTITION BY area ORDER BY probability DESC, {KEYS}) AS rank FROM tt) WHERE rank <= 5
""")
def q_worklist_top(spark, sf):
    s = score_and_tier(derive(survey_frame(spark, sf)), SCORER)
    _, top = risk_worklist(s, "area", CHILD_KEY, k=5)
    return top.select("area", *CHILD_KEY, F.round("probability", DP).alias("probability"), "tier",
                      F.col("rank").cast("bigint").alias("rank"))


# request scoring from the events table (SCO1 / SCO6)
EVENT_FIELDS = {  # fixed values of this fixture: request field -> expression over events
    "child_age_months": "get_json_object(props, '$.k')",
    "anc_visits": "CAST(value / 50 AS DOUBLE)",
    "mother_age": "CAST(15 + user_id % 35 AS DOUBLE)",
    "wealth_index": "CAST(1 + user_id % 5 AS DOUBLE)",
    "mother_education": "CAST(user_id % 4 AS DOUBLE)",
    "diarrhea_recent": "CAST(event_type = 'error' AS INTEGER)",
}
EVENT_CATEGORICAL = {"toilet_type": "concat('toilet_type_', event_type)"}
REQUEST_FEATURES = (list(REQUEST_DEFAULTS) + ["toilet_type_BUILDING", "toilet_type_click", "toilet_type_view",
                                               "water_source_11", "water_source_5-LOW", "delivery_place_21"]
                    + FEATURE_NAMES)


def _requests(spark, sf, fields, categorical):
    e = table(spark, sf, "events")
    return e.select("event_id", *[F.expr(x).alias(f"src_{f}") for f, x in fields.items()],
                    *[F.expr(x).alias(f"src_{f}") for f, x in categorical.items()])


def _request_sql(fields, rounded: bool = True, defaults=REQUEST_DEFAULTS, categorical=EVENT_CATEGORICAL):
    sel = []
    for f, dflt in defaults.items():
        sel.append(f"coalesce(TRY_CAST(CAST({fields[f].replace('get_json_object', 'json_extract_string')} AS VARCHAR) AS DOUBLE), {dflt})"
                   f" AS {f}" if f in fields else f"CAST({float(dflt)} AS DOUBLE) AS {f}")
    cats = {}
    for f, dflt in REQUEST_CATEGORICAL.items():
        cats[f] = f"coalesce({categorical[f]}, {dflt!r})" if f in categorical else repr(dflt)
    for f, v in cats.items():
        sel.append(f"{v} AS __{f}")
    base = f"SELECT event_id, {', '.join(sel)} FROM events"
    ind = []
    for n in REQUEST_FEATURES:
        if n in REQUEST_DEFAULTS or n in FEATURE_NAMES:
            continue
        f = next(f for f in REQUEST_CATEGORICAL if n.startswith(f + "_"))
        ind.append(f"CAST(coalesce(__{f} = {n!r}, false) AS DOUBLE) AS \"{n}\"")
    lv = [f"CASE WHEN starts_with(__{f}, '{f}_') THEN substr(__{f}, {len(f) + 2}) END AS {f}" for f in REQUEST_CATEGORICAL]
    feats = ", ".join(f"round({e}, {DP}) AS {n}" if rounded and n != "mother_age_group" else f"{e} AS {n}"
                      for n, e in features_sql_exprs().items())
    outs = ", ".join(f"CAST({n} AS DOUBLE) AS \"{n}\"" if n in FEATURE_NAMES else f"\"{n}\"" for n in REQUEST_FEATURES)
    return (f"WITH r0 AS ({base}), r1 AS (SELECT r0.*, {', '.join(ind + lv)} FROM r0),\n"
            f"r2 AS (SELECT r1.*, {feats} FROM r1)\nSELECT event_id, {outs}, '' AS error FROM r2")


def _build_request_features(spark, sf, fields, categorical=EVENT_CATEGORICAL, defaults=REQUEST_DEFAULTS):
    req = _requests(spark, sf, fields, categorical)
    out = build_features(req, REQUEST_FEATURES, numeric={f: f"src_{f}" for f in fields},
                         categorical={f: f"src_{f}" for f in categorical}, defaults=defaults, keep=["event_id"],
                         derive=derive)
    return out.withColumns({n: F.round(n, DP) for n in FEATURE_NAMES if n != "mother_age_group"})


@register("build_features_requests", ids=("SCO1", "SCL6", "SCL5"), sql=_request_sql(EVENT_FIELDS))
def q_build(spark, sf):
    return _build_request_features(spark, sf, EVENT_FIELDS)


SHORT_CATEGORICAL = {**EVENT_CATEGORICAL, "water_source": "concat('water_source_', CAST(user_id % 12 AS STRING))"}
# The oracle's own statement of the short form: five questions, three fixed
# answers, and the declared defaults of everything else.
_SHORT_ASKED = ("child_age_months", "anc_visits", "diarrhea_recent")
_SHORT_SQL = _request_sql({f: EVENT_FIELDS[f] for f in _SHORT_ASKED}, categorical=SHORT_CATEGORICAL, defaults={
    "child_age_months": 24.0, "child_sex": 0.0, "birth_order": 1.0, "birth_interval": 36.0, "anc_visits": 4.0,
    "caesarean": 0.0, "diarrhea_recent": 0.0, "fever_recent": 0.0, "mother_age": 26.0, "mother_education": 1.0,
    "wealth_index": 2.0, "mother_anemia": 0.0, "electricity": 1.0, "share_toilet": 0.0, "mother_bmi": 21.5})


@register("short_form_requests", ids=("SCO6",), sql=_SHORT_SQL)
def q_short(spark, sf):
    return _build_request_features(
        spark, sf, {f: EVENT_FIELDS[f] for f in SHORT_FORM_FIELDS if f in EVENT_FIELDS},
        {f: SHORT_CATEGORICAL[f] for f in SHORT_FORM_FIELDS if f in SHORT_CATEGORICAL},
        {**REQUEST_DEFAULTS, **SHORT_FORM_FIXED})


# ------------------------------------------------------------------ metrics
_PRED = f"CAST(probability >= {THRESHOLD} AS INTEGER)"


def _with_pred(spark, sf):
    return scored(spark, sf).withColumn("pred", (F.col("probability") >= THRESHOLD).cast("int"))


@register("roc_auc_linear", ids=("MET1",), sql=f"""
{SCORED_SQL},
g AS (SELECT probability AS s, sum(stunting_label) AS pos, sum(1 - stunting_label) AS neg FROM sc GROUP BY probability),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM g)
SELECT round((sum(pos * nb) + 0.5 * sum(pos * neg)) / (sum(pos) * sum(neg)), {DP}) AS auc FROM c
""")
def q_auc(spark, sf):
    return metrics.roc_auc(scored(spark, sf), "probability", "stunting_label").select(F.round("auc", DP).alias("auc"))


@register("metrics_by_group_linear", ids=("MET1", "MET2", "MET5", "MOD10"), sql=f"""
{SCORED_SQL},
m AS (SELECT toilet_type, probability AS p, stunting_label AS y, CAST(probability >= 0.5 AS INTEGER) AS h FROM sc),
g AS (SELECT toilet_type, p AS s, sum(y) AS pos, sum(1 - y) AS neg FROM m GROUP BY toilet_type, p),
c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY toilet_type ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      AS nb FROM g),
a AS (SELECT toilet_type, (sum(pos * nb) + 0.5 * sum(pos * neg)) / (sum(pos) * sum(neg)) AS auc FROM c GROUP BY toilet_type),
k AS (SELECT toilet_type, sum(h * y) AS tp, sum(h * (1 - y)) AS fp, sum((1 - h) * y) AS fn, count(*) AS n,
             avg(pow(p - y, 2)) AS brier FROM m GROUP BY toilet_type)
SELECT toilet_type, round(auc, {DP}) AS auc, round(coalesce(tp / nullif(tp + fn, 0), 0.0), {DP}) AS recall,
       round(coalesce(tp / nullif(tp + fp, 0), 0.0), {DP}) AS precision, round(brier, {DP}) AS brier, n::BIGINT AS n
FROM k JOIN a USING (toilet_type)
""")
def q_metrics_by(spark, sf):
    m = metrics.grouped_metrics(scored(spark, sf), ["toilet_type"], "probability", "stunting_label")
    return m.select("toilet_type", *[F.round(c, DP).alias(c) for c in ("auc", "recall", "precision", "brier")], "n")


_COUNTS_SQL = f"""
{SCORED_SQL},
k AS (SELECT sum(CASE WHEN {_PRED} = 1 AND stunting_label = 1 THEN 1 ELSE 0 END) AS tp,
             sum(CASE WHEN {_PRED} = 1 AND stunting_label = 0 THEN 1 ELSE 0 END) AS fp,
             sum(CASE WHEN {_PRED} = 0 AND stunting_label = 1 THEN 1 ELSE 0 END) AS fn,
             sum(CASE WHEN {_PRED} = 0 AND stunting_label = 0 THEN 1 ELSE 0 END) AS tn FROM sc)"""


def _z(a, b):
    return f"coalesce(({a}) * 1.0 / nullif({b}, 0), 0.0)"


@register("binary_metrics_linear", ids=("MET2",), sql=f"""
{_COUNTS_SQL},
m AS (SELECT *, {_z('tp', 'tp + fp')} AS p, {_z('tp', 'tp + fn')} AS r FROM k)
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(p, {DP}) AS precision,
       round(r, {DP}) AS recall, round({_z('2 * p * r', 'p + r')}, {DP}) AS f1,
       round({_z('tp + tn', 'tp + tn + fp + fn')}, {DP}) AS accuracy FROM m
""")
def q_bin(spark, sf):
    return metrics.binary_metrics(_with_pred(spark, sf), "pred", "stunting_label", dp=DP)


@register("classification_report_linear", ids=("MET3",), sql=f"""
{_COUNTS_SQL},
m AS (SELECT *, {_z('tp', 'tp + fp')} AS p1, {_z('tp', 'tp + fn')} AS r1, {_z('tn', 'tn + fn')} AS p0,
             {_z('tn', 'tn + fp')} AS r0, tp + fn AS s1, tn + fp AS s0 FROM k),
f AS (SELECT *, {_z('2 * p1 * r1', 'p1 + r1')} AS f1, {_z('2 * p0 * r0', 'p0 + r0')} AS f0, s0 + s1 AS n FROM m)
SELECT '0' AS class, round(p0, {DP}) AS precision, round(r0, {DP}) AS recall, round(f0, {DP}) AS f1, s0::BIGINT AS support FROM f
UNION ALL SELECT '1', round(p1, {DP}), round(r1, {DP}), round(f1, {DP}), s1::BIGINT FROM f
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, {DP}), round((r0 + r1) / 2, {DP}), round((f0 + f1) / 2, {DP}), n::BIGINT FROM f
UNION ALL SELECT 'weighted avg', round({_z('p0 * s0 + p1 * s1', 'n')}, {DP}), round({_z('r0 * s0 + r1 * s1', 'n')}, {DP}),
       round({_z('f0 * s0 + f1 * s1', 'n')}, {DP}), n::BIGINT FROM f
""")
def q_report(spark, sf):
    return metrics.classification_report(_with_pred(spark, sf), "pred", "stunting_label", dp=DP)


@register("confusion_linear", ids=("MET4",), sql=f"""
{_COUNTS_SQL}
SELECT 0 AS label, 0 AS pred, tn::BIGINT AS count FROM k UNION ALL SELECT 0, 1, fp::BIGINT FROM k
UNION ALL SELECT 1, 0, fn::BIGINT FROM k UNION ALL SELECT 1, 1, tp::BIGINT FROM k
""")
def q_conf(spark, sf):
    return metrics.confusion(_with_pred(spark, sf), "pred", "stunting_label")


@register("brier_linear", ids=("MET5",), sql=f"""
{SCORED_SQL}
SELECT round(avg(pow(probability - stunting_label, 2)), {DP}) AS brier FROM sc
""")
def q_brier(spark, sf):
    return metrics.brier(scored(spark, sf), "probability", "stunting_label", dp=DP)


@register("roc_curve_risk_index", ids=("MET6", "SCO3"), sql=f"""
{TIERED_SQL},
g AS (SELECT risk_pct / 100.0 AS s, sum(stunting_label) AS pos, sum(1 - stunting_label) AS neg FROM tt GROUP BY 1),
c AS (SELECT *, sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
             sum(neg) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp FROM g)
SELECT round(s, {DP}) AS threshold, round(fp * 1.0 / (SELECT sum(neg) FROM g), {DP}) AS fpr,
       round(tp * 1.0 / (SELECT sum(pos) FROM g), {DP}) AS tpr FROM c
""")
def q_roc(spark, sf):
    s = score_and_tier(derive(survey_frame(spark, sf)), SCORER).withColumn("s", F.col("risk_pct") / 100.0)
    r = metrics.roc_curve(s, "s", "stunting_label")
    return r.select(F.round("threshold", DP).alias("threshold"), F.round("fpr", DP).alias("fpr"),
                    F.round("tpr", DP).alias("tpr"))


# ------------------------------------------------------------------ what-if
def _sim_sql():
    ov = package_sql_overrides()
    base_cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"] + [
        c for c in ("area", "child_age_months", "child_sex", "birth_order", "birth_interval", "anc_visits",
                    "diarrhea_recent", "fever_recent", "caesarean", "mother_age", "mother_education", "wealth_index",
                    "mother_anemia", "mother_bmi", "share_toilet", "electricity", "toilet_type", "water_source",
                    "delivery_place", "stunting_label", "rid")]
    num_like = {"toilet_type", "water_source", "delivery_place"}

    def sel(pid, o):
        cols = []
        for c in base_cols:
            if c in o:
                cols.append(f"{o[c]} AS {c}")
            elif c in CHILD_KEY or c in num_like or c in ("area", "stunting_label", "rid"):
                cols.append(c)
            else:
                cols.append(f"CAST({c} AS DOUBLE) AS {c}" if pid != "baseline" else c)
        return f"SELECT '{pid}' AS package_id, {', '.join(cols)}, baseline_risk_pct FROM base"

    parts = [sel(p, o) for p, o in ov.items()]
    names = " ".join(f"WHEN '{p.package_id}' THEN {p.package_name!r}" for p in PACKAGES)
    # each row carries its own baseline index through the fan-out
    return (survey_sql() + f",\nbf AS ({_feat_cols_sql('survey')}),\n"
            f"base AS (SELECT row_number() OVER () AS rid, * EXCLUDE ({', '.join(FEATURE_NAMES)}), "
            f"round({_index_sql(SCORER.sql_prob())}, 2) AS baseline_risk_pct FROM bf),\n"
            "fan AS (" + "\nUNION ALL ".join(parts) + "),\n"
            f"feat AS ({_feat_cols_sql('fan')}),\n"
            f"sc AS (SELECT feat.*, round({_index_sql(SCORER.sql_prob())}, 2) AS simulated_risk_pct FROM feat),\n"
            f"sim AS (SELECT {KEYS}, rid, package_id, CASE package_id {names} END AS package_name, baseline_risk_pct,"
            f" simulated_risk_pct, round(baseline_risk_pct - simulated_risk_pct, 2) AS risk_reduction_pct FROM sc)")


SIM_SQL = _sim_sql()


def _simulated(spark, sf):
    return simulate(survey_frame(spark, sf), CHILD_KEY, PACKAGES, SCORER, derive=derive)


@register("simulate_packages", ids=("SIM1", "SIM2", "SIM3"), sql=SIM_SQL + "\nSELECT * EXCLUDE (rid) FROM sim")
def q_sim(spark, sf):
    return _simulated(spark, sf)


@register("best_scenario", ids=("SIM4",), sql=SIM_SQL + f"""
SELECT {KEYS}, arg_min(package_id, struct_pack(a := -risk_reduction_pct, b := package_id)) AS best_package,
       max(risk_reduction_pct) AS best_reduction_pct FROM sim GROUP BY {KEYS}, rid
""")
def q_best(spark, sf):
    # A child key may repeat: every row is ranked by itself.
    rows = survey_frame(spark, sf).withColumn("row_id", F.monotonically_increasing_id())
    sim = simulate(rows, [*CHILD_KEY, "row_id"], PACKAGES, SCORER, derive=derive)
    return best_scenario(sim, [*CHILD_KEY, "row_id"]).drop("row_id")


@register("tier_shift_by_package", ids=("SIM4",), sql=SIM_SQL + f"""
SELECT package_id, sum(CASE WHEN baseline_risk_pct >= 35.0 THEN 1 ELSE 0 END)::BIGINT AS n_at_risk,
       sum(CASE WHEN baseline_risk_pct >= 35.0 AND simulated_risk_pct < 35.0 THEN 1 ELSE 0 END)::BIGINT AS n_moved,
       round(sum(CASE WHEN baseline_risk_pct >= 35.0 AND simulated_risk_pct < 35.0 THEN 1.0 ELSE 0.0 END)
             / nullif(sum(CASE WHEN baseline_risk_pct >= 35.0 THEN 1.0 ELSE 0.0 END), 0), {DP}) AS share_moved
FROM sim GROUP BY package_id
""")
def q_shift(spark, sf):
    t = tier_shift(_simulated(spark, sf), 35.0)
    return t.withColumn("share_moved", F.round("share_moved", DP))


_DIFF_COLS = ["anc_visits", "diarrhea_recent", "fever_recent", "mother_anemia", "mother_education", "share_toilet"]


@register("diff_rows_comprehensive", ids=("SIM6", "SIM7", "SIM2"), sql=survey_sql() + ",\nnw AS (SELECT " + KEYS + ", " + ", ".join(
    f"CAST({package_sql_overrides()['comprehensive_package'].get(c, c)} AS DOUBLE) AS {c}" for c in _DIFF_COLS)
    + " FROM survey),\n" + "o AS (" + "\nUNION ALL ".join(
    f"SELECT {KEYS}, '{c}' AS feature, CAST({c} AS DOUBLE) AS \"from\" FROM survey" for c in _DIFF_COLS) + "),\n"
    + "n AS (" + "\nUNION ALL ".join(f"SELECT {KEYS}, '{c}' AS feature, {c} AS \"to\" FROM nw" for c in _DIFF_COLS) + ")\n"
    + f"SELECT o.l_orderkey, o.l_linenumber, o.l_partkey, o.l_suppkey, o.feature, o.\"from\", n.\"to\" FROM o JOIN n USING ({KEYS}, feature)"
    + " WHERE o.\"from\" IS DISTINCT FROM n.\"to\"")
def q_diff(spark, sf):
    s = survey_frame(spark, sf)
    cols = [c for c in mutable_columns(s, IMMUTABLE + CHILD_KEY) if c in _DIFF_COLS]
    comp = [p for p in PACKAGES if p.package_id == "comprehensive_package"]
    new = _apply_sequential(s.withColumn("package_id", F.lit("comprehensive_package")),
                            [PACKAGES[0]] + comp).drop("package_id")
    return diff_rows(s, new, CHILD_KEY, cols)


# ------------------------------------------------------------------ attribution
# Readable names of some feature codes (unknown codes keep the code).
FEATURE_DICTIONARY = [
    ("sanitation_score", "Sanitation vulnerability score"),
    ("anc_adequacy_flag", "Adequate antenatal care visits"),
    ("disease_burden_index", "Recent disease burden"),
    ("maternal_vulnerability_score", "Maternal vulnerability score"),
    ("wealth_index", "Household wealth index"),
    ("mother_education", "Mother's education level"),
]


def sql_str(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _features_frame(spark, sf):
    return derive(survey_frame(spark, sf)).select(*CHILD_KEY, *SCORE_FEATURES)


FEAT_SQL = survey_sql() + f",\nfeat AS (SELECT row_number() OVER () AS rid, z.* FROM ({_feat_cols_sql()}) z),\n" + (
    "bg AS (SELECT * FROM feat),\n"
    "mu AS (SELECT " + ", ".join(f"avg(coalesce(CAST({c} AS DOUBLE), 0.0)) AS {c}" for c in SCORE_FEATURES) + " FROM bg),\n"
    "dict AS (SELECT * FROM (VALUES " + ", ".join(f"({sql_str(a)}, {sql_str(b)})" for a, b in FEATURE_DICTIONARY)
    + ") AS d(feature_code, feature_name)),\n"
    "att AS (" + "\nUNION ALL ".join(
        f"SELECT {KEYS}, rid, '{c}' AS feature_code, CAST(feat.{c} AS DOUBLE) AS value, "
        f"{SCORER.coefs[c]!r} * (coalesce(CAST(feat.{c} AS DOUBLE), 0.0) - mu.{c}) AS shap_value FROM feat, mu"
        for c in SCORE_FEATURES) + "),\n"
    "lab AS (SELECT att.*, coalesce(dict.feature_name, att.feature_code) AS feature_name,"
    " CASE WHEN shap_value > 0.01 THEN 'increases_risk' WHEN shap_value < -0.01 THEN 'reduces_risk' ELSE 'neutral' END AS direction,"
    " round(shap_value * 100.0, 2) AS impact_pct FROM att LEFT JOIN dict ON att.feature_code = dict.feature_code)")


def _attr(spark, sf, wide=False, rows=False):
    """Contributions against the means of the whole table; with ``rows`` each row, as a child key may repeat, has an own
    ``row_id`` in its key."""
    f = _features_frame(spark, sf)
    if rows:
        f = f.withColumn("row_id", F.monotonically_increasing_id())
    return attribute_linear(f, [*CHILD_KEY, "row_id"] if rows else CHILD_KEY, SCORE_FEATURES, SCORER, f, wide=wide)


def _dict(spark):
    return spark.createDataFrame(FEATURE_DICTIONARY, "feature_code string, feature_name string")


@register("attribute_linear", ids=("EXP2", "EXP4", "FEA13", "TOP5"), sql=FEAT_SQL + f"""
SELECT {KEYS}, feature_code, feature_name, round(value, 2) AS value, round(shap_value, 4) AS shap_value,
       impact_pct, direction FROM lab
""")
def q_attr(spark, sf):
    a = label_direction(feature_labels(_attr(spark, sf), _dict(spark)))
    return a.select(*CHILD_KEY, "feature_code", "feature_name", "value", "shap_value", "impact_pct", "direction")


@register("base_value_background", ids=("EXP3",), sql=survey_sql() + f",\nfeat AS ({_feat_cols_sql()}),\n"
          "bg AS (SELECT * FROM feat)\n"
          f"SELECT round(avg({SCORER.sql_prob()}), {DP}) AS base_value FROM bg")
def q_base(spark, sf):
    return base_value(_features_frame(spark, sf), SCORER).select(F.round("base_value", DP).alias("base_value"))


@register("explain_top_features", ids=("EXP5", "TOP2"), sql=FEAT_SQL + f"""
, r AS (SELECT {KEYS}, feature_code, shap_value,
        row_number() OVER (PARTITION BY rid ORDER BY round(abs(shap_value), 9) DESC, feature_code) AS rk FROM att),
p AS (SELECT {KEYS}, feature_code, shap_value,
        row_number() OVER (PARTITION BY rid ORDER BY round(abs(shap_value), 9) DESC, feature_code) AS rk FROM att WHERE shap_value > 0),
n AS (SELECT {KEYS}, feature_code, shap_value,
        row_number() OVER (PARTITION BY rid ORDER BY round(abs(shap_value), 9) DESC, feature_code) AS rk FROM att WHERE shap_value < 0)
SELECT {KEYS}, feature_code, round(shap_value, {DP}) AS shap_value, rk AS rank, 'top' AS list FROM r WHERE rk <= 10
UNION ALL SELECT {KEYS}, feature_code, round(shap_value, {DP}), rk, 'risk' FROM p WHERE rk <= 5
UNION ALL SELECT {KEYS}, feature_code, round(shap_value, {DP}), rk, 'protective' FROM n WHERE rk <= 5
""")
def q_explain(spark, sf):
    e = explain_arrays(_attr(spark, sf, wide=True), CHILD_KEY, features=SCORE_FEATURES)
    return e.select(*CHILD_KEY, "feature_code", F.round("shap_value", DP).alias("shap_value"),
                    F.col("rank").cast("bigint").alias("rank"), "list")


@register("global_importance_linear", ids=("EXP6", "TOP3"), sql=FEAT_SQL + """
SELECT feature_code, round(avg(abs(shap_value)), 4) AS mean_abs_shap, round(avg(abs(shap_value)) * 100.0, 2) AS importance_score
FROM att GROUP BY feature_code ORDER BY avg(abs(shap_value)) DESC, feature_code LIMIT 15
""")
def q_global(spark, sf):
    return global_importance_arrays(_attr(spark, sf, wide=True), SCORE_FEATURES, n=15)


@register("waterfall_linear", ids=("EXP7",), sql=FEAT_SQL + f"""
, b AS (SELECT avg({SCORER.sql_margin().replace('CAST(', 'CAST(bg.')}) AS base FROM bg)
SELECT {KEYS}, feature_code, row_number() OVER w AS step,
       round((SELECT base FROM b) + sum(shap_value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), {DP}) AS running_total
FROM att WINDOW w AS (PARTITION BY rid ORDER BY round(abs(shap_value), 9) DESC, feature_code)
""")
def q_waterfall(spark, sf):
    f = _features_frame(spark, sf)
    base = f.select(F.avg(SCORER.margin(f))).first()[0]
    w = waterfall_arrays(_attr(spark, sf, wide=True), CHILD_KEY, base, features=SCORE_FEATURES)
    return w.select(*CHILD_KEY, "feature_code", F.col("step").cast("bigint").alias("step"),
                    F.round("running_total", DP).alias("running_total"))


# ------------------------------------------------------------------ streaming
def _score_requests(df):
    """Row-local request scoring used by both the batch and the stream (STR1)."""
    from surveylab.operators.scoring import score_and_tier
    feats = build_features(df.select("event_id", *[F.expr(x).alias(f"src_{f}") for f, x in EVENT_FIELDS.items()],
                                     *[F.expr(x).alias(f"src_{f}") for f, x in EVENT_CATEGORICAL.items()]),
                           REQUEST_FEATURES, numeric={f: f"src_{f}" for f in EVENT_FIELDS},
                           categorical={f: f"src_{f}" for f in EVENT_CATEGORICAL}, keep=["event_id"], derive=derive)
    s = score_and_tier(feats, SCORER)
    return s.select("event_id", F.round("probability", DP).alias("probability"), "risk_pct", "tier", "error")


_REQ_SCORE_SQL = (_request_sql(EVENT_FIELDS, rounded=False).replace("\nSELECT event_id,", ",\nreq AS (SELECT event_id,", 1)
                  + f")\nSELECT event_id, round({SCORER.sql_prob().replace('CAST(', 'CAST(req.')}, {DP}) AS probability,"
                  f" round({_index_sql(SCORER.sql_prob().replace('CAST(', 'CAST(req.'))}, 2) AS risk_pct, '' AS error FROM req")


def _req_tier_sql():
    inner = _REQ_SCORE_SQL
    return (f"WITH scored_req AS ({inner})\nSELECT event_id, probability, risk_pct, "
            f"{_tier_sql('risk_pct', 0)} AS tier, error FROM scored_req")


@register("score_stream_events", ids=("STR1", "SCO1", "SCO2", "SCO3", "SCO4"), sql=_req_tier_sql())
def q_stream(spark, sf):
    from surveylab.streaming import run_to_table
    schema = table(spark, sf, "events").schema
    return run_to_table(spark, sf, schema, _score_requests, "score_events", file_filter="events.parquet")


@register("score_requests_batch", ids=("SCO1", "SCO2", "SCO3", "SCO4"), sql=_req_tier_sql())
def q_req_batch(spark, sf):
    return _score_requests(table(spark, sf, "events"))
