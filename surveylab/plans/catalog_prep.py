"""Registered queries: imputation, encoding, derived features, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveylab.operators import clean, link, stats
from surveylab.operators.encode import (OneHotColumns, RareCollapse, ZScore, label_codes,
                                        recode, threshold_label)
from surveylab.operators.features import FEATURE_NAMES, age_group
from surveylab.operators.impute import apply_plan, impute_by_kind, impute_mode, imputation_plan, plan_frame
from surveylab.operators.sampling import class_weights, repeated_folds, stratified_folds, stratified_split
from surveylab.plans.registry import register
from surveylab.plans.survey import ROLE_EXPRS, derive, features_sql_exprs, survey_frame, survey_sql
from surveylab.plans.tables import CHILD_KEY, SENTINELS, sql_uniform, table
from surveylab.session import kept

DP = 6
KEYS = ", ".join(CHILD_KEY)
P_SIZE_SQL = "CASE WHEN p_size BETWEEN 41 AND 50 THEN NULL ELSE p_size END"


def _survey_with_size(spark, sf):
    """Survey rows enriched with a high-missing column (part size, 41-50 -> NULL)."""
    s = survey_frame(spark, sf)
    p = clean.null_sentinels(table(spark, sf, "part").select("p_partkey", "p_size"), SENTINELS)
    return link.link_records(s, p.withColumnRenamed("p_size", "hh_size"), [("l_partkey", "p_partkey")])


SURVEY_SIZE_SQL = (survey_sql() + f",\nss AS (SELECT survey.*, {P_SIZE_SQL} AS hh_size FROM survey "
                   "JOIN part ON survey.l_partkey = part.p_partkey)")


# ------------------------------------------------------------------ imputation
@register("imputation_plan", ids=("IMP7", "IMP1", "IMP2"), sql=f"""
{SURVEY_SIZE_SQL},
sh AS (SELECT avg(CASE WHEN mother_bmi IS NULL THEN 1.0 ELSE 0.0 END) AS s_bmi,
              avg(CASE WHEN birth_interval IS NULL THEN 1.0 ELSE 0.0 END) AS s_int,
              avg(CASE WHEN hh_size IS NULL THEN 1.0 ELSE 0.0 END) AS s_size,
              median(mother_bmi) AS m_bmi FROM ss)
SELECT 'mother_bmi' AS column, 'continuous' AS "group", round(s_bmi, {DP}) AS null_share,
       CASE WHEN s_bmi = 0 THEN 'none' WHEN s_bmi <= 0.15 THEN 'median' ELSE 'mice' END AS method,
       round(CASE WHEN s_bmi > 0 AND s_bmi <= 0.15 THEN m_bmi END, {DP}) AS fill_value FROM sh
UNION ALL SELECT 'birth_interval', 'continuous', round(s_int, {DP}), CASE WHEN s_int = 0 THEN 'none' ELSE 'median' END, NULL FROM sh
UNION ALL SELECT 'hh_size', 'ordinal', round(s_size, {DP}),
       CASE WHEN s_size = 0 THEN 'none' WHEN s_size > 0.10 THEN 'missing_category' ELSE 'mode' END,
       CASE WHEN s_size > 0.10 THEN -1.0 END FROM sh
""")
def q_plan(spark, sf):
    df = _survey_with_size(spark, sf)
    plan = imputation_plan(df, continuous=["mother_bmi", "birth_interval"], ordinal=["hh_size"])
    return plan_frame(spark, plan).select(
        "column", "group", F.round("null_share", DP).alias("null_share"), "method",
        F.round(F.col("fill_value").cast("double"), DP).alias("fill_value"))


@register("impute_survey", ids=("IMP1", "IMP2", "FLT3"), sql=f"""
{SURVEY_SIZE_SQL}, m AS (SELECT median(mother_bmi) AS mb FROM ss)
SELECT {KEYS}, round(coalesce(mother_bmi, (SELECT mb FROM m)), {DP}) AS mother_bmi,
       CAST(coalesce(hh_size, -1) AS INTEGER) AS hh_size FROM ss
""")
def q_impute(spark, sf):
    df = _survey_with_size(spark, sf)
    plan = imputation_plan(df, continuous=["mother_bmi"], ordinal=["hh_size"])
    out = apply_plan(df, plan)
    return out.select(*CHILD_KEY, F.round("mother_bmi", DP).alias("mother_bmi"), "hh_size")


@register("impute_mode_part_size", ids=("IMP3",), sql=f"""
WITH p AS (SELECT p_partkey, {P_SIZE_SQL} AS p_size FROM part),
m AS (SELECT p_size AS v FROM p WHERE p_size IS NOT NULL GROUP BY p_size ORDER BY count(*) DESC, p_size LIMIT 1)
SELECT p_partkey, coalesce(p_size, (SELECT v FROM m)) AS p_size FROM p
""")
def q_mode(spark, sf):
    p = clean.null_sentinels(table(spark, sf, "part").select("p_partkey", "p_size"), SENTINELS)
    return impute_mode(p, ["p_size"])


@register("impute_mice_single_column", ids=("IMP4", "IMP1"), sql=f"""
{SURVEY_SIZE_SQL}, m AS (SELECT avg(hh_size) AS v FROM ss)
SELECT {KEYS}, round(coalesce(CAST(hh_size AS DOUBLE), (SELECT v FROM m)), {DP}) AS hh_size FROM ss
""")
def q_mice1(spark, sf):
    df = _survey_with_size(spark, sf).select(*CHILD_KEY, "hh_size")
    out = apply_plan(df, imputation_plan(df, continuous=["hh_size"]))
    return out.select(*CHILD_KEY, F.round("hh_size", DP).alias("hh_size"))


@register("impute_by_kind_part", ids=("IMP6", "PRJ2"), sql=f"""
WITH p AS (SELECT p_partkey, {P_SIZE_SQL} AS p_size,
                  CASE WHEN p_size BETWEEN 41 AND 50 THEN NULL ELSE p_type END AS p_type FROM part),
m AS (SELECT median(p_size) AS ms FROM p),
t AS (SELECT p_type AS v FROM p WHERE p_type IS NOT NULL GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 1)
SELECT p_partkey, round(coalesce(CAST(p_size AS DOUBLE), (SELECT ms FROM m)), {DP}) AS p_size,
       coalesce(p_type, (SELECT v FROM t)) AS p_type FROM p
""")
def q_by_kind(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_type")
    bad = F.col("p_size").between(41, 50)
    p = p.withColumn("p_type", F.when(~bad, F.col("p_type"))).withColumn("p_size", F.when(~bad, F.col("p_size")))
    out = impute_by_kind(p, exclude=["p_partkey"])
    return out.select("p_partkey", F.round("p_size", DP).alias("p_size"), "p_type")


# ------------------------------------------------------------------ encoding
@register("recode_survey", ids=("ENC1", "ENC2", "SCL2"), sql=f"""
{survey_sql(encoded=False)}
SELECT {KEYS}, CASE mother_anemia WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 0 ELSE mother_anemia END AS mother_anemia,
       CASE child_sex WHEN 1 THEN 0 WHEN 2 THEN 1 END AS child_sex FROM survey
""")
def q_recode(spark, sf):
    s = survey_frame(spark, sf, encoded=False)
    s = recode(s, "mother_anemia", {1: 3, 2: 2, 3: 1, 4: 0}, keep_unmapped=True)
    s = recode(s, "child_sex", {1: 0, 2: 1}, keep_unmapped=False)
    return s.select(*CHILD_KEY, "mother_anemia", "child_sex")


EVENT_K_SQL = "CAST(json_extract_string(props, '$.k') AS VARCHAR)"
_RARE_SQL = f"""
WITH e AS (SELECT event_id, {EVENT_K_SQL} AS k FROM events),
c AS (SELECT k, count(*) * 1.0 / (SELECT count(k) FROM e) AS share FROM e WHERE k IS NOT NULL GROUP BY k),
r AS (SELECT e.event_id, CASE WHEN e.k IS NULL THEN NULL WHEN c.share >= 0.01 THEN e.k ELSE 'other' END AS k
      FROM e LEFT JOIN c ON e.k = c.k)"""


def _events_k(spark, sf):
    from surveylab.operators.scoring import parse_payload
    e = table(spark, sf, "events")
    return e.select("event_id", parse_payload("props", "k int")["k"].alias("k"))


@register("rare_collapse_event_key", ids=("ENC3", "SCL6"), sql=_RARE_SQL + "\nSELECT event_id, k FROM r")
def q_rare(spark, sf):
    e = _events_k(spark, sf)
    return RareCollapse(inputCols=["k"], minShare=0.01).fit(e).transform(e)


@register("onehot_column_sums", ids=("ENC4", "AGG14"), sql=_RARE_SQL + """
SELECT 'k_' || k AS column, CAST(count(*) AS DOUBLE) AS col_sum, count(*) < 20 AS is_sparse FROM r
WHERE k IS NOT NULL GROUP BY k
""")
def q_onehot_sums(spark, sf):
    e = _events_k(spark, sf)
    e = RareCollapse(inputCols=["k"], minShare=0.01).fit(e).transform(e)
    m = OneHotColumns(inputCols=["k"]).fit(e)
    return stats.column_sums(m.transform(e), m.output_columns(), min_sum=20)


@register("onehot_fixed_vocabulary", ids=("ENC5", "ENC4"), sql="""
WITH tr AS (SELECT DISTINCT o_orderpriority AS lvl FROM orders WHERE o_orderstatus = 'F')
SELECT c_custkey, lvl AS level, CAST(coalesce(c_mktsegment = lvl, false) AS INTEGER) AS value
FROM customer, tr
""")
def q_onehot_fixed(spark, sf):
    # vocabulary fitted on one table and applied to another: every level of
    # the customer column is unseen, so each indicator is 0 (never an error)
    o = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F") \
        .select(F.col("o_orderpriority").alias("seg"))
    m = OneHotColumns(inputCols=["seg"]).fit(o)
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"))
    wide = m.transform(c)
    cols = m.output_columns()
    return wide.select("c_custkey", F.explode(F.array(*[F.struct(F.lit(x[4:]).alias("level"), F.col(x).alias("value"))
                                                       for x in cols])).alias("v")).select("c_custkey", "v.*")


@register("label_codes_brand", ids=("ENC6",), sql="""
SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY coalesce(p_brand, 'nan')) - 1 AS INTEGER) AS p_brand FROM part
""")
def q_label_codes(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    out, _ = label_codes(p, ["p_brand"])
    return out.select("p_partkey", "p_brand")


_TYPE_SQL = "CASE WHEN p_size BETWEEN 41 AND 50 THEN NULL ELSE p_type END"


@register("label_codes_with_null_level", ids=("ENC6",), sql=f"""
WITH p AS (SELECT p_partkey, {_TYPE_SQL} AS p_type, p_name FROM part)
SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY coalesce(p_type, 'nan')) - 1 AS INTEGER) AS p_type,
       CAST(dense_rank() OVER (ORDER BY coalesce(p_name, 'nan')) - 1 AS INTEGER) AS p_name FROM p
""")
def q_label_codes_null(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.expr(_TYPE_SQL).alias("p_type"), "p_name")
    return label_codes(p, ["p_type", "p_name"])[0]


#: The correlation matrix at the original's width: survey roles, derived features and indicators of five categories.
_WIDE_ROLES = [r for r in ROLE_EXPRS if r not in ("area", "toilet_type", "water_source", "delivery_place")]
_WIDE_LEVELS = {"toilet_type": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
                "water_source": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
                "delivery_place": ["F", "O", "P"], "order_level": [str(i) for i in range(1, 8)],
                "anemia_level": [str(i) for i in range(4)]}
_WIDE_COLS = _WIDE_ROLES + FEATURE_NAMES + [f"{c}_{v}" for c, lv in _WIDE_LEVELS.items() for v in lv]


def _wide_sql() -> str:
    feats = ", ".join(f"{e} AS {n}" for n, e in features_sql_exprs().items())
    marks = ", ".join(f"CAST(coalesce(CAST({c} AS VARCHAR) = '{v}', false) AS INTEGER) AS \"{c}_{v}\""
                      for c, lv in _WIDE_LEVELS.items() for v in lv)
    cols = ", ".join(f'CAST("{c}" AS DOUBLE) AS x{i}' for i, c in enumerate(_WIDE_COLS))
    pair = lambda i, j: (f"round(covar_pop(x{i}, x{j}) / nullif(stddev_pop(CASE WHEN x{j} IS NOT NULL THEN x{i} END)"  # noqa: E731
                         f" * stddev_pop(CASE WHEN x{i} IS NOT NULL THEN x{j} END), 0), {DP})")
    k = range(len(_WIDE_COLS))
    aggs = ", ".join(f"{pair(i, j)} AS r{i}_{j}" for i in k for j in k if i <= j)
    rows = ", ".join(f"{{'a': '{_WIDE_COLS[i]}', 'b': '{_WIDE_COLS[j]}', 'r': r{min(i, j)}_{max(i, j)}}}" for i in k for j in k)
    return f"""
{survey_sql()}, f AS (SELECT survey.*, CAST(birth_order AS INTEGER) AS order_level,
    CAST(mother_anemia AS INTEGER) AS anemia_level, {feats} FROM survey),
m AS (SELECT *, {marks} FROM f), x AS (SELECT {cols} FROM m), agg AS (SELECT {aggs} FROM x),
u AS (SELECT unnest([{rows}]) AS p FROM agg)
SELECT p.a AS a, p.b AS b, p.r AS r FROM u"""


@register("correlation_matrix_wide", ids=("AGG10", "ENC4"), sql=_wide_sql())
def q_corr_wide(spark, sf):
    f = derive(survey_frame(spark, sf)).withColumns({"order_level": F.col("birth_order").cast("int"),
                                                     "anemia_level": F.col("mother_anemia").cast("int")})
    f = kept(f.select(*_WIDE_COLS[:len(_WIDE_ROLES) + len(FEATURE_NAMES)], *_WIDE_LEVELS))
    wide = OneHotColumns(inputCols=list(_WIDE_LEVELS)).fit(f).transform(f)
    return stats.correlation_matrix(wide, _WIDE_COLS, dp=DP)


@register("threshold_label_haz", ids=("ENC7", "CLN2"), sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_discount * 10000 - 400) / 100.0 AS haz,
       CAST(coalesce((l_discount * 10000 - 400) / 100.0 < -2.0, false) AS INTEGER) AS stunting_label
FROM lineitem
""")
def q_threshold(spark, sf):
    li = table(spark, sf, "lineitem").select(*CHILD_KEY, (F.col("l_discount") * 10000 - 400).alias("haz_raw"))
    li = clean.rescale(li, {"haz_raw": (100, "haz")})
    return threshold_label(li, "haz", -2.0, out="stunting_label")


@register("zscore_totalprice", ids=("ENC8",), sql=f"""
SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders))
                         / (SELECT stddev_pop(o_totalprice) FROM orders), {DP}) AS o_totalprice FROM orders
""")
def q_z(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    out = ZScore(inputCols=["o_totalprice"]).fit(o).transform(o)
    return out.select("o_orderkey", F.round("o_totalprice", DP).alias("o_totalprice"))


# ------------------------------------------------------------------ features
def _feature_select_sql():
    return ",\n       ".join(
        f"round({e}, {DP}) AS {n}" if n != "mother_age_group" else f"{e} AS {n}"
        for n, e in features_sql_exprs().items())


@register("survey_features", ids=tuple(f"FEA{i}" for i in range(1, 11)) + ("PRJ5",), sql=f"""
{survey_sql()}
SELECT {KEYS}, {_feature_select_sql()} FROM survey
""")
def q_features(spark, sf):
    f = derive(survey_frame(spark, sf))
    return f.select(*CHILD_KEY, *[F.round(n, DP).alias(n) if n != "mother_age_group" else F.col(n)
                                  for n in FEATURE_NAMES])


@register("mother_age_group_by_age", ids=("FEA10", "SCL1"), sql="""
SELECT o_custkey, CAST(15 + o_custkey % 40 - 3 AS DOUBLE) AS age,
       CAST(LEAST(7, GREATEST(1, floor((CAST(15 + o_custkey % 40 - 3 AS DOUBLE) - 15.0) / 5.0) + 1)) AS INTEGER) AS age_group
FROM (SELECT DISTINCT o_custkey FROM orders)
""")
def q_age_group(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey").distinct()
    o = o.withColumn("age", F.expr("CAST(15 + o_custkey % 40 - 3 AS DOUBLE)"))
    return o.withColumn("age_group", age_group(F.col("age")))


# ------------------------------------------------------------------ splits
def _split_sql(table_sql, label, key_cols, test=0.2, seed=42):
    u = sql_uniform(seed, key_cols)
    keys = ", ".join(key_cols)
    return f"""
WITH t AS ({table_sql}),
r AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {u}, {keys}) AS rk,
             count(*) OVER (PARTITION BY {label}) AS n_c FROM t)
SELECT {keys}, {label}, CASE WHEN rk <= floor(n_c * {test} + 0.5) THEN 'test' ELSE 'train' END AS split FROM r"""


@register("stratified_split_labels", ids=("SPL1",), sql=_split_sql("SELECT doc_id, toxic FROM labels", "toxic", ["doc_id"]))
def q_split(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "toxic")
    return stratified_split(lab, "toxic", "doc_id", test=0.2, seed=42)


@register("prevalence_by_split", ids=("AGG7", "SPL1"), sql=f"""
WITH s AS ({_split_sql("SELECT doc_id, toxic FROM labels", "toxic", ["doc_id"])})
SELECT split, round(avg(toxic) * 100.0, {DP}) AS prevalence_pct, sum(toxic)::BIGINT AS positives,
       sum(1 - toxic)::BIGINT AS negatives, count(*)::BIGINT AS n FROM s GROUP BY split
""")
def q_prev_split(spark, sf):
    lab = stratified_split(table(spark, sf, "labels").select("doc_id", "toxic"), "toxic", "doc_id")
    return stats.prevalence(lab, "toxic", by="split", dp=DP)


@register("stratified_folds_lineitem", ids=("SPL2",), sql=f"""
WITH t AS (SELECT {KEYS}, CAST(l_returnflag = 'R' AS INTEGER) AS label FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {sql_uniform(7, CHILD_KEY)}, {KEYS}) AS rk FROM t)
SELECT {KEYS}, label, CAST((rk - 1) % 5 AS INTEGER) AS fold FROM r
""")
def q_folds(spark, sf):
    li = table(spark, sf, "lineitem").select(*CHILD_KEY, (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return stratified_folds(li, "label", CHILD_KEY, k=5, seed=7)


@register("repeated_folds_labels", ids=("SPL3",), sql=f"""
WITH t AS (SELECT doc_id, quality, r AS repeat FROM labels, range(3) AS rr(r)),
x AS (SELECT *, row_number() OVER (PARTITION BY repeat, quality ORDER BY
        (('0x' || substr(md5('11:' || CAST(repeat AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0),
        doc_id) AS rk FROM t)
SELECT doc_id, quality, CAST(repeat AS INTEGER) AS repeat, CAST((rk - 1) % 5 AS INTEGER) AS fold FROM x
""")
def q_rep(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return repeated_folds(lab, "quality", "doc_id", k=5, repeats=3, seed=11)


@register("class_weights_labels", ids=("IMB1",), sql=f"""
WITH c AS (SELECT toxic, count(*) AS nc FROM labels GROUP BY toxic)
SELECT l.toxic, l.doc_id, round((SELECT count(*) FROM labels) * 1.0 / ((SELECT count(*) FROM c) * c.nc), {DP}) AS weight
FROM labels l JOIN c ON l.toxic = c.toxic
""")
def q_weights(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "toxic")
    w = class_weights(lab, "toxic")
    return w.select("toxic", "doc_id", F.round("weight", DP).alias("weight"))


# ------------------------------------------------------------------ fitted on train, applied to test
@register("median_imputer_train_test", ids=("IMP5", "SPL1"), sql=f"""
{SURVEY_SIZE_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY stunting_label ORDER BY {sql_uniform(42, CHILD_KEY)}, {KEYS}) AS rk,
             count(*) OVER (PARTITION BY stunting_label) AS n_c FROM ss),
s AS (SELECT *, CASE WHEN rk <= floor(n_c * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split FROM r),
m AS (SELECT median(hh_size) AS mh, median(mother_bmi) AS mb FROM s WHERE split = 'train')
SELECT {KEYS}, round(coalesce(CAST(hh_size AS DOUBLE), (SELECT mh FROM m)), {DP}) AS hh_size,
       round(coalesce(mother_bmi, (SELECT mb FROM m)), {DP}) AS mother_bmi FROM s WHERE split = 'test'
""")
def q_imputer(spark, sf):
    from surveylab.operators.impute import MedianImputer
    df = stratified_split(_survey_with_size(spark, sf), "stunting_label", CHILD_KEY, test=0.2, seed=42)
    train, test = df.filter(F.col("split") == "train"), df.filter(F.col("split") == "test")
    m = MedianImputer(inputCols=["hh_size", "mother_bmi"]).fit(train)
    out = m.transform(test)
    return out.select(*CHILD_KEY, F.round("hh_size", DP).alias("hh_size"), F.round("mother_bmi", DP).alias("mother_bmi"))


@register("column_diff_lineitem_orders", ids=("PRJ6", "PRJ3"), sql="""
WITH a AS (SELECT column_name AS c FROM (DESCRIBE lineitem)), b AS (SELECT column_name AS c FROM (DESCRIBE orders))
SELECT c AS column, 'left_only' AS side FROM a WHERE c NOT IN (SELECT c FROM b) AND c NOT LIKE '%key'
UNION ALL SELECT c, 'right_only' FROM b WHERE c NOT IN (SELECT c FROM a) AND c NOT LIKE '%key'
""")
def q_coldiff(spark, sf):
    a, b = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    keep = lambda d: d.select(*[c for c in d.columns if c not in clean.columns_like(d, contains="key")])
    return clean.column_diff(keep(a), keep(b))


@register("mean_std_text_by_flag", ids=("SCL3",), sql="""
SELECT l_returnflag, printf('%.4f ± %.4f', avg(l_discount), stddev_pop(l_discount)) AS discount_text FROM lineitem
GROUP BY l_returnflag
""")
def q_meanstd(spark, sf):
    from surveylab.functions.expr import mean_std_text
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_returnflag").agg(mean_std_text(F.avg("l_discount"), F.stddev_pop("l_discount")).alias("discount_text"))


@register("union_chunks_attach_area", ids=("SET1", "SET3", "SCL4"), sql="""
SELECT c.c_custkey, c.c_acctbal, coalesce(n.n_name, 'unknown') AS n_name
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
""")
def q_union(spark, sf):
    from surveylab.operators.link import attach
    from surveylab.sources.io import union_all
    c = table(spark, sf, "customer")
    chunks = [c.filter(F.col("c_mktsegment") == s).select("c_custkey", "c_acctbal", "c_nationkey")
              for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")]
    rest = c.filter(~F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
                    | F.col("c_mktsegment").isNull()).select("c_custkey", "c_acctbal", "c_nationkey")
    u = union_all(chunks + [rest])
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return attach(u, n, "c_nationkey").select("c_custkey", "c_acctbal",
                                              F.coalesce(F.col("n_name"), F.lit("unknown")).alias("n_name"))
