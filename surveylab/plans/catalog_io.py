"""Registered queries that write, read back and check: sinks, saved models, rankings, gates, closed-form attribution."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from surveylab.operators import stats
from surveylab.operators.attribution import attribute
from surveylab.operators.clean import align_columns
from surveylab.operators.impute import MedianImputer
from surveylab.operators.modeling import quality_gate
from surveylab.operators.sampling import stratified_split
from surveylab.operators.scoring import LinearScorer
from surveylab.plans.registry import register
from surveylab.plans.tables import sql_uniform, table
from surveylab.session import checkpoint_dir
from surveylab.sources.io import (feature_list, load_model, read_table, require_columns, save_model, write_run_metadata,
                                  write_split, write_table)

DP = 6


def _scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("csv_round_trip_orders", ids=("SNK1", "SRC2", "SRC3"), sql="""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders
""")
def q_csv(spark, sf):
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    df = require_columns(table(spark, sf, "orders"), cols, "orders").select(*cols)
    path = _scratch(spark, "orders-csv")
    write_table(df, path, fmt="csv")
    return read_table(spark, path, df.schema, fmt="csv")


@register("split_round_trip_labels", ids=("SNK2", "SPL1"), sql=f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {sql_uniform(11, ['doc_id'])}, doc_id) AS rk,
                  count(*) OVER (PARTITION BY quality) AS n_c FROM labels),
s AS (SELECT *, CASE WHEN rk <= floor(n_c * 0.25 + 0.5) THEN 'test' ELSE 'train' END AS split FROM r)
SELECT doc_id, quality, toxic, split FROM s
""")
def q_split(spark, sf):
    df = stratified_split(table(spark, sf, "labels"), "quality", "doc_id", test=0.25, seed=11)
    path = _scratch(spark, "labels-split")
    write_split(df, path)
    return spark.read.parquet(path).select("doc_id", "quality", "toxic", "split")


@register("saved_imputer_customer", ids=("SNK3", "IMP5"), sql=f"""
WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN CAST(c_acctbal AS DOUBLE) END AS balance FROM customer)
SELECT c_custkey, round(coalesce(balance, (SELECT quantile_cont(balance, 0.5) FROM c)), {DP}) AS balance FROM c
""")
def q_saved(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("double"))
                                             .alias("balance"))
    path = _scratch(spark, "imputer")
    save_model(Pipeline(stages=[MedianImputer(inputCols=["balance"])]).fit(df), path)
    return load_model(path).transform(df).select("c_custkey", F.round("balance", DP).alias("balance"))


_METRIC_SQL = """
m AS (SELECT event_type AS model, CAST(user_id % 5 AS BIGINT) AS fold, avg(CAST(value AS DOUBLE)) / 100.0 AS auc,
             count(*) AS n FROM events GROUP BY event_type, user_id % 5)"""


def _metric_rows(spark, sf):
    return (table(spark, sf, "events").groupBy(F.col("event_type").alias("model"), (F.col("user_id") % 5).cast("long").alias("fold"))
            .agg((F.avg(F.col("value").cast("double")) / 100.0).alias("auc"), F.count("*").alias("n")))


@register("run_metadata_round_trip", ids=("SNK4",), sql=f"""
WITH {_METRIC_SQL}
SELECT model, fold, round(auc, {DP}) AS auc, n FROM m
""")
def q_metadata(spark, sf):
    path = _scratch(spark, "metadata")
    write_run_metadata(_metric_rows(spark, sf), path)
    return spark.read.schema("model string, fold long, auc double, n long").json(path).select(
        "model", "fold", F.round("auc", DP).alias("auc"), "n")


_LIST_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_suppkey"]
_RETURNED = "CAST(l_returnflag = 'R' AS DOUBLE)"


@register("feature_list_of_lineitem", ids=("SNK4", "PRJ1"), sql="""
WITH c AS (""" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, round(abs(corr(CAST({c} AS DOUBLE), {_RETURNED})), {DP}) AS r FROM lineitem" for c in _LIST_COLS) + """)
SELECT 'lineitem' AS model, CAST(row_number() OVER (ORDER BY r DESC, feature) - 1 AS BIGINT) AS position, feature
FROM c WHERE r IS NOT NULL
""")
def q_features(spark, sf):
    """The columns in order of their correlation with the returned flag, over the whole table."""
    df = require_columns(table(spark, sf, "lineitem"), _LIST_COLS, "lineitem").select(
        *_LIST_COLS, F.expr(_RETURNED).alias("returned"))
    found = stats.correlation_with(df, "returned", _LIST_COLS, dp=DP).where("r is not null")
    ranked = [r["feature"] for r in found.orderBy(F.abs("r").desc(), "feature").collect()]  # a row for each column
    path = _scratch(spark, "features")
    write_table(feature_list(spark, ranked, "lineitem"), path)
    return spark.read.parquet(path).select("model", F.posexplode("features").alias("position", "feature")).select(
        "model", F.col("position").cast("long").alias("position"), "feature")


@register("fold_summary_events", ids=("AGG16",), sql=f"""
WITH {_METRIC_SQL}
SELECT model, round(avg(auc), {DP}) AS auc_mean, round(stddev_pop(auc), {DP}) AS auc_std, count(auc) AS auc_folds
FROM m GROUP BY model
""")
def q_folds(spark, sf):
    return stats.fold_summary(_metric_rows(spark, sf), "model", ["auc"], dp=DP)


_GATE_SQL = f"""
WITH {_METRIC_SQL},
s AS (SELECT model, round(avg(auc), {DP}) AS auc_mean FROM m GROUP BY model)"""


@register("winner_and_gate_events", ids=("TOP1", "MOD12"), sql=_GATE_SQL + f"""
, mid AS (SELECT round(quantile_cont(auc_mean, 0.5), {DP}) AS c, round(min(auc_mean) + 0.0001, {DP}) AS st FROM s)
SELECT model, auc_mean, CAST(row_number() OVER (ORDER BY auc_mean DESC, model) AS INTEGER) AS rank,
       CASE WHEN auc_mean < st THEN 'STOP' WHEN auc_mean < c THEN 'CAUTION' ELSE 'PASS' END AS gate,
       auc_mean >= c AS attribution_allowed,
       model = (SELECT model FROM s ORDER BY auc_mean DESC, model LIMIT 1) AS is_winner
FROM s, mid
""")
def q_winner(spark, sf):
    s = stats.fold_summary(_metric_rows(spark, sf), "model", ["auc"], dp=DP).select("model", "auc_mean")
    rows = sorted(r.auc_mean for r in s.collect())  # one row per model
    mid = (rows[(len(rows) - 1) // 2] + rows[len(rows) // 2]) / 2
    gated = quality_gate(stats.leaderboard(s, "auc_mean"), "auc_mean", stop=round(rows[0] + 0.0001, DP), caution=round(mid, DP))
    best = stats.winner(s, "auc_mean").first()["model"]
    return gated.select("model", "auc_mean", "rank", "gate", "attribution_allowed", (F.col("model") == best).alias("is_winner"))


@register("aligned_columns_part", ids=("PRJ4",), sql="""
SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, CAST(p_retailprice AS DOUBLE) AS p_retailprice,
       CAST(0.0 AS DOUBLE) AS never_there FROM part
""")
def q_align(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size", F.lit(7).alias("not_wanted"))
    aligned = align_columns(df, ["p_size", "p_retailprice", "never_there"], keep=["p_partkey"])
    return aligned.select("p_partkey", *[F.col(c).cast("double").alias(c) for c in ("p_size", "p_retailprice", "never_there")])


class _Margin:
    """A linear margin as a score: its Shapley values have a closed form."""

    prob_col = "margin"

    def __init__(self, scorer: LinearScorer):
        self.scorer = scorer

    def score(self, df):
        return df.withColumn(self.prob_col, self.scorer.margin(df))


_SHAP_COEFS = {"s_nationkey": 0.7, "s_acctbal": -0.002, "s_digits": 0.3}


@register("attribution_margin_supplier", ids=("EXP1", "EXP8", "EXP2"), sql=f"""
WITH f AS (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS s_nationkey, CAST(s_acctbal AS DOUBLE) AS s_acctbal,
                  CAST(s_suppkey % 10 AS DOUBLE) AS s_digits FROM supplier),
b AS (SELECT avg(s_nationkey) AS s_nationkey, avg(s_acctbal) AS s_acctbal, avg(s_digits) AS s_digits FROM f)
""" + "\nUNION ALL ".join(
    f"SELECT f.s_suppkey, '{c}' AS feature_code, round(f.{c}, {DP}) AS value, round({w} * (f.{c} - b.{c}), 4) AS shap_value FROM f, b"
    for c, w in _SHAP_COEFS.items()))
def q_margin(spark, sf):
    f = table(spark, sf, "supplier").select(
        "s_suppkey", F.col("s_nationkey").cast("double").alias("s_nationkey"), F.col("s_acctbal").cast("double").alias("s_acctbal"),
        (F.col("s_suppkey") % 10).cast("double").alias("s_digits"))
    # The background is the whole table: every row against every row.
    a = attribute(f, "s_suppkey", list(_SHAP_COEFS), _Margin(LinearScorer(_SHAP_COEFS, intercept=0.1)),
                  f, permutations=2)
    return a.select("s_suppkey", "feature_code", F.round("value", DP).alias("value"), F.round("shap_value", 4).alias("shap_value"))
