"""The linked child-mother-household table on the driver tables.

Spark side: operators (scan, link_records with a composite key, sentinels).
Oracle side: the same relation as a SQL CTE, so every query built on top
of it can be checked against DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveylab.operators.clean import null_sentinels
from surveylab.operators.link import link_records
from surveylab.session import plan_settings
from surveylab.plans.tables import SENTINELS, household_key, sql_household_key, table

CHILD_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
MOTHER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
HOUSE_COLS = ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"]
LINKED_COLS = CHILD_COLS + ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
                            "hh_cluster", "hh_number", "c_custkey", "c_nationkey", "c_acctbal",
                            "c_mktsegment"]


def linked_frame(spark: SparkSession, sf_dir: str, sentinels: bool = True) -> DataFrame:
    """child ⋈ mother (JN1) ⋈ household on a composite key (JN2), sentinels -> NULL (CLN1)."""
    plan_settings(spark)
    child = table(spark, sf_dir, "lineitem").select(*CHILD_COLS)
    mother = household_key(table(spark, sf_dir, "orders").select(*MOTHER_COLS), "o_custkey", "hh")
    house = household_key(table(spark, sf_dir, "customer").select(*HOUSE_COLS), "c_custkey", "c")
    j = link_records(child, mother, [("l_orderkey", "o_orderkey")])
    j = link_records(j, house, [("hh_cluster", "c_cluster"), ("hh_number", "c_number")])
    j = j.select(*LINKED_COLS)
    return null_sentinels(j, SENTINELS) if sentinels else j


def _sent(col: str, alias: str | None = None) -> str:
    lo, hi = SENTINELS[col]
    return f"CASE WHEN {col} BETWEEN {lo} AND {hi} THEN NULL ELSE {col} END AS {alias or col}"


def linked_sql(sentinels: bool = True) -> str:
    """SQL text of :func:`linked_frame` (a CTE body)."""
    q = (lambda c: _sent(c)) if sentinels else (lambda c: c)
    return f"""
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, {q('l_quantity')}, l.l_extendedprice,
       l.l_discount, l.l_tax, l.l_returnflag, l.l_linestatus,
       o.o_custkey, o.o_orderstatus, o.o_totalprice, o.o_orderpriority,
       o.hh_cluster, o.hh_number, c.c_custkey, c.c_nationkey, {q('c_acctbal')}, c.c_mktsegment
FROM lineitem l
JOIN (SELECT *, {sql_household_key('o_custkey', 'hh')} FROM orders) o ON l.l_orderkey = o.o_orderkey
JOIN (SELECT *, {sql_household_key('c_custkey', 'c')} FROM customer) c
  ON o.hh_cluster = c.c_cluster AND o.hh_number = c.c_number
"""


def with_label(df: DataFrame, out: str = "label") -> DataFrame:
    """Child label used across the catalogue: returned line (flag 'R')."""
    return df.withColumn(out, F.coalesce(F.col("l_returnflag") == F.lit("R"), F.lit(False)).cast("int"))


SQL_LABEL = "CAST(coalesce(l_returnflag = 'R', false) AS INTEGER)"
