"""Registered queries: sources, linkage, cleaning, statistics, ranking.

Each query runs over whole tables. Doubles that different engines may
accumulate in a different order are rounded (6 dp) on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from surveylab.operators import clean, link, stats
from surveylab.operators.impute import imputation_plan, apply_plan
from surveylab.plans.linked import SQL_LABEL, linked_frame, linked_sql, with_label
from surveylab.plans.registry import register
from surveylab.plans.tables import CHILD_KEY, SENTINELS, household_key, sql_uniform, table
from surveylab.sources import io

DP = 6
LINKED = f"WITH linked AS ({linked_sql()})"
RAW_LINKED = f"WITH linked AS ({linked_sql(sentinels=False)})"


# ------------------------------------------------------------------ flagship
def flagship(spark, sf):
    """§7.2 minimum slice: scan, link, sentinels, drop required, median impute,
    label, rate by group."""
    df = linked_frame(spark, sf)
    df = clean.drop_missing(df, ["l_quantity"])
    plan = imputation_plan(df, continuous=["c_acctbal"])
    df = with_label(apply_plan(df, plan))
    return stats.rate_by(df, "c_mktsegment", "label", dp=DP,
                         extra=[F.round(F.avg("c_acctbal"), 4).alias("mean_acctbal")])


register("link_rate_by_segment", ids=("SRC1", "JN1", "JN2", "CLN1", "FLT3", "IMP1", "ENC7", "AGG5"), sql=f"""
{LINKED}, kept AS (SELECT * FROM linked WHERE l_quantity IS NOT NULL),
med AS (SELECT median(c_acctbal) AS m FROM kept),
imp AS (SELECT kept.*, coalesce(c_acctbal, (SELECT m FROM med)) AS acct, {SQL_LABEL} AS label FROM kept)
SELECT c_mktsegment, round(avg(label) * 100.0, {DP}) AS rate_pct, count(*)::BIGINT AS n,
       round(avg(acct), 4) AS mean_acctbal
FROM imp GROUP BY c_mktsegment ORDER BY c_mktsegment
""")(flagship)


# ------------------------------------------------------------------ sources
@register("scan_filtered_area", ids=("SRC1", "SRC2", "FLT1"), sql="""
SELECT c_custkey, c_name, c_acctbal, c_nationkey FROM customer WHERE c_nationkey = 7
""")
def q_scan_filtered(spark, sf):
    return io.scan_filtered(spark, f"{sf}/customer.parquet", cols=["c_custkey", "c_name", "c_acctbal"],
                            filter_col="c_nationkey", filter_val=7)


@register("codebook_lineitem", ids=("SRC4",), sql="""
SELECT d.column_name AS variable, '' AS label,
       CASE d.column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
            WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(d.column_type) END AS data_type
FROM (DESCRIBE lineitem) d
""")
def q_codebook(spark, sf):
    return io.codebook(table(spark, sf, "lineitem"))


@register("value_labels_priority", ids=("SRC5",), sql="""
WITH d AS (SELECT DISTINCT 'o_orderpriority' AS variable,
                  CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS code, o_orderpriority AS label FROM orders)
SELECT code, label FROM d WHERE variable = 'o_orderpriority' AND contains(lower(label), 'specified') ORDER BY code
""")
def q_value_labels(spark, sf):
    o = table(spark, sf, "orders")
    d = o.select(F.lit("o_orderpriority").alias("variable"),
                 F.substring("o_orderpriority", 1, 1).cast("int").alias("code"),
                 F.col("o_orderpriority").alias("label")).distinct()
    return io.value_labels(d, "o_orderpriority", contains="Specified")


@register("rename_by_dictionary", ids=("SRC6", "PRJ1"), sql="""
SELECT n_nationkey AS area_code, n_name AS area_name FROM nation
""")
def q_rename(spark, sf):
    n = table(spark, sf, "nation")
    d = spark.createDataFrame([("n_nationkey", "area_code"), ("n_name", "area_name"), ("zz", "unused")],
                              "variable_code string, feature_name string")
    return clean.feature_columns(io.rename_by_dictionary(n, d), ["n_regionkey"])


# ------------------------------------------------------------------ linkage
@register("link_audit", ids=("JN4", "SET2"), sql=f"""
{RAW_LINKED}
SELECT 'child' AS stage, 0 AS step, (SELECT count(*) FROM lineitem)::BIGINT AS rows
UNION ALL SELECT 'mother', 1, (SELECT count(*) FROM orders)::BIGINT
UNION ALL SELECT 'household', 2, (SELECT count(*) FROM customer)::BIGINT
UNION ALL SELECT 'child_mother', 3, (SELECT count(*) FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)::BIGINT
UNION ALL SELECT 'linked', 4, (SELECT count(*) FROM linked)::BIGINT
""")
def q_link_audit(spark, sf):
    audit = link.LinkAudit()
    li = audit.watch("child", table(spark, sf, "lineitem").select("l_orderkey"))
    o = audit.watch("mother", table(spark, sf, "orders").select("o_orderkey", "o_custkey"))
    c = audit.watch("household", table(spark, sf, "customer").select("c_custkey"))
    both = audit.watch("child_mother", link.link_records(li, o, [("l_orderkey", "o_orderkey")]))
    linked = audit.watch("linked", link.link_records(
        household_key(both, "o_custkey", "hh"), household_key(c, "c_custkey", "c"),
        [("hh_cluster", "c_cluster"), ("hh_number", "c_number")]))
    return audit.rows(linked)


@register("duplicate_keys_orders_per_customer", ids=("JN4",), sql="""
SELECT o_custkey, count(*)::BIGINT AS n_rows FROM orders GROUP BY o_custkey HAVING count(*) > 1
""")
def q_dup(spark, sf):
    return link.duplicate_keys(table(spark, sf, "orders"), ["o_custkey"])


@register("enrich_lineitem_supplier", ids=("JN3",), sql="""
WITH r AS (SELECT s_nationkey AS nk, min(struct_pack(s_acctbal := s_acctbal, s_name := s_name)) AS best,
                  count(*)::BIGINT AS match_count FROM supplier GROUP BY s_nationkey)
SELECT c.c_custkey, c.c_nationkey, r.best.s_acctbal AS s_acctbal, r.best.s_name AS s_name, r.match_count
FROM customer c LEFT JOIN r ON c.c_nationkey = r.nk
""")
def q_enrich(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, sf, "supplier")
    return link.enrich(c, s, [("c_nationkey", "s_nationkey")], ["s_acctbal", "s_name"])


# ------------------------------------------------------------------ filters / cleaning
@register("out_of_range_price", ids=("FLT2",), sql="""
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
WHERE l_extendedprice < 2000 OR l_extendedprice > 90000
""")
def q_oor(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return clean.out_of_range(li, "l_extendedprice", 2000, 90000)


@register("sentinels_and_rescale", ids=("CLN1", "CLN2", "PRJ5"), sql="""
SELECT p_partkey,
       CASE WHEN p_size BETWEEN 41 AND 50 THEN NULL ELSE p_size END AS p_size,
       p_retailprice / 100.0 AS retail_hundreds,
       CAST(0.0 AS DOUBLE) AS absent_feature
FROM part
""")
def q_sentinels(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    p = clean.null_sentinels(p, {"p_size": SENTINELS["p_size"], "not_there": (0, 1)})
    p = clean.rescale(p, {"p_retailprice": (100, "retail_hundreds")})
    out = p.select("p_partkey", "p_size", "retail_hundreds")
    from surveylab.functions.expr import col_or
    return out.withColumn("absent_feature", col_or(out, "absent_feature", 0.0).cast("double"))


@register("drop_sparse_columns", ids=("FLT4", "PRJ2"), sql=f"""
{LINKED}
SELECT l_orderkey, l_linenumber, l_quantity, c_acctbal FROM linked
""")
def q_drop_sparse(spark, sf):
    df = linked_frame(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "c_acctbal")
    # p_size-like share would be dropped; here both shares are below 0.40 and a
    # synthetic all-null column is dropped
    df = df.withColumn("always_null", F.lit(None).cast("double"))
    return clean.drop_sparse_columns(df, 0.40)


# ------------------------------------------------------------------ statistics
@register("missingness_report", ids=("AGG1", "CLN1"), sql=f"""
WITH p AS (SELECT p_partkey, p_name, CASE WHEN p_size BETWEEN 41 AND 50 THEN NULL ELSE p_size END AS p_size,
                  p_retailprice FROM part),
{LINKED[5:]},
j AS (SELECT linked.*, p.p_size FROM linked JOIN p ON linked.l_partkey = p.p_partkey),
c AS (SELECT count(*) AS n, count(*) - count(l_quantity) AS q, count(*) - count(c_acctbal) AS a,
             count(*) - count(p_size) AS s FROM j)
SELECT * FROM (
  SELECT 'l_quantity' AS column, q::BIGINT AS missing_count, round(q * 100.0 / n, 2) AS missing_pct FROM c
  UNION ALL SELECT 'c_acctbal', a::BIGINT, round(a * 100.0 / n, 2) FROM c
  UNION ALL SELECT 'p_size', s::BIGINT, round(s * 100.0 / n, 2) FROM c) WHERE missing_count > 0
""")
def q_missing(spark, sf):
    p = clean.null_sentinels(table(spark, sf, "part").select("p_partkey", "p_size"), SENTINELS)
    j = link.link_records(linked_frame(spark, sf), p, [("l_partkey", "p_partkey")])
    return stats.missingness_report(j.select("l_orderkey", "l_quantity", "c_acctbal", "p_size"), dp=2)


@register("null_total", ids=("AGG2",), sql=f"""
{LINKED}
SELECT (count(*) - count(l_quantity) + count(*) - count(c_acctbal))::BIGINT AS null_total FROM linked
""")
def q_null_total(spark, sf):
    return stats.null_total(linked_frame(spark, sf).select("l_orderkey", "l_quantity", "c_acctbal"))


@register("value_counts_size", ids=("AGG3",), sql="""
SELECT CASE WHEN p_size BETWEEN 41 AND 50 THEN NULL ELSE p_size END AS p_size, count(*)::BIGINT AS count
FROM part GROUP BY 1
""")
def q_vc(spark, sf):
    p = clean.null_sentinels(table(spark, sf, "part").select("p_size"), SENTINELS)
    return stats.value_counts(p, "p_size")


@register("value_shares_priority", ids=("AGG4",), sql=f"""
SELECT o_orderpriority, count(*)::BIGINT AS count,
       round(count(*) * 100.0 / (SELECT count(*) FROM orders WHERE o_orderpriority IS NOT NULL), {DP}) AS share_pct
FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1
""")
def q_shares(spark, sf):
    return stats.value_shares(table(spark, sf, "orders"), "o_orderpriority", dp=DP)


@register("rates_by_each", ids=("AGG6",), sql=f"""
{LINKED}, y AS (SELECT *, {SQL_LABEL} AS label FROM linked),
s AS (SELECT 'c_mktsegment' AS variable, c_mktsegment AS value, label FROM y
      UNION ALL SELECT 'o_orderpriority', o_orderpriority, label FROM y
      UNION ALL SELECT 'o_orderstatus', o_orderstatus, label FROM y
      UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR), label FROM y)
SELECT variable, value, round(avg(label) * 100.0, {DP}) AS rate_pct, count(*)::BIGINT AS n
FROM s GROUP BY variable, value
""")
def q_rates_each(spark, sf):
    df = with_label(linked_frame(spark, sf))
    return stats.rates_by_each(df, ["c_mktsegment", "o_orderpriority", "o_orderstatus", "c_nationkey"],
                               "label", dp=DP)


@register("prevalence_overall", ids=("AGG7",), sql=f"""
{LINKED}, y AS (SELECT {SQL_LABEL} AS label FROM linked)
SELECT round(avg(label) * 100.0, {DP}) AS prevalence_pct, sum(label)::BIGINT AS positives,
       sum(1 - label)::BIGINT AS negatives, count(*)::BIGINT AS n FROM y
""")
def q_prev(spark, sf):
    return stats.prevalence(with_label(linked_frame(spark, sf)), "label", dp=DP)


@register("describe_lineitem", ids=("AGG8",), sql=f"""
WITH s AS (SELECT 'l_quantity' AS variable, l_quantity AS value FROM lineitem
           UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem
           UNION ALL SELECT 'l_discount', l_discount FROM lineitem
           UNION ALL SELECT 'l_tax', l_tax FROM lineitem)
SELECT variable, count(value)::BIGINT AS count, round(avg(value), {DP}) AS mean,
       round(stddev_samp(value), {DP}) AS std, min(value) AS min,
       round(quantile_cont(value, 0.25), {DP}) AS q25, round(quantile_cont(value, 0.5), {DP}) AS q50,
       round(quantile_cont(value, 0.75), {DP}) AS q75, max(value) AS max
FROM s GROUP BY variable
""")
def q_describe(spark, sf):
    return stats.describe_numeric(table(spark, sf, "lineitem"),
                                  ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], dp=DP)


@register("children_per_mother_histogram", ids=("AGG9",), sql=f"""
WITH g AS (SELECT l_orderkey, count(*) AS group_size FROM lineitem GROUP BY 1)
SELECT group_size::BIGINT AS group_size, count(*)::BIGINT AS n_groups,
       round(count(*) * 100.0 / (SELECT count(*) FROM g), {DP}) AS pct_groups
FROM g GROUP BY group_size
""")
def q_hist_groups(spark, sf):
    return stats.group_size_histogram(table(spark, sf, "lineitem"), ["l_orderkey"], dp=DP)


@register("households_multi_child_share", ids=("AGG9",), sql=f"""
{LINKED}, g AS (SELECT hh_cluster, hh_number, count(*) AS group_size FROM linked GROUP BY 1, 2)
SELECT count(*)::BIGINT AS n_groups, sum(CASE WHEN group_size > 1 THEN 1 ELSE 0 END)::BIGINT AS n_multi,
       round(avg(CASE WHEN group_size > 1 THEN 1.0 ELSE 0.0 END) * 100.0, {DP}) AS pct_multi FROM g
""")
def q_multi(spark, sf):
    return stats.multi_member_share(linked_frame(spark, sf), ["hh_cluster", "hh_number"], dp=DP)


_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "c_acctbal", "const_col"]


def _corr_sql_pair(a, b):
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    xa, xb = f"CASE WHEN {both} THEN {a} END", f"CASE WHEN {both} THEN {b} END"
    return (f"round(covar_pop({xa}, {xb}) / nullif(stddev_pop({xa}) * stddev_pop({xb}), 0), {DP})")


def _corr_matrix_sql():
    sel, rows = [], []
    for i, a in enumerate(_CORR_COLS):
        for j in range(i, len(_CORR_COLS)):
            b = _CORR_COLS[j]
            sel.append(f"{_corr_sql_pair(a, b)} AS r{i}_{j}")
            rows.append(f"SELECT '{a}' AS a, '{b}' AS b, r{i}_{j} AS r FROM agg")
            if i != j:
                rows.append(f"SELECT '{b}', '{a}', r{i}_{j} FROM agg")
    return (f"{LINKED}, src AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, c_acctbal, "
            f"1.0 AS const_col FROM linked), agg AS (SELECT {', '.join(sel)} FROM src)\n"
            + "\nUNION ALL ".join(rows))


@register("correlation_matrix", ids=("AGG10",), sql=_corr_matrix_sql())
def q_corr(spark, sf):
    df = linked_frame(spark, sf).withColumn("const_col", F.lit(1.0))
    return stats.correlation_matrix(df, _CORR_COLS, dp=DP)


@register("correlation_with_label", ids=("AGG11",), sql=f"""
{LINKED}, src AS (SELECT *, {SQL_LABEL} AS label FROM linked)
SELECT 'l_quantity' AS feature, {_corr_sql_pair('l_quantity', 'label')} AS r FROM src
UNION ALL SELECT 'l_discount', {_corr_sql_pair('l_discount', 'label')} FROM src
UNION ALL SELECT 'o_totalprice', {_corr_sql_pair('o_totalprice', 'label')} FROM src
UNION ALL SELECT 'c_acctbal', {_corr_sql_pair('c_acctbal', 'label')} FROM src
""")
def q_corr_with(spark, sf):
    df = with_label(linked_frame(spark, sf))
    return stats.correlation_with(df, "label", ["l_quantity", "l_discount", "o_totalprice", "c_acctbal"], dp=DP)


@register("histogram_totalprice", ids=("AGG12",), sql=f"""
WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
x AS (SELECT LEAST(CAST(floor((o_totalprice - lo) / ((hi - lo) / 40.0)) AS INTEGER), 39) AS bin, lo, hi
      FROM orders, b WHERE o_totalprice IS NOT NULL)
SELECT bin, round(lo + bin * ((hi - lo) / 40.0), 4) AS bin_lo, round(lo + (bin + 1) * ((hi - lo) / 40.0), 4) AS bin_hi,
       count(*)::BIGINT AS count FROM x GROUP BY bin, lo, hi
""")
def q_histogram(spark, sf):
    return stats.histogram(table(spark, sf, "orders"), "o_totalprice", bins=40, dp=4)


@register("boxplot_price_by_flag", ids=("AGG13",), sql=f"""
WITH s AS (SELECT l_returnflag, l_extendedprice AS v FROM lineitem WHERE l_extendedprice IS NOT NULL),
q AS (SELECT l_returnflag, count(*)::BIGINT AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
             quantile_cont(v, 0.75) AS q3 FROM s GROUP BY 1),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo_f, q3 + 1.5 * (q3 - q1) AS hi_f FROM q)
SELECT f.l_returnflag, f.n, round(f.q1, {DP}) AS q1, round(f.median, {DP}) AS median, round(f.q3, {DP}) AS q3,
       round(min(CASE WHEN v >= lo_f THEN v END), {DP}) AS whisker_lo,
       round(max(CASE WHEN v <= hi_f THEN v END), {DP}) AS whisker_hi,
       sum(CASE WHEN v < lo_f OR v > hi_f THEN 1 ELSE 0 END)::BIGINT AS n_outliers
FROM s JOIN f ON s.l_returnflag = f.l_returnflag
GROUP BY f.l_returnflag, f.n, f.q1, f.median, f.q3
""")
def q_box(spark, sf):
    return stats.boxplot_stats(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag", dp=DP)


@register("class_ratio_toxic", ids=("AGG15",), sql="""
SELECT sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS positives,
       sum(CASE WHEN toxic = 0 THEN 1 ELSE 0 END)::BIGINT AS negatives,
       round(sum(CASE WHEN toxic = 0 THEN 1 ELSE 0 END) * 1.0 / nullif(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 0), 2)
         AS class_ratio
FROM labels
""")
def q_ratio(spark, sf):
    return stats.class_ratio(table(spark, sf, "labels"), "toxic")


# ------------------------------------------------------------------ ranking
@register("top3_lines_per_order", ids=("TOP2",), sql="""
SELECT * FROM (
  SELECT l_orderkey, l_linenumber, l_extendedprice,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(l_extendedprice) DESC, l_linenumber) AS rank
  FROM lineitem) WHERE rank <= 3
""")
def q_topk(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return stats.top_k_per(li, "l_orderkey", "l_extendedprice", 3, tie="l_linenumber") \
        .withColumn("rank", F.col("rank").cast("bigint"))


@register("top10_customers_by_balance", ids=("TOP3",), sql="""
SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 10
""")
def q_topn(spark, sf):
    return stats.top_n(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"),
                       "c_acctbal", 10, tie="c_custkey")


@register("first_match_order", ids=("TOP4",), sql="""
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
WHERE (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') OR o_orderstatus = 'F'
ORDER BY CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, o_orderkey LIMIT 1
""")
def q_first(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return stats.first_match(o, (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT"),
                             F.col("o_orderstatus") == "F", "o_orderkey")


@register("sample_50_lines", ids=("TOP5",), sql=f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
ORDER BY {sql_uniform(42, CHILD_KEY)}, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 50
""")
def q_sample(spark, sf):
    li = table(spark, sf, "lineitem").select(*CHILD_KEY, "l_extendedprice")
    return stats.sample_n(li, 50, 42, CHILD_KEY)
