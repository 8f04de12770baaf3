"""Cohort statistics and ranking (AGG1-AGG16, TOP1-TOP5).

Shape rules used throughout:
* many columns are summarised in **one** aggregate pass (map-side partial
  aggregation, one small final merge), or stacked with ``unpivot`` and
  grouped once, never a job per column;
* totals needed as denominators come from scalar subqueries
  (``DataFrame.scalar()``), evaluated once, never a cross join;
* exact quantiles come from two bounded passes (bracket, then count inside
  the brackets); ``exact=False`` is the one-pass ``percentile_approx`` sketch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveylab.functions.expr import is_missing, nan_to_null, ratio, uniform


def _rows_from_struct_array(one_row: DataFrame, structs: list[Column], alias: str = "r") -> DataFrame:
    return one_row.select(F.explode(F.array(*structs)).alias(alias)).select(f"{alias}.*")


def _maybe_round(c: Column, dp: int | None) -> Column:
    return F.round(c, dp) if dp is not None else c


# ---------------------------------------------------------------- AGG1/AGG2
def missingness_report(df: DataFrame, cols: Sequence[str] | None = None, only_missing: bool = True,
                       dp: int | None = None) -> DataFrame:
    """AGG1: per column NULL count and percent, descending.

    One aggregate pass over the table, then the one-row result is turned
    into rows. Ties are ordered by column name.
    """
    cols = list(cols) if cols is not None else df.columns
    agg = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.sum(is_missing(df, c).cast("long")).alias(f"m{i}") for i, c in enumerate(cols)])
    rows = _rows_from_struct_array(agg, [
        F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_count"),
                 _maybe_round(ratio(F.col(f"m{i}") * 100.0, F.col("__n")), dp).alias("missing_pct"))
        for i, c in enumerate(cols)])
    if only_missing:
        rows = rows.filter(F.col("missing_count") > 0)
    return rows.orderBy(F.desc("missing_pct"), F.asc("column"))


def null_total(df: DataFrame) -> DataFrame:
    """AGG2: total NULL cells left in the table (one row)."""
    total = F.lit(0).cast("long")
    for c in df.columns:
        total = total + F.sum(is_missing(df, c).cast("long"))
    return df.agg(total.alias("null_total"))


# ---------------------------------------------------------------- AGG3-AGG7
def value_counts(df: DataFrame, col: str, dropna: bool = False) -> DataFrame:
    """AGG3: frequency table sorted by value (NULL last unless dropped)."""
    src = df.filter(F.col(col).isNotNull()) if dropna else df
    return (src.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.asc_nulls_last(col)))


def value_shares(df: DataFrame, col: str, dp: int | None = None) -> DataFrame:
    """AGG4: percent of non-null rows per value; the denominator is a scalar subquery."""
    nn = df.filter(F.col(col).isNotNull())
    total = nn.select(F.count(F.lit(1))).scalar()
    return (nn.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .withColumn("share_pct", _maybe_round(ratio(F.col("count") * 100.0, total), dp))
            .orderBy(F.desc("count"), F.asc(col)))


def rate_by(df: DataFrame, group: str | Sequence[str], label: str, dp: int | None = None,
            extra: Sequence[Column] = ()) -> DataFrame:
    """AGG5: mean of a 0/1 label per group, as a percentage, with group size.

    ``extra`` aggregates ride along in the same aggregation (one shuffle).
    """
    g = [group] if isinstance(group, str) else list(group)
    return (df.groupBy(*g).agg(
        _maybe_round(F.avg(F.col(label).cast("double")) * 100.0, dp).alias("rate_pct"),
        F.count(F.lit(1)).alias("n"), *extra)
        .orderBy(*g))


def rates_by_each(df: DataFrame, groups: Sequence[str], label: str, dp: int | None = None) -> DataFrame:
    """AGG6: label rate by each of many grouping columns in a single shuffle.

    The grouping columns are stacked to (variable, value) with ``unpivot``
    and grouped once instead of one job per column.
    """
    stacked = (df.select(F.col(label).cast("double").alias("__y"),
                         *[F.col(g).cast("string").alias(g) for g in groups])
               .unpivot(["__y"], list(groups), "variable", "value"))
    return (stacked.groupBy("variable", "value").agg(
        _maybe_round(F.avg("__y") * 100.0, dp).alias("rate_pct"),
        F.count(F.lit(1)).alias("n"))
        .orderBy("variable", F.asc_nulls_last("value")))


def prevalence(df: DataFrame, label: str, by: str | Sequence[str] | None = None,
               dp: int | None = None) -> DataFrame:
    """AGG7: overall (or per split) prevalence with positive/negative counts."""
    y = F.col(label).cast("double")
    aggs = [_maybe_round(F.avg(y) * 100.0, dp).alias("prevalence_pct"),
            F.sum(F.when(y == 1, 1).otherwise(0)).cast("long").alias("positives"),
            F.sum(F.when(y == 0, 1).otherwise(0)).cast("long").alias("negatives"),
            F.count(F.lit(1)).alias("n")]
    if by is None:
        return df.agg(*aggs)
    g = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*g).agg(*aggs).orderBy(*g)


# ---------------------------------------------------------------- AGG8
def describe_numeric(df: DataFrame, cols: Sequence[str], exact: bool = True,
                     accuracy: int = 10000, dp: int | None = None) -> DataFrame:
    """AGG8: count, mean, sample std, min, quartiles, max for each column.

    Columns are stacked and grouped once. Exact quartiles interpolate
    linearly (as pandas ``describe``) and come from distributed selection.
    """
    from surveylab.operators.quantiles import column_quantiles
    stacked = (df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in cols])
               .unpivot([], list(cols), "variable", "value"))
    probs = [0.25, 0.5, 0.75]
    r = lambda c: _maybe_round(c, dp)
    aggs = [F.count("value").alias("count"), r(F.avg("value")).alias("mean"), r(F.stddev_samp("value")).alias("std"),
            F.min("value").alias("min"), F.max("value").alias("max")]
    if exact:
        # two bounded passes; only the brackets (a row per column) are computed while the plan is built
        out = stacked.groupBy("variable").agg(*aggs).join(
            column_quantiles(df, cols, probs).select("variable", "q"), "variable", "left")
    else:
        out = stacked.groupBy("variable").agg(*aggs, F.percentile_approx(F.col("value"), probs, accuracy).alias("q"))
    return (out.select("variable", "count", "mean", "std", "min", r(F.col("q")[0]).alias("q25"),
                       r(F.col("q")[1]).alias("q50"), r(F.col("q")[2]).alias("q75"), "max")
            .orderBy("variable"))


# ---------------------------------------------------------------- AGG9
def group_size_histogram(df: DataFrame, keys: Sequence[str], dp: int | None = None) -> DataFrame:
    """AGG9: rows per group, then groups per size, with percent of groups."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"))
    n_groups = sizes.select(F.count(F.lit(1))).scalar()
    return (sizes.groupBy("group_size").agg(F.count(F.lit(1)).alias("n_groups"))
            .withColumn("pct_groups", _maybe_round(ratio(F.col("n_groups") * 100.0, n_groups), dp))
            .orderBy("group_size"))


def multi_member_share(df: DataFrame, keys: Sequence[str], dp: int | None = None) -> DataFrame:
    """AGG9: share (percent) of groups with more than one row."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.sum((F.col("group_size") > 1).cast("long")).alias("n_multi"),
        _maybe_round(F.avg((F.col("group_size") > 1).cast("double")) * 100.0, dp).alias("pct_multi"))


# ---------------------------------------------------------------- AGG10/11
def _pair_corr(a: str, b: str) -> Column:
    """Pairwise-complete Pearson r; NULL (not an error) for a constant column."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    xa = F.when(both, F.col(a).cast("double"))
    xb = F.when(both, F.col(b).cast("double"))
    den = F.stddev_pop(xa) * F.stddev_pop(xb)
    return F.try_divide(F.covar_pop(xa, xb), F.when(den > 0, den))


#: A variance below this share of the mean square is rounding: the column counts as constant.
_FLAT = 1e-12


def pair_moments(df: DataFrame, cols: Sequence[str]):
    """(n, sx, sxx, sxy): k x k arrays over the rows where both columns of a pair have a value, from one Gram matrix.

    Each row becomes a vector of three blocks (values, 0 where missing; whether
    there is a value; squares), whose sum of outer products has all counts, sums
    and products of pairs. The state of that aggregate has a fixed size of
    (3k)^2 / 2 numbers whatever the rows. ``n[i, j]`` counts the pair,
    ``sx[i, j]`` and ``sxx[i, j]`` sum column i and its square in it. Values are
    taken from the column's least value (one aggregate before), so that sums
    stay close to the spread of the data.
    """
    import numpy as np
    from pyspark.ml.feature import VectorAssembler
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    k = len(cols)
    src = df.select(*[nan_to_null(F.col(f"`{c}`").cast("double")).alias(f"x{i}") for i, c in enumerate(cols)])
    least = src.agg(F.count(F.lit(1)).alias("n"), *[F.min(f"x{i}").alias(f"x{i}") for i in range(k)]).first()
    if not least["n"]:
        return (np.zeros((k, k)),) * 4
    moved = [F.coalesce(F.col(f"x{i}") - F.lit(least[f"x{i}"] or 0.0), F.lit(0.0)) for i in range(k)]
    blocks = src.select(*[m.alias(f"v{i}") for i, m in enumerate(moved)],
                        *[F.col(f"x{i}").isNotNull().cast("double").alias(f"m{i}") for i in range(k)],
                        *[(m * m).alias(f"s{i}") for i, m in enumerate(moved)])
    rows = VectorAssembler(inputCols=blocks.columns, outputCol="row").transform(blocks).select("row")
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "row")).computeGramianMatrix().toArray()
    value, mask, square = slice(0, k), slice(k, 2 * k), slice(2 * k, 3 * k)
    return gram[mask, mask], gram[value, mask], gram[square, mask], gram[value, value]


def correlation_matrix(df: DataFrame, cols: Sequence[str], dp: int | None = None) -> DataFrame:
    """AGG10: long Pearson matrix (a, b, r), pairwise-complete.

    Two passes at any number of columns (:func:`pair_moments`); the diagonal is
    r(a, a). NULL where a column is constant, or has no value, in the pair's rows.
    """
    import math

    cols = list(cols)
    n, sx, sxx, sxy = pair_moments(df, cols)
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            va, vb = n[i, j] * sxx[i, j] - sx[i, j] ** 2, n[i, j] * sxx[j, i] - sx[j, i] ** 2
            flat = va <= _FLAT * n[i, j] * sxx[i, j] or vb <= _FLAT * n[i, j] * sxx[j, i]
            r = None if flat else (n[i, j] * sxy[i, j] - sx[i, j] * sx[j, i]) / (math.sqrt(va) * math.sqrt(vb))
            rows.append((a, b, None if r is None else float(max(-1.0, min(1.0, r)))))
    out = df.sparkSession.createDataFrame(rows, "a string, b string, r double")
    return out.withColumn("r", _maybe_round(F.col("r"), dp)).orderBy("a", "b")


def correlation_with(df: DataFrame, target: str, cols: Sequence[str], dp: int | None = None) -> DataFrame:
    """AGG11: r of each column with a target, ascending (NULL last)."""
    cols = [c for c in cols if c != target]
    src = df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in cols + [target]])
    agg = src.agg(*[_maybe_round(_pair_corr(c, target), dp).alias(f"r{i}") for i, c in enumerate(cols)])
    return (_rows_from_struct_array(agg, [F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("r"))
                                          for i, c in enumerate(cols)])
            .orderBy(F.asc_nulls_last("r"), "feature"))


# ---------------------------------------------------------------- AGG12/13
def histogram(df: DataFrame, col: str, bins: int = 40, dp: int | None = None) -> DataFrame:
    """AGG12: equal-width bins over [min, max], last bin closed on the right.

    min/max are scalar subqueries; empty bins are not emitted.
    """
    x = nan_to_null(F.col(col).cast("double"))
    src = df.select(x.alias("x")).filter(F.col("x").isNotNull())
    lo_raw = src.select(F.min("x")).scalar()
    hi_raw = src.select(F.max("x")).scalar()
    # numpy widens a zero-width range to [v-0.5, v+0.5]
    lo = F.when(lo_raw == hi_raw, lo_raw - 0.5).otherwise(lo_raw)
    hi = F.when(lo_raw == hi_raw, hi_raw + 0.5).otherwise(hi_raw)
    width = (hi - lo) / F.lit(float(bins))
    b = F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1)).cast("int")
    return (src.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
            .select("bin", _maybe_round(lo + F.col("bin") * width, dp).alias("bin_lo"),
                    _maybe_round(lo + (F.col("bin") + 1) * width, dp).alias("bin_hi"), "count")
            .orderBy("bin"))


def boxplot_stats(df: DataFrame, value: str, group: str, exact: bool = True,
                  accuracy: int = 10000, dp: int | None = None) -> DataFrame:
    """AGG13: quartiles, 1.5·IQR whiskers and outlier count per group (NULL group excluded).

    Quartiles of any number of groups come from two bounded passes
    (:mod:`surveylab.operators.quantiles`); the fences, a row per group, are
    kept and joined back to find whisker ends and outliers (few groups are sent
    to the rows, which stay where they are).
    """
    from surveylab.operators.quantiles import quantiles_by
    from surveylab.session import kept
    v = nan_to_null(F.col(value).cast("double"))
    src = df.select(F.col(group), v.alias("v")).filter(F.col("v").isNotNull() & F.col(group).isNotNull())
    probs = [0.25, 0.5, 0.75]
    if exact:
        st = quantiles_by(src, [group], "v", probs)
    else:
        st = src.groupBy(group).agg(F.percentile_approx("v", probs, accuracy).alias("q"), F.count(F.lit(1)).alias("n"))
    st = st.select(group, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    st = st.withColumn("lo_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
           .withColumn("hi_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    st = kept(st)
    j = src.join(st.select(group, "lo_fence", "hi_fence"), on=group, how="inner")
    w = j.groupBy(group).agg(
        F.min(F.when(F.col("v") >= F.col("lo_fence"), F.col("v"))).alias("whisker_lo"),
        F.max(F.when(F.col("v") <= F.col("hi_fence"), F.col("v"))).alias("whisker_hi"),
        F.sum(((F.col("v") < F.col("lo_fence")) | (F.col("v") > F.col("hi_fence"))).cast("long")).alias("n_outliers"))
    r = lambda c: _maybe_round(F.col(c), dp).alias(c)
    return (st.join(w, on=group, how="inner")
            .select(group, "n", r("q1"), r("median"), r("q3"), r("whisker_lo"), r("whisker_hi"), "n_outliers")
            .orderBy(group))


# ---------------------------------------------------------------- AGG14-16
def column_sums(df: DataFrame, cols: Sequence[str], min_sum: float = 20,
                bottom: int | None = None) -> DataFrame:
    """AGG14: column sums ascending with a sparse flag (sum < ``min_sum``).

    One aggregate pass; ``bottom`` keeps the n smallest (a top-n report).
    """
    agg = df.agg(*[F.sum(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)])
    out = (_rows_from_struct_array(agg, [F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("col_sum"))
                                         for i, c in enumerate(cols)])
           .withColumn("is_sparse", F.coalesce(F.col("col_sum") < F.lit(float(min_sum)), F.lit(True)))
           .orderBy(F.asc_nulls_first("col_sum"), "column"))
    return out.limit(bottom) if bottom is not None else out


def sparse_columns(df: DataFrame, cols: Sequence[str], min_sum: float = 20) -> DataFrame:
    """AGG14: only the columns whose sum is below ``min_sum``."""
    return column_sums(df, cols, min_sum).filter(F.col("is_sparse"))


def class_ratio(df: DataFrame, label: str, dp: int = 2) -> DataFrame:
    """AGG15: negatives ÷ positives (the boosters' positive-class weight)."""
    y = F.col(label)
    pos = F.sum(F.when(y == 1, 1).otherwise(0))
    neg = F.sum(F.when(y == 0, 1).otherwise(0))
    return df.agg(pos.cast("long").alias("positives"), neg.cast("long").alias("negatives"),
                  F.round(ratio(neg, pos), dp).alias("class_ratio"))


def fold_summary(metrics: DataFrame, group: str | Sequence[str], cols: Sequence[str],
                 dp: int | None = None) -> DataFrame:
    """AGG16: mean and population std of per-fold metrics, NaN folds skipped."""
    g = [group] if isinstance(group, str) else list(group)
    aggs = []
    for c in cols:
        x = nan_to_null(F.col(c).cast("double"))
        aggs += [_maybe_round(F.avg(x), dp).alias(f"{c}_mean"),
                 _maybe_round(F.stddev_pop(x), dp).alias(f"{c}_std"),
                 F.count(x).alias(f"{c}_folds")]
    return metrics.groupBy(*g).agg(*aggs).orderBy(*g)


# ---------------------------------------------------------------- TOP1-TOP5
def leaderboard(df: DataFrame, metric: str, name_col: str = "model") -> DataFrame:
    """TOP1: rows by metric descending; NULL/NaN last; ties by name."""
    m = nan_to_null(F.col(metric).cast("double"))
    return (df.withColumn("__m", m)
            .withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("__m"), F.asc(name_col))))
            .drop("__m").orderBy("rank"))


def winner(df: DataFrame, metric: str, name_col: str = "model") -> DataFrame:
    """TOP1: the first leaderboard row (a top-1 report)."""
    m = nan_to_null(F.col(metric).cast("double"))
    return df.orderBy(F.desc_nulls_last(m), F.asc(name_col)).limit(1)


def top_k_per(df: DataFrame, key: str | Sequence[str], by: str, k: int, use_abs: bool = True,
              tie: str | Sequence[str] | None = None, sign: int = 0) -> DataFrame:
    """TOP2: k rows per entity by (absolute) value, ties broken by ``tie``.

    ``sign`` = 1 keeps only positive values, -1 only negative ones. The rank
    filter makes Spark cut every entity to k rows per task before the shuffle
    (WindowGroupLimit), so a hot entity never meets whole in one task. Rows with
    a NULL key form an entity of their own.
    """
    keys = [key] if isinstance(key, str) else list(key)
    ties = [] if tie is None else ([tie] if isinstance(tie, str) else list(tie))
    v = F.col(by)
    src = df
    if sign > 0:
        src = src.filter(v > 0)
    elif sign < 0:
        src = src.filter(v < 0)
    w = Window.partitionBy(*keys).orderBy(F.desc(F.abs(v) if use_abs else v), *[F.asc(t) for t in ties])
    return src.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_n(df: DataFrame, by: str, n: int, ascending: bool = False,
          tie: str | Sequence[str] | None = None) -> DataFrame:
    """TOP3: global top/bottom n (TakeOrderedAndProject: partial top-n per task)."""
    ties = [] if tie is None else ([tie] if isinstance(tie, str) else list(tie))
    o = F.asc_nulls_last(by) if ascending else F.desc_nulls_last(by)
    return df.orderBy(o, *[F.asc(t) for t in ties]).limit(n)


def first_match(df: DataFrame, preferred: Column, fallback: Column, order: str | Sequence[str]) -> DataFrame:
    """TOP4: first row meeting ``preferred``, else first meeting ``fallback``."""
    o = [order] if isinstance(order, str) else list(order)
    pri = F.when(F.coalesce(preferred, F.lit(False)), 0).when(F.coalesce(fallback, F.lit(False)), 1)
    return (df.withColumn("__p", pri).filter(F.col("__p").isNotNull())
            .orderBy("__p", *o).limit(1).drop("__p"))


def sample_n(df: DataFrame, n: int, seed: int, key: str | Sequence[str]) -> DataFrame:
    """TOP5: seeded sample of min(n, N) rows, stable under repartitioning.

    Rows are ranked by md5(seed:key); the first n are kept (partial top-n in
    every task, no full sort).
    """
    keys = [key] if isinstance(key, str) else list(key)
    return (df.withColumn("__u", uniform(seed, *keys))
            .orderBy("__u", *keys).limit(n).drop("__u"))
