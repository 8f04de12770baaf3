"""Projections, filters and cleaning (PRJ1-PRJ6, FLT1-FLT4, CLN1-CLN2)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveylab.functions.expr import is_missing

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)


def feature_columns(df: DataFrame, exclude: Iterable[str]) -> DataFrame:
    """PRJ1: drop id/target columns if present."""
    ex = set(exclude)
    return df.select(*[c for c in df.columns if c not in ex])


def columns_by_kind(df: DataFrame, kind: str = "numeric", exclude: Iterable[str] = ()) -> list[str]:
    """PRJ2: column names by type class ('numeric' or 'categorical')."""
    ex = set(exclude)
    out = []
    for f in df.schema.fields:
        if f.name in ex:
            continue
        is_num = isinstance(f.dataType, _NUMERIC)
        if (kind == "numeric") == is_num:
            out.append(f.name)
    return out


def columns_like(df: DataFrame, prefix: str | None = None, contains: str | None = None) -> list[str]:
    """PRJ3: columns by name prefix and/or case-insensitive substring."""
    out = list(df.columns)
    if prefix is not None:
        out = [c for c in out if c.startswith(prefix)]
    if contains is not None:
        out = [c for c in out if contains.lower() in c.lower()]
    return out


def align_columns(df: DataFrame, names: Sequence[str], fill: float = 0.0,
                  keep: Sequence[str] = ()) -> DataFrame:
    """PRJ4: project to an ordered column list; absent columns become ``fill``."""
    cols = [F.col(k) for k in keep]
    for n in names:
        cols.append((F.col(n).cast("double") if n in df.columns else F.lit(fill).cast("double")).alias(n))
    return df.select(*cols)


def column_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """PRJ6: sorted column names present in one table but not the other."""
    sa, sb = set(a.columns), set(b.columns)
    rows = [(c, "left_only") for c in sorted(sa - sb)] + [(c, "right_only") for c in sorted(sb - sa)]
    return a.sparkSession.createDataFrame(rows, "column string, side string")


def filter_equals(df: DataFrame, col: str, value) -> DataFrame:
    """FLT1: equality filter; reaches the Parquet reader as a pushed filter."""
    return df.filter(F.col(col) == F.lit(value))


def out_of_range(df: DataFrame, col: str, lo, hi) -> DataFrame:
    """FLT2: rows whose value lies outside [lo, hi] (NULL is not flagged)."""
    c = F.col(col)
    return df.filter((c < F.lit(lo)) | (c > F.lit(hi)))


def drop_missing(df: DataFrame, required: Sequence[str], obs: Observation | None = None) -> DataFrame:
    """FLT3: drop rows with NULL in any required column.

    With ``obs`` the dropped count is observed in the same pass
    (``obs.get["rows_dropped"]``).
    """
    req = [c for c in required if c in df.columns]
    if obs is not None:
        any_null = F.lit(False)
        for c in req:
            any_null = any_null | F.col(c).isNull()
        df = df.observe(obs, F.count(F.lit(1)).alias("rows_in"),
                        F.sum(any_null.cast("long")).alias("rows_dropped"))
    return df.na.drop(how="any", subset=req) if req else df


def null_shares(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, float]:
    """Null (or NaN) share per column from one aggregate pass (result size = #columns)."""
    cols = list(cols) if cols is not None else df.columns
    if not cols:
        return {}
    row = df.agg(*[F.avg(is_missing(df, c).cast("double")).alias(c) for c in cols]).first()
    return {c: (row[c] if row[c] is not None else 0.0) for c in cols}


def drop_sparse_columns(df: DataFrame, max_null: float = 0.40,
                        cols: Sequence[str] | None = None) -> DataFrame:
    """FLT4: drop columns whose null share is strictly above ``max_null``."""
    shares = null_shares(df, cols)
    drop = [c for c, s in shares.items() if s > max_null]
    return df.drop(*drop) if drop else df


def null_sentinels(df: DataFrame, ranges: Mapping[str, tuple], obs: Observation | None = None) -> DataFrame:
    """CLN1: coded sentinels in closed ranges [lo, hi] -> NULL.

    Absent columns are skipped. With ``obs`` the number replaced per column
    is observed in the same pass as ``replaced_<col>``.
    """
    present = {c: r for c, r in ranges.items() if c in df.columns}
    if not present:
        return df
    if obs is not None:
        df = df.observe(obs, *[
            F.sum(F.coalesce(F.col(c).between(lo, hi), F.lit(False)).cast("long")).alias(f"replaced_{c}")
            for c, (lo, hi) in present.items()])
    return df.withColumns({
        c: F.when(~F.coalesce(F.col(c).between(F.lit(lo), F.lit(hi)), F.lit(False)), F.col(c))
        for c, (lo, hi) in present.items()})


def rescale(df: DataFrame, spec: Mapping[str, tuple]) -> DataFrame:
    """CLN2: divide stored integers by a factor; optionally rename (raw dropped).

    ``spec = {"bmi_raw": (100, "bmi"), "haz": (100, None)}``.
    """
    for c, (factor, new) in spec.items():
        if c not in df.columns:
            continue
        scaled = F.col(c).cast("double") / F.lit(float(factor))
        if new and new != c:
            df = df.withColumn(new, scaled).drop(c)
        else:
            df = df.withColumn(c, scaled)
    return df
