"""Imputation (IMP1-IMP7).

Fitted values (null shares, medians, modes) are computed in one aggregate
pass per kind of statistic; the result is a handful of scalars per column,
which is all that reaches the driver. Application is a single ``coalesce``
projection.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveylab.functions.expr import is_missing, nan_to_null
from surveylab.operators.clean import columns_by_kind, null_shares
from surveylab.session import cut_lineage


# ---------------------------------------------------------------- fitted stats
def medians(df: DataFrame, cols: Sequence[str], exact: bool = True, accuracy: int = 100000) -> dict:
    """Median of each column (NULL/NaN skipped), one aggregate pass.

    Exact medians average the two middle values like pandas and are computed
    by :func:`surveylab.operators.quantiles.exact_quantiles` (never a whole
    column in one task); ``exact=False`` uses the ``percentile_approx`` sketch
    in a single pass.
    """
    cols = list(cols)
    if not cols:
        return {}
    if exact:
        from surveylab.operators.quantiles import exact_quantiles
        return {c: v[0] for c, v in exact_quantiles(df, cols, [0.5]).items()}
    row = df.agg(*[F.percentile_approx(nan_to_null(F.col(c).cast("double")), F.lit(0.5), accuracy).alias(f"c{i}")
                   for i, c in enumerate(cols)]).first()
    return {c: row[f"c{i}"] for i, c in enumerate(cols)}


def mode_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Most frequent non-null value per column; ties -> smallest value.

    Columns are stacked (as double for numeric, string otherwise) and counted
    with one (variable, value) aggregation that combines map-side, so a hot
    value never lands whole on one task. Output: one row per column.
    """
    types = {c: df.schema[c].dataType for c in cols}
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    kinds = {"long": [c for c in cols if isinstance(types[c], whole)],
             "double": [c for c in cols if isinstance(types[c], (T.FloatType, T.DoubleType))]}
    kinds |= {t.simpleString(): [c for c in cols if types[c] == t] for t in {
        t for t in types.values() if isinstance(t, T.DecimalType)}}
    kinds["string"] = [c for c in cols if not any(c in g for g in kinds.values())]
    parts = []
    for typ, group in kinds.items():
        if not group:
            continue
        st = (df.select(*[F.col(c).cast(typ).alias(c) for c in group])
              .unpivot([], list(group), "variable", "value")
              .filter(F.col("value").isNotNull()))
        if typ == "double":
            st = st.filter(~F.isnan("value"))
        counts = st.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("cnt"))
        best = counts.groupBy("variable").agg(
            F.min_by(F.col("value"), F.struct(-F.col("cnt"), F.col("value"))).alias("mode"),
            F.max("cnt").alias("mode_count"))
        parts.append(best.select("variable", F.col("mode").cast("string").alias("mode"), "mode_count"))
    if not parts:
        return df.sparkSession.createDataFrame([], "variable string, mode string, mode_count long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def modes(df: DataFrame, cols: Sequence[str]) -> dict:
    """Mode per column as a Python value of the column's type (bounded by #cols)."""
    if not cols:
        return {}
    types = {f.name: f.dataType for f in df.schema.fields}
    out = {}
    for r in mode_table(df, cols).collect():
        v, dt = r["mode"], types[r["variable"]]
        if v is not None and isinstance(dt, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
            v = int(v)
        elif v is not None and isinstance(dt, (T.DoubleType, T.FloatType)):
            v = float(v)
        elif v is not None and isinstance(dt, T.DecimalType):
            v = Decimal(v)
        out[r["variable"]] = v
    return out


# ---------------------------------------------------------------- IMP7 plan
def imputation_plan(df: DataFrame, continuous: Sequence[str] = (), ordinal: Sequence[str] = (),
                    nominal: Sequence[str] = (), binary: Sequence[str] = (),
                    cont_threshold: float = 0.15, ord_threshold: float = 0.10,
                    exact: bool = True) -> list[dict]:
    """IMP7: per column (group, null share, method, fill value).

    The columns concerned are kept once (as Parquet in the shared folder), so
    that the input's own plan (a join, say) runs once; shares, medians and modes
    are passes over the columns they need. Absent columns are skipped; columns without NULLs get method
    'none'.
    """
    groups = {"continuous": continuous, "ordinal": ordinal, "nominal": nominal, "binary": binary}
    present = {g: [c for c in cs if c in df.columns] for g, cs in groups.items()}
    allc = [c for cs in present.values() for c in cs]
    if not allc:
        return []
    df = cut_lineage(df.select(*dict.fromkeys(allc)))
    shares = null_shares(df, allc)
    plan = []
    need_median, need_mode = [], []
    for g, cs in present.items():
        for c in cs:
            s = shares[c]
            if s == 0:
                m = "none"
            elif g == "continuous":
                m = "median" if s <= cont_threshold else "mice"
            elif g == "ordinal":
                m = "missing_category" if s > ord_threshold else "mode"
            else:
                m = "mode"
            plan.append({"column": c, "group": g, "null_share": s, "method": m, "fill_value": None})
            if m == "median":
                need_median.append(c)
            elif m == "mode":
                need_mode.append(c)
    med = medians(df, need_median, exact=exact)
    mod = modes(df, need_mode)
    for p in plan:
        if p["method"] == "median":
            p["fill_value"] = med[p["column"]]
        elif p["method"] == "mode":
            p["fill_value"] = mod[p["column"]]
        elif p["method"] == "missing_category":
            p["fill_value"] = -1
    return plan


def plan_frame(spark, plan: list[dict]) -> DataFrame:
    """IMP7: the plan as a small DataFrame (audit output)."""
    rows = [(p["column"], p["group"], float(p["null_share"]), p["method"],
             None if p["fill_value"] is None else str(p["fill_value"])) for p in plan]
    return spark.createDataFrame(
        rows, "column string, group string, null_share double, method string, fill_value string")


def apply_plan(df: DataFrame, plan: list[dict], mice_rounds: int = 10) -> DataFrame:
    """Apply an imputation plan as one projection (plus MICE if flagged)."""
    exprs = {}
    for p in plan:
        c, m, v = p["column"], p["method"], p["fill_value"]
        if m == "median" and v is not None:
            exprs[c] = F.coalesce(nan_to_null(F.col(c).cast("double")), F.lit(float(v)))
        elif m == "mode" and v is not None:
            exprs[c] = F.when(is_missing(df, c), F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c))
        elif m == "missing_category":
            # a text level stays text; numbers are codes
            typ = "string" if df.schema[c].dataType.typeName() == "string" else "int"
            exprs[c] = F.when(is_missing(df, c), F.lit(-1).cast(typ)).otherwise(F.col(c).cast(typ))
    out = df.withColumns(exprs) if exprs else df
    mice_cols = [p["column"] for p in plan if p["method"] == "mice"]
    if mice_cols:
        out = mice(out, mice_cols, rounds=mice_rounds)
    return out


# ---------------------------------------------------------------- IMP1-IMP3
def impute_continuous(df: DataFrame, cols: Sequence[str], threshold: float = 0.15,
                      rounds: int = 10, exact: bool = True) -> DataFrame:
    """IMP1: share 0 -> untouched; <= threshold -> median; above -> MICE group."""
    return apply_plan(df, imputation_plan(df, continuous=cols, cont_threshold=threshold, exact=exact),
                      mice_rounds=rounds)


def impute_ordinal(df: DataFrame, cols: Sequence[str], threshold: float = 0.10) -> DataFrame:
    """IMP2: share > threshold -> explicit level -1 (int); else the mode."""
    return apply_plan(df, imputation_plan(df, ordinal=cols, ord_threshold=threshold))


def impute_mode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """IMP3: nominal and binary columns -> mode (smallest of tied modes)."""
    return apply_plan(df, imputation_plan(df, nominal=cols))


def impute_by_kind(df: DataFrame, exclude: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """IMP6: numeric -> median, string -> mode (every column with NULLs)."""
    num = columns_by_kind(df, "numeric", exclude)
    txt = columns_by_kind(df, "categorical", exclude)
    shares = null_shares(df, num + txt)
    num = [c for c in num if shares[c] > 0]
    txt = [c for c in txt if shares[c] > 0]
    med = medians(df, num, exact=exact)
    mod = modes(df, txt)
    exprs = {c: F.coalesce(nan_to_null(F.col(c).cast("double")), F.lit(float(v))) for c, v in med.items() if v is not None}
    exprs.update({c: F.coalesce(F.col(c), F.lit(v)) for c, v in mod.items() if v is not None})
    return df.withColumns(exprs) if exprs else df


# ---------------------------------------------------------------- IMP4 MICE
def _pattern(cols: Sequence[str]):
    """Bits of the columns that are missing in a row."""
    e = F.lit(0).cast("long")
    for i, c in enumerate(cols):
        e = e.bitwiseOR(F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return e


def _pattern_moments(src: DataFrame, cols: Sequence[str]) -> dict[int, tuple]:
    """{pattern: (rows, means, population covariances)} of the observed columns, from one aggregate (0 where missing)."""
    import numpy as np
    k = len(cols)
    aggs = [F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]]
    aggs += [F.covar_pop(cols[i], cols[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
    out = {}
    for r in src.groupBy(_pattern(cols).alias("p")).agg(*aggs).collect():  # a row for each pattern that occurs
        mean = np.array([r[f"m{i}"] or 0.0 for i in range(k)])
        cov = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
        out[r["p"]] = (r["n"], mean, cov)
    return out


def chained_predictions(moments: dict[int, tuple], k: int, rounds: int) -> dict[int, tuple]:
    """{pattern: (matrix, constant)}: what chained equations fill in is an affine function of the row's observed columns.

    A regression needs only the mean and covariance of the filled columns over
    the rows where its target was observed, and these follow from the moments
    of each pattern and its current affine fill.
    """
    import numpy as np
    bits = lambda p: np.array([bool(p >> i & 1) for i in range(k)])
    seen = [sum(n for p, (n, _, _) in moments.items() if not p >> i & 1) for i in range(k)]
    means = [sum(n * m[i] for p, (n, m, _) in moments.items() if not p >> i & 1) / seen[i] if seen[i] else 0.0
             for i in range(k)]
    fill = {p: (np.diag((~bits(p)).astype(float)), np.where(bits(p), means, 0.0)) for p in moments}
    usable = [i for i in range(k) if seen[i]]
    for _ in range(rounds if len(usable) > 1 else 0):
        for c in usable:
            others = [i for i in usable if i != c]
            rows = [(n, a @ m + d, a @ v @ a.T) for p, (n, m, v) in moments.items() if not p >> c & 1 for a, d in [fill[p]]]
            total = sum(n for n, _, _ in rows)
            mean = sum(n * m for n, m, _ in rows) / total
            cov = sum(n * (v + np.outer(m - mean, m - mean)) for n, m, v in rows) / total
            beta = np.linalg.lstsq(cov[np.ix_(others, others)], cov[others, c], rcond=None)[0]
            base = mean[c] - beta @ mean[others]
            for p, (a, d) in fill.items():
                if p >> c & 1:
                    a[c], d[c] = beta @ a[others], base + beta @ d[others]
    return fill


def mice(df: DataFrame, cols: Sequence[str], rounds: int = 10) -> DataFrame:
    """IMP4: chained equations over the high-missing columns.

    Start from the column means; each round regresses every column on the
    others (least squares on the rows where it was observed) and refills only
    its originally missing cells with the prediction. With one column there is
    no predictor, so the mean is the answer. A column without any value stays
    NULL and predicts nothing.

    The data are read once, for the moments of each missing pattern; all rounds
    run on matrices of ``len(cols)`` rows for each pattern, and the result is
    one projection (patterns that occur, at most ``2 ** len(cols)``, travel as a table).
    """
    cols = list(cols)
    k = len(cols)
    if k > 60:
        raise ValueError("at most 60 columns")
    clean = df.withColumns({c: nan_to_null(F.col(c).cast("double")) for c in cols})
    moments = _pattern_moments(clean.select(*cols), cols)
    gaps = {p: f for p, f in chained_predictions(moments, k, rounds).items() if p}
    if not gaps:
        return clean
    empty = {i for i in range(k) if all(p >> i & 1 for p in moments)}
    rows = [(int(p), [None if i in empty else float(d[i]) for i in range(k)], [[float(x) for x in r] for r in a])
            for p, (a, d) in gaps.items()]
    table = df.sparkSession.createDataFrame(rows, "__pattern long, __const array<double>, __coef array<array<double>>")
    marked = clean.withColumn("__p", _pattern(cols)).join(F.broadcast(table), F.col("__p") == F.col("__pattern"), "left")
    known = [F.coalesce(F.col(c), F.lit(0.0)) for c in cols]

    def filled(i: int):
        e = F.col("__const")[i]
        for j, x in enumerate(known):
            if j != i:
                e = e + F.col("__coef")[i][j] * x
        return F.coalesce(F.col(cols[i]), e)

    return marked.select(*[filled(cols.index(c)).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns])


# ---------------------------------------------------------------- IMP5 Estimator
class _MedianParams(HasInputCols):
    surrogates = Param(Params._dummy(), "surrogates", "fitted median per input column",
                       typeConverter=TypeConverters.toListFloat)
    exact = Param(Params._dummy(), "exact", "exact (interpolated) or approximate median",
                  typeConverter=TypeConverters.toBoolean)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(exact=True)


class MedianImputer(Estimator, _MedianParams, DefaultParamsReadable, DefaultParamsWritable):
    """IMP5: median imputer fitted on training rows, applied anywhere.

    Fitting is one aggregate; the model carries the surrogates as a param
    and persists with the standard ML writer.
    """

    @keyword_only
    def __init__(self, *, inputCols=None, exact=True):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "MedianImputerModel":
        cols = self.getInputCols()
        med = medians(dataset, cols, exact=self.getOrDefault(self.exact))
        m = MedianImputerModel(inputCols=cols, surrogates=[float("nan") if med[c] is None else float(med[c]) for c in cols])
        return self._copyValues(m)


class MedianImputerModel(Model, _MedianParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCols=None, surrogates=None, exact=True):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cols = self.getInputCols()
        vals = self.getOrDefault(self.surrogates)
        return dataset.withColumns({
            c: F.coalesce(nan_to_null(F.col(c).cast("double")), F.lit(None if math.isnan(v) else v).cast("double"))
            for c, v in zip(cols, vals) if c in dataset.columns})
