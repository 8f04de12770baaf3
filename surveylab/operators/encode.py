"""Encoding (ENC1-ENC8).

Estimators here fit a small vocabulary or a few moments with one aggregate
and transform with a single projection of built-in expressions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveylab.functions.expr import map_values, nan_to_null, ratio
from surveylab.session import kept

OTHER = "other"


def level_text(df: DataFrame, col: str) -> Column:
    """Canonical text of a category level: integral numbers without '.0'."""
    dt = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dt, (T.DoubleType, T.FloatType, T.DecimalType)):
        c = nan_to_null(c.cast("double"))
        return F.when(c == F.floor(c), F.floor(c).cast("long").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


# ---------------------------------------------------------------- ENC1/ENC2
def recode(df: DataFrame, col: str, mapping: Mapping, keep_unmapped: bool = True,
           out: str | None = None) -> DataFrame:
    """ENC1/ENC2: dictionary recode; unmapped values pass through or -> NULL."""
    if col not in df.columns:
        return df
    return df.withColumn(out or col, map_values(col, mapping, keep_unmapped))


# ---------------------------------------------------------------- ENC3
class _LevelsParams(HasInputCols):
    levels = Param(Params._dummy(), "levels", "per input column, the fitted levels",
                   typeConverter=TypeConverters.toList)


def level_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(variable, level, cnt, share) for each column, one stacked aggregation."""
    st = (df.select(*[level_text(df, c).alias(c) for c in cols])
          .unpivot([], list(cols), "variable", "level")
          .filter(F.col("level").isNotNull()))
    counts = st.groupBy("variable", "level").agg(F.count(F.lit(1)).alias("cnt"))
    totals = st.groupBy("variable").agg(F.count(F.lit(1)).alias("total"))
    return (counts.join(totals, "variable")
            .withColumn("share", ratio(F.col("cnt"), F.col("total"))))


class RareCollapse(Estimator, _LevelsParams, DefaultParamsReadable, DefaultParamsWritable):
    """ENC3: levels with share < ``minShare`` (non-null denominator) -> 'other'.

    The kept set has at most 1/minShare levels per column, so it is a proven
    bound on what reaches the driver and the ``isin`` list.
    """
    minShare = Param(Params._dummy(), "minShare", "minimum share to keep a level",
                     typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, minShare=0.01):
        super().__init__()
        self._setDefault(minShare=0.01)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "RareCollapseModel":
        cols = self.getInputCols()
        ms = self.getOrDefault(self.minShare)
        kept = (level_counts(dataset, cols).filter(F.col("share") >= F.lit(ms))
                .groupBy("variable").agg(F.sort_array(F.collect_list("level")).alias("kept")))
        got = {r["variable"]: list(r["kept"]) for r in kept.collect()}
        return self._copyValues(RareCollapseModel(inputCols=cols, levels=[got.get(c, []) for c in cols]))


class RareCollapseModel(Model, _LevelsParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCols=None, levels=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        exprs = {}
        for c, kept in zip(self.getInputCols(), self.getOrDefault(self.levels)):
            if c not in dataset.columns:
                continue
            t = level_text(dataset, c)
            exprs[c] = F.when(t.isNull(), F.lit(None).cast("string")) \
                .when(t.isin(list(kept)), t).otherwise(F.lit(OTHER))
        return dataset.withColumns(exprs)


# ---------------------------------------------------------------- ENC4/ENC5
class OneHotColumns(Estimator, _LevelsParams, DefaultParamsReadable, DefaultParamsWritable):
    """ENC4: one-hot to named int columns ``{col}_{level}``, all levels kept.

    NULL -> all zero; the source column is dropped. ``maxLevels`` guards the
    vocabulary size (collapse rare levels first).
    """
    maxLevels = Param(Params._dummy(), "maxLevels", "refuse more levels than this",
                      typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, maxLevels=1000):
        super().__init__()
        self._setDefault(maxLevels=1000)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "OneHotColumnsModel":
        cols = self.getInputCols()
        cap = self.getOrDefault(self.maxLevels)
        counts = level_counts(dataset, cols).cache()
        # size check before any vocabulary is gathered
        too_many = counts.groupBy("variable").count().filter(F.col("count") > cap).select("variable").take(1)
        if too_many:
            counts.unpersist()
            raise ValueError(f"one-hot vocabulary of {too_many[0][0]} exceeds maxLevels={cap}")
        lv = counts.groupBy("variable").agg(F.sort_array(F.collect_list("level")).alias("lv"))
        got = {r["variable"]: list(r["lv"]) for r in lv.collect()}
        counts.unpersist()
        return self._copyValues(OneHotColumnsModel(inputCols=cols, levels=[got.get(c, []) for c in cols]))


class OneHotColumnsModel(Model, _LevelsParams, DefaultParamsReadable, DefaultParamsWritable):
    """ENC5: the fixed vocabulary at scoring; unseen level -> all zero."""

    @keyword_only
    def __init__(self, *, inputCols=None, levels=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def output_columns(self) -> list[str]:
        return [f"{c}_{v}" for c, lv in zip(self.getInputCols(), self.getOrDefault(self.levels)) for v in lv]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        exprs = {}
        drop = []
        for c, lv in zip(self.getInputCols(), self.getOrDefault(self.levels)):
            if c not in dataset.columns:
                for v in lv:
                    exprs[f"{c}_{v}"] = F.lit(0)
                continue
            t = level_text(dataset, c)
            for v in lv:
                exprs[f"{c}_{v}"] = F.coalesce(t == F.lit(v), F.lit(False)).cast("int")
            drop.append(c)
        return dataset.withColumns(exprs).drop(*drop)


# ---------------------------------------------------------------- ENC6
#: About so many distinct levels are numbered by one task.
LEVELS_A_PART = 1 << 17


def dense_codes(df: DataFrame, col: str, null_level: str = "nan", levels_a_part: int = LEVELS_A_PART) -> DataFrame:
    """(level, code): the distinct levels of a column as text, numbered from 0 in alphabetical (byte) order.

    Levels are dealt by range; each part numbers its own from the number of
    levels in the parts before it, so that neither the driver nor one task ever
    holds the vocabulary. NULL is the level ``null_level``.
    """
    levels = df.select(F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(null_level)).alias("level")).distinct()
    levels = kept(levels)
    parts = max(1, -(-levels.count() // levels_a_part))
    dealt = kept(levels.repartitionByRange(parts, "level").withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("here"))  # a row for each part
    before = counts.select("part", (F.sum("here").over(Window.orderBy("part")) - F.col("here")).alias("before"))
    number = F.row_number().over(Window.partitionBy("part").orderBy("level"))
    return dealt.join(F.broadcast(before), "part").select("level", (F.col("before") + number - 1).alias("code"))


def label_codes(df: DataFrame, cols: Sequence[str], null_level: str = "nan",
                suffix: str = "") -> tuple[DataFrame, dict[str, DataFrame]]:
    """ENC6: alphabetical integer codes for strings; NULL is a level of its own.

    Returns (frame, {column: its table of levels and codes}). The codes are
    joined back by level; Spark broadcasts the table only where it measures it
    as small, and splits a level that holds many rows otherwise.
    """
    out, tables = df, {}
    for i, c in enumerate(cols):
        tables[c] = kept(dense_codes(df, c, null_level))
        found = tables[c].select(F.col("level").alias(f"__lc_{i}"), F.col("code").cast("int").alias(f"__code_{i}"))
        out = (out.withColumn(f"__lv_{i}", F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(null_level)))
               .join(found, F.col(f"__lv_{i}") == F.col(f"__lc_{i}"), "left"))
    codes = {c + suffix: F.col(f"__code_{i}") for i, c in enumerate(cols)}
    own = [F.col(f"`{c}`") if c not in codes else codes[c].alias(c) for c in df.columns]
    return out.select(*own, *[e.alias(c) for c, e in codes.items() if c not in df.columns]), tables


# ---------------------------------------------------------------- ENC7
def threshold_label(df: DataFrame, col: str, cut: float = -2.0, out: str = "label") -> DataFrame:
    """ENC7: 1 when value < cut, NULL -> 0 (pandas NaN comparison semantics)."""
    return df.withColumn(out, F.coalesce(nan_to_null(F.col(col).cast("double")) < F.lit(cut),
                                         F.lit(False)).cast("int"))


# ---------------------------------------------------------------- ENC8
class _ZParams(HasInputCols):
    means = Param(Params._dummy(), "means", "fitted means", typeConverter=TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "fitted population std", typeConverter=TypeConverters.toListFloat)


class ZScore(Estimator, _ZParams, DefaultParamsReadable, DefaultParamsWritable):
    """ENC8: z-score with the population std (as the reference's scaler).

    Column-wise, so it needs no vector assembly; one aggregate to fit. A
    zero std leaves the centred value unscaled (divides by 1).
    """

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "ZScoreModel":
        cols = self.getInputCols()
        row = dataset.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
                          *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        means = [float(row[f"m{i}"] or 0.0) for i in range(len(cols))]
        stds = [float(row[f"s{i}"] or 0.0) for i in range(len(cols))]
        stds = [s if s > 0 else 1.0 for s in stds]
        return self._copyValues(ZScoreModel(inputCols=cols, means=means, stds=stds))


class ZScoreModel(Model, _ZParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCols=None, means=None, stds=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cols = self.getInputCols()
        ms, ss = self.getOrDefault(self.means), self.getOrDefault(self.stds)
        return dataset.withColumns({c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s)
                                    for c, m, s in zip(cols, ms, ss) if c in dataset.columns})
