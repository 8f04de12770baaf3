"""Exact quantiles in two bounded passes for any number of columns or groups.

1. ``percentile_approx`` brackets every wanted quantile (its rank error is at
   most rows / accuracy);
2. one aggregation counts the rows between the brackets (a row per gap) and
   keeps the distinct values inside of them with their counts; running counts
   over this small table give the exact order statistics.

Only about ``6 / accuracy`` of a group's rows lie inside a bracket, so that
neither a column nor a group is ever held whole. Interpolation between the two
neighbouring order statistics matches pandas / ``percentile`` / DuckDB
``quantile_cont``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveylab.functions.expr import nan_to_null
from surveylab.session import kept

ACCURACY = 100_000


def quantiles_by(df: DataFrame, group: Sequence[str], value: str, probs: Sequence[float],
                 accuracy: int = ACCURACY) -> DataFrame:
    """(group…, n, q): the number of non-null values and the array of quantiles of each group.

    NULL and NaN values are passed by; a NULL group is a group. Infinite values
    are values like others.
    """
    keys, probs = list(group), [float(p) for p in probs]
    names = [f"__g{i}" for i in range(len(keys))]
    src = (df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], nan_to_null(F.col(value).cast("double")).alias("v"))
           .filter(F.col("v").isNotNull()))
    ends = [min(1.0, max(0.0, p + d)) for p in probs for d in (-3.0 / accuracy, 3.0 / accuracy)]
    marks = src.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", ends, accuracy).alias("e"))
    # A row per group. Kept, so that Spark knows the size: few groups are sent to the rows instead of the rows being dealt by
    # group, which would bring a whole column (or group) into one task.
    # The ends are plain columns: functions over arrays are interpreted for each row.
    brackets = kept(marks.select(
        *[F.col(g).alias(f"__k{i}") for i, g in enumerate(names)], "n",
        *[F.col("e")[2 * i + j].alias(f"__{end}{i}") for i in range(len(probs)) for j, end in enumerate(("lo", "hi"))]))
    on = F.lit(True)
    for i, g in enumerate(names):
        on = on & F.col(g).eqNullSafe(F.col(f"__k{i}"))
    inside = F.lit(False)
    for i in range(len(probs)):
        inside = inside | ((F.col("v") >= F.col(f"__lo{i}")) & (F.col("v") <= F.col(f"__hi{i}")))
    # rows outside of all brackets are ordered behind the greatest bracket end below them
    ends_below = [F.when(F.col(f"__hi{i}") < F.col("v"), F.col(f"__hi{i}")) for i in range(len(probs))]
    below = F.greatest(*ends_below) if len(ends_below) > 1 else ends_below[0]
    counts = (src.join(brackets, on).select(*names, "n", "v", (~inside).alias("gap"),
                                            F.when(inside, F.col("v")).otherwise(below).alias("at"))
              .groupBy(*names, "n", "at", "gap").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"),
                                                      F.max("v").alias("hi")))
    w = Window.partitionBy(*names).orderBy(F.col("at").asc_nulls_first(), "gap").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    run = counts.withColumn("upto", F.sum("c").over(w))

    def statistic(rank):
        """The value of a 0-based rank: that of a value inside, or the first or last one of a gap."""
        first = F.col("upto") - F.col("c")
        here = (rank >= first) & (rank < F.col("upto"))
        found = (F.when(~F.col("gap") | (rank == first), F.col("lo")).when(rank == F.col("upto") - 1, F.col("hi"))
                 .otherwise(F.raise_error(F.lit("quantile outside of its bracket: raise the accuracy")).cast("double")))
        return F.max(F.when(here, found))

    aggs = []
    for i, p in enumerate(probs):
        h = (F.col("n") - 1) * F.lit(p)
        aggs += [statistic(F.floor(h)).alias(f"a{i}"), statistic(F.ceil(h)).alias(f"z{i}")]
    out = run.groupBy(*names, "n").agg(*aggs)
    q = []
    for i, p in enumerate(probs):
        h = (F.col("n") - 1) * F.lit(p)
        a, z = F.col(f"a{i}"), F.col(f"z{i}")
        q.append(F.when(a == z, a).otherwise(a + (h - F.floor(h)) * (z - a)))
    return out.select(*[F.col(g).alias(k) for g, k in zip(names, keys)], "n", F.array(*q).alias("q"))


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], accuracy: int = ACCURACY) -> DataFrame:
    """(variable, n, q) for each column that has a value."""
    stacked = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "variable", "value")
    return quantiles_by(stacked, ["variable"], "value", probs, accuracy)


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], accuracy: int = ACCURACY) -> dict:
    """{col: [q(p) for p in probs]} (None for an all-NULL column); one row per column reaches the driver."""
    found = {r["variable"]: list(r["q"]) for r in column_quantiles(df, cols, probs, accuracy).collect()} if cols else {}
    return {c: found.get(c, [None] * len(probs)) for c in cols}
