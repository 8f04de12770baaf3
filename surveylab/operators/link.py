"""Record linkage (JN1-JN4, SET3).

Joins are left to Catalyst/AQE: no broadcast hint is put on data tables, so
the broadcast decision is taken at runtime from measured sizes
(``spark.sql.autoBroadcastJoinThreshold``) and sort-merge is used beyond it.
AQE skew-join splits a hot key (one household holding many children).
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def _pairs(on) -> list[tuple[str, str]]:
    if isinstance(on, str):
        return [(on, on)]
    out = []
    for k in on:
        out.append((k, k) if isinstance(k, str) else (k[0], k[1]))
    return out


def link_records(child: DataFrame, parent: DataFrame, on, how: str = "inner",
                 drop_redundant: bool = True) -> DataFrame:
    """JN1/JN2: equi-join child rows to their parent record.

    ``on`` is a key name, a list of names, or ``[(left, right), ...]`` pairs
    for composite keys named differently on each side. Right key columns are
    renamed to the left names so the result has one copy of each key, and
    non-key columns the parent shares with the child are dropped from the
    parent first (the child's copy wins), as the survey merge does.
    """
    pairs = _pairs(on)
    right = parent.withColumnsRenamed({r: l for l, r in pairs if r != l})
    keys = [l for l, _ in pairs]
    if drop_redundant:
        shared = [c for c in right.columns if c in child.columns and c not in keys]
        if shared:
            right = right.drop(*shared)
    if how == "inner":
        # explicit, so they reach the Parquet reader even where constraint
        # inference is switched off for wide plans
        child, right = child.filter(_all_not_null(keys)), right.filter(_all_not_null(keys))
    return child.join(right, on=keys, how=how)


def _all_not_null(keys):
    cond = F.col(keys[0]).isNotNull()
    for k in keys[1:]:
        cond = cond & F.col(k).isNotNull()
    return cond


def enrich(df: DataFrame, other: DataFrame, on, cols: Sequence[str],
           dedupe: bool = True, suffix: str = "_other") -> DataFrame:
    """JN3: left join bringing back columns without multiplying rows.

    With ``dedupe`` the right side is reduced to one row per key first (the
    smallest tuple of the requested columns, deterministic) and the number
    of candidate rows per key is returned as ``match_count`` so fan-out is
    reported rather than silently applied. Name clashes get ``suffix``.
    """
    pairs = _pairs(on)
    keys = [l for l, _ in pairs]
    right = other.withColumnsRenamed({r: l for l, r in pairs if r != l}).select(*keys, *cols)
    ren = {c: c + suffix for c in cols if c in df.columns}
    right = right.withColumnsRenamed(ren)
    out_cols = [ren.get(c, c) for c in cols]
    if dedupe:
        right = (right.groupBy(*keys)
                 .agg(F.min(F.struct(*[F.col(c) for c in out_cols])).alias("_best"),
                      F.count(F.lit(1)).alias("match_count"))
                 .select(*keys, *[F.col("_best")[c].alias(c) for c in out_cols], "match_count"))
    return df.join(right, on=keys, how="left")


def link_audit(stages: Mapping[str, DataFrame]) -> DataFrame:
    """JN4: (stage, rows) for each named stage, one union of aggregates."""
    parts = [d.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("stage"), F.lit(i).alias("step"), "rows")
             for i, (name, d) in enumerate(stages.items())]
    return functools.reduce(DataFrame.unionByName, parts)


class LinkAudit:
    """JN4 in one pass: the rows of every stage of a linkage are counted while the linked rows are computed.

    ``watch`` puts a counter (``DataFrame.observe``) on a stage's output; the
    stages that are built on it carry the counter along, and ``rows`` runs the
    last stage once. If nothing is linked Spark may leave out some stages' work,
    so that they are then counted by themselves.
    """

    def __init__(self):
        self.stages: dict[str, tuple[DataFrame, Observation]] = {}

    def watch(self, name: str, df: DataFrame) -> DataFrame:
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        self.stages[name] = (df, seen)
        return df.observe(seen, F.count(F.lit(1)).alias("rows"))

    def rows(self, linked: DataFrame) -> DataFrame:
        """(stage, step, rows) of the watched stages in their order; ``linked`` is the last one, built on all others."""
        if linked.count() == 0:
            return link_audit({name: df for name, (df, _) in self.stages.items()})
        found = [(name, i, int(seen.get["rows"])) for i, (name, (_, seen)) in enumerate(self.stages.items())]
        return linked.sparkSession.createDataFrame(found, "stage string, step int, rows long")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JN4: keys that occur more than once with their multiplicity."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
            .filter(F.col("n_rows") > 1))


def attach(df: DataFrame, other: DataFrame, key, how: str = "inner") -> DataFrame:
    """SET3: column-wise concat by key (never by row position)."""
    return link_records(df, other, key, how=how)
