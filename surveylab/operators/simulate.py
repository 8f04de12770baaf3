"""What-if simulation and counterfactuals (SIM1-SIM7).

Scenarios fan rows out with ``explode`` over a literal array of package ids
(no join of any kind); every override is a ``when(package == id, ...)``
expression, derived features are recomputed after the overrides, and the
whole fan-out is scored in **one** pass.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveylab.functions.expr import uniform
from surveylab.operators.scoring import risk_index


@dataclass
class Override:
    """SIM2: one column override of a package."""
    kind: str            # set | onehot | raise_to | lower
    col: str             # column, or one-hot prefix for 'onehot'
    value: float | str | None = None
    delta: float = 0.0

    @staticmethod
    def set(col, value):
        return Override("set", col, value)

    @staticmethod
    def onehot(prefix, level):
        return Override("onehot", prefix, level)

    @staticmethod
    def raise_to(col, floor, delta):
        return Override("raise_to", col, floor, delta)

    @staticmethod
    def lower(col, delta, floor=0.0):
        return Override("lower", col, floor, delta)

    def exprs(self, df: DataFrame) -> dict[str, Column]:
        if self.kind == "set":
            if self.col not in df.columns:
                return {}
            v = F.lit(self.value)
            return {self.col: v if isinstance(self.value, str) else v.cast("double")}
        if self.kind == "onehot":
            cols = [c for c in df.columns if c.startswith(self.col)]
            return {c: F.lit(1.0 if c == f"{self.col}{self.value}" else 0.0) for c in cols}
        if self.col not in df.columns:
            return {}
        x = F.col(self.col).cast("double")
        if self.kind == "raise_to":
            return {self.col: F.greatest(F.lit(float(self.value)), x + F.lit(self.delta))}
        if self.kind == "lower":
            return {self.col: F.greatest(F.lit(float(self.value)), x - F.lit(self.delta))}
        raise ValueError(self.kind)


@dataclass
class Package:
    package_id: str
    package_name: str
    overrides: list[Override] = field(default_factory=list)
    base: str | None = None      # apply another package's overrides first




def _is_text(df: DataFrame, c: str) -> bool:
    return df.schema[c].dataType.typeName() == "string"


def _apply_sequential(df: DataFrame, packages: Sequence[Package]) -> DataFrame:
    """Overrides applied in order, each seeing the previous ones (per package)."""
    by_id = {p.package_id: p for p in packages}

    def chain(p):
        return (chain(by_id[p.base]) if p.base else []) + list(p.overrides)

    out = df
    for p in packages:
        for o in chain(p):
            ex = o.exprs(out)
            out = out.withColumns({c: F.when(F.col("package_id") == p.package_id, e)
                                   .otherwise(F.col(c) if _is_text(out, c) else F.col(c).cast("double"))
                                   for c, e in ex.items()})
    return out


SCENARIO_SCHEMA = ("package_id string, package_name string, step int, kind string, col string, "
                   "value string, delta double, base string")


def packages_from_table(scenarios: DataFrame) -> list[Package]:
    """SIM2 / user-extension surface: packages from a scenario table.

    One row per override (``SCENARIO_SCHEMA``): kind in set | onehot |
    raise_to | lower, ``value`` as text (numbers are parsed), ``step`` orders
    the overrides of a package, ``base`` names a package applied first. The
    table has one row per override, so collecting it is bounded by the
    scenario definition, not the data.
    """
    rows = scenarios.orderBy("package_id", "step").collect()
    pk: dict[str, Package] = {}
    for r in rows:
        p = pk.setdefault(r["package_id"], Package(r["package_id"], r["package_name"], [], r["base"]))
        v = r["value"]
        try:
            v = float(v) if v is not None and r["kind"] != "onehot" else v
        except ValueError:
            pass
        if v is None and r["kind"] == "lower":
            v = 0.0          # default floor of a lowering override
        p.overrides.append(Override(r["kind"], r["col"], v, float(r["delta"] or 0.0)))
    return list(pk.values())


def simulate(df: DataFrame, key, packages: Sequence[Package], scorer,
             derive: Callable[[DataFrame], DataFrame] | None = None,
             names: dict | None = None) -> DataFrame:
    """SIM1/SIM3: per row and package the simulated index and its reduction.

    Output: key, package_id, package_name, baseline_risk_pct,
    simulated_risk_pct, risk_reduction_pct (= rounded baseline index -
    rounded scenario index). The baseline is scored on the rows before the
    fan-out and carried through it, so the plan has no shuffle at all: two
    scoring projections (or model transforms) in one stage.
    """
    keys = [key] if isinstance(key, str) else list(key)
    base = derive(df) if derive is not None else df
    base = (scorer.score(base).withColumn("baseline_risk_pct", F.round(risk_index(scorer.prob_col), 2))
            .select(*df.columns, "baseline_risk_pct"))
    fan = base.withColumn("package_id", F.explode(F.array(*[F.lit(p.package_id) for p in packages])))
    fan = _apply_sequential(fan, packages)
    if derive is not None:
        fan = derive(fan)
    s = scorer.score(fan).withColumn("simulated_risk_pct", F.round(risk_index(scorer.prob_col), 2))
    name_map = {p.package_id: p.package_name for p in packages}
    name_map.update(names or {})
    nm = F.create_map(*[F.lit(x) for kv in name_map.items() for x in kv])
    return s.select(*keys, "package_id", F.element_at(nm, F.col("package_id")).alias("package_name"),
                    "baseline_risk_pct", "simulated_risk_pct",
                    F.round(F.col("baseline_risk_pct") - F.col("simulated_risk_pct"), 2).alias("risk_reduction_pct"))


def best_scenario(sim: DataFrame, key) -> DataFrame:
    """SIM4: package with the largest reduction per key; ties -> smallest id."""
    keys = [key] if isinstance(key, str) else list(key)
    return sim.groupBy(*keys).agg(
        F.min_by(F.col("package_id"), F.struct(-F.col("risk_reduction_pct"), F.col("package_id"))).alias("best_package"),
        F.max("risk_reduction_pct").alias("best_reduction_pct"))


def best_scenario_in_row(df: DataFrame, key, packages: Sequence[Package], scorer,
                         derive: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """SIM4 without a fan-out: every package is scored on the row itself, and the best one picked there (no shuffle)."""
    keys = [key] if isinstance(key, str) else list(key)
    prepared = derive(df) if derive is not None else df
    cur = (scorer.score(prepared).withColumn("__base", F.round(risk_index(scorer.prob_col), 2))
           .select(*keys, F.struct(*df.columns).alias("__row"), "__base"))
    cuts: list[str] = []
    for i, p in enumerate(packages):
        d = cur.select("__row.*", "__row", "__base", *cuts).withColumn("package_id", F.lit(p.package_id))
        d = _apply_sequential(d, packages)
        d = scorer.score(derive(d) if derive is not None else d)
        d = d.withColumn(f"__cut{i}", F.round(F.col("__base") - F.round(risk_index(scorer.prob_col), 2), 2))
        cuts.append(f"__cut{i}")
        cur = d.select("__row", "__base", *cuts)
    best = F.array_min(F.array(*[F.struct((-F.col(c)).alias("o"), F.lit(p.package_id).alias("package_id"))
                                 for c, p in zip(cuts, packages)]))
    return cur.select("__row.*", best.alias("__b")).select(
        *keys, F.col("__b.package_id").alias("best_package"), (-F.col("__b.o")).alias("best_reduction_pct"))


def tier_shift(sim: DataFrame, threshold: float = 35.0, by: str = "package_id") -> DataFrame:
    """SIM4: share of rows at/above a tier boundary that move below it, per package."""
    at = F.col("baseline_risk_pct") >= threshold
    moved = at & (F.col("simulated_risk_pct") < threshold)
    return sim.groupBy(by).agg(F.sum(at.cast("long")).alias("n_at_risk"),
                               F.sum(moved.cast("long")).alias("n_moved"),
                               F.try_divide(F.sum(moved.cast("double")), F.sum(at.cast("double"))).alias("share_moved"))


def diff_rows(orig: DataFrame, new: DataFrame, key, cols: Sequence[str], labels: dict | None = None) -> DataFrame:
    """SIM6: (key, feature, from, to) for every changed column (NULL-safe)."""
    keys = [key] if isinstance(key, str) else list(key)
    cols = list(cols)
    # The rows are joined as they are and their columns laid out afterwards: a long table would be dealt by key and feature.
    a = orig.select(*keys, *[F.col(c).cast("double").alias(f"__f{i}") for i, c in enumerate(cols)])
    extra = [k for k in new.columns if k == "cf_id"]
    b = new.select(*keys, *extra, *[F.col(c).cast("double").alias(f"__t{i}") for i, c in enumerate(cols)])
    pairs = F.array_compact(F.array(*[
        F.when(~F.col(f"__f{i}").eqNullSafe(F.col(f"__t{i}")),
               F.struct(F.lit(c).alias("feature"), F.col(f"__f{i}").alias("from"), F.col(f"__t{i}").alias("to")))
        for i, c in enumerate(cols)]))
    j = (a.join(b, on=keys, how="inner").select(*keys, *extra, F.explode(pairs).alias("__p"))
         .select(*keys, F.col("__p.feature"), F.col("__p.from"), *extra, F.col("__p.to")))
    if labels:
        m = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
        j = j.withColumn("feature", F.coalesce(F.element_at(m, F.col("feature")), F.col("feature")))
    return j


def mutable_columns(df: DataFrame, immutable: Sequence[str]) -> list[str]:
    """SIM7: columns an intervention may change (plan-time list)."""
    imm = set(immutable)
    return [c for c in df.columns if c not in imm]


def counterfactuals(df: DataFrame, key, mutable_continuous: Sequence[str], mutable_levels: dict,
                    scorer, n: int = 2, draws: int = 50, seed: int = 42, p_min: float = 0.35,
                    p_target: float = 0.5, derive=None) -> DataFrame:
    """SIM5: for rows with p > p_min, up to n changed versions predicted class 0.

    Each row fans out to ``draws`` candidates; a candidate changes each
    mutable column with probability 1/2 to a seeded draw from the observed
    range (continuous, one min/max aggregate) or from the given level list.
    All candidates are scored in one pass; those with p < p_target are
    ranked by (number changed, L1 distance, draw) and the first n kept
    (``status`` 'found'). A row without any such candidate stays with one line
    of ``status`` 'none' and the score of its first candidate.
    """
    keys = [key] if isinstance(key, str) else list(key)
    base = scorer.score(derive(df) if derive is not None else df)
    hot = base.filter(F.col(scorer.prob_col) > p_min).select(*df.columns)
    rng = df.agg(*[F.min(F.col(c).cast("double")).alias(f"lo_{c}") for c in mutable_continuous],
                 *[F.max(F.col(c).cast("double")).alias(f"hi_{c}") for c in mutable_continuous]).first()
    fan = hot.withColumn("cf_id", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    changes, dist = [], F.lit(0.0)
    exprs = {}
    for c in mutable_continuous:
        lo, hi = rng[f"lo_{c}"], rng[f"hi_{c}"]
        if lo is None:
            continue
        pick = uniform(seed, *keys, F.col("cf_id"), F.lit(c + ":pick")) < 0.5
        val = F.round(F.lit(lo) + uniform(seed, *keys, F.col("cf_id"), F.lit(c)) * F.lit(hi - lo), 0)
        exprs[c] = F.when(pick, val).otherwise(F.col(c).cast("double"))
    for c, levels in mutable_levels.items():
        pick = uniform(seed, *keys, F.col("cf_id"), F.lit(c + ":pick")) < 0.5
        idx = F.floor(uniform(seed, *keys, F.col("cf_id"), F.lit(c)) * len(levels)).cast("int")
        arr = F.array(*[F.lit(float(v)) for v in levels])
        exprs[c] = F.when(pick, F.element_at(arr, idx + 1)).otherwise(F.col(c).cast("double"))
    orig = {c: F.col(c).cast("double") for c in exprs}
    fan = fan.withColumns({f"__o_{c}": e for c, e in orig.items()}).withColumns(exprs)
    for c in exprs:
        ch = ~F.col(c).eqNullSafe(F.col(f"__o_{c}"))
        changes.append(ch.cast("int"))
        dist = dist + F.coalesce(F.abs(F.col(c) - F.col(f"__o_{c}")), F.lit(0.0))
    fan = fan.withColumn("n_changed", sum(changes[1:], changes[0]) if changes else F.lit(0)) \
        .withColumn("distance", dist).drop(*[f"__o_{c}" for c in exprs])
    if derive is not None:
        fan = derive(fan)
    good = F.coalesce((F.col(scorer.prob_col) < p_target) & (F.col("n_changed") > 0), F.lit(False))
    s = scorer.score(fan).withColumn("status", F.when(good, "found").otherwise("none"))
    # found candidates come first ('found' < 'none'), so that a row's first line tells whether it has any
    w = Window.partitionBy(*keys).orderBy("status", "n_changed", "distance", "cf_id")
    return (s.withColumn("cf_rank", F.row_number().over(w))
            .filter((F.col("cf_rank") <= n) & ((F.col("status") == "found") | (F.col("cf_rank") == 1))))
