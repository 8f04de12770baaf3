"""Scoring, risk index and tiers (SCO1-SCO6, SCL6).

A scorer is anything with ``score(df) -> df + probability column``: a
fitted ``pyspark.ml`` model, or :class:`LinearScorer`, whose probability is
a closed-form expression (and so has an SQL twin for the oracle).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveylab.functions.expr import clamp, nan_to_null
from surveylab.operators.stats import top_k_per

# Risk index knots and tier table of the reference's scoring.
BASE_RATE = 0.258
TOP_PROB = 0.60
KNEE_INDEX = 40.0
TIERS = [
    # (lower bound inclusive, tier, badge, action)
    (0.0, "Low Risk", "success",
     "Child exhibits healthy nutritional trajectory. Recommend standard monitoring."),
    (15.0, "Moderate Risk", "warning",
     "Child shows mild vulnerability factors. Routine health checkups recommended."),
    (35.0, "High Risk", "danger",
     "Significant stunting risk detected. Priority intervention recommended."),
    (60.0, "Severe Risk", "critical",
     "Urgent clinical and nutritional intervention required!"),
]


class LinearScorer:
    """Logistic scorer p = 1 / (1 + exp(-(b0 + Σ b·x))) with literal coefficients.

    NULL inputs count as 0 (as aligned feature vectors do).
    """

    def __init__(self, coefs: Mapping[str, float], intercept: float = 0.0, prob_col: str = "probability"):
        self.coefs = dict(coefs)
        self.intercept = float(intercept)
        self.prob_col = prob_col

    def margin(self, df: DataFrame | None = None) -> Column:
        m = F.lit(self.intercept)
        for c, b in self.coefs.items():
            x = F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if (df is None or c in df.columns) else F.lit(0.0)
            m = m + F.lit(float(b)) * x
        return m

    def prob(self, df: DataFrame | None = None) -> Column:
        return 1.0 / (1.0 + F.exp(-self.margin(df)))

    def score(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.prob_col, self.prob(df))

    def sql_margin(self) -> str:
        return " + ".join([repr(self.intercept)] + [f"{b!r} * coalesce(CAST({c} AS DOUBLE), 0.0)"
                                                   for c, b in self.coefs.items()])

    def sql_prob(self) -> str:
        return f"(1.0 / (1.0 + exp(-({self.sql_margin()}))))"


class ModelScorer:
    """Wraps a fitted ``pyspark.ml`` model: probability of class 1 as a double column."""

    def __init__(self, model, prob_col: str = "probability"):
        self.model = model
        self.prob_col = prob_col

    def score(self, df: DataFrame) -> DataFrame:
        from surveylab.operators.modeling import positive_probability
        if made := [c for c in df.columns if c.startswith("__model_")]:
            raise ValueError(f"the model's own columns are in the way: {made}")
        return positive_probability(self.model, df, "__p").select(*df.columns, F.col("__p").alias(self.prob_col))


def score(df: DataFrame, scorer) -> DataFrame:
    """SCO2: batch probability for every row (one projection / model transform)."""
    return scorer.score(df)


def risk_index(p, base: float = BASE_RATE, top: float = TOP_PROB, knee: float = KNEE_INDEX) -> Column:
    """SCO3: two linear pieces meeting at ``knee`` when p = base, 100 at p = top, clamped."""
    p = nan_to_null(F.col(p) if isinstance(p, str) else p)
    raw = F.when(p < base, p / base * knee).otherwise(knee + (p - base) / (top - base) * (100.0 - knee))
    return clamp(raw, 0.0, 100.0)


def risk_tier(df: DataFrame, idx: str, tiers=TIERS, out_prefix: str = "") -> DataFrame:
    """SCO4: tier, badge and action by lower-inclusive cut points."""
    def chain(field):
        e = None
        for lo, *vals in reversed(tiers):
            v = F.lit(vals[field])
            e = F.when(F.col(idx) >= lo, v) if e is None else e.when(F.col(idx) >= lo, v)
        return e.otherwise(F.lit(tiers[0][field + 1]))
    return df.withColumns({f"{out_prefix}tier": chain(0), f"{out_prefix}badge": chain(1),
                           f"{out_prefix}action": chain(2)})


def score_and_tier(df: DataFrame, scorer, prob: str = "probability") -> DataFrame:
    """SCO2-SCO4: probability, 2-dp index ``risk_pct`` and tier columns in one plan."""
    s = scorer.score(df)
    s = s.withColumn("risk_pct", F.round(risk_index(prob), 2))
    return risk_tier(s, "risk_pct")


def risk_worklist(scored: DataFrame, area: str, key, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """SCO5: (tier counts per area, top-k highest-risk rows per area)."""
    counts = scored.groupBy(area, "tier").agg(F.count(F.lit(1)).alias("n")).orderBy(area, "tier")
    keys = [key] if isinstance(key, str) else list(key)
    top = top_k_per(scored, area, "probability", k, use_abs=False, tie=keys)
    return counts, top


def parse_payload(c, schema: str) -> Column:
    """SCL6: JSON request body -> typed struct (absent keys NULL)."""
    return F.from_json(F.col(c) if isinstance(c, str) else c, schema)


# ---------------------------------------------------------------- SCO1 / SCO6
# The request fields the scoring form accepts and their
# declared defaults (applied when a key is absent).
REQUEST_DEFAULTS = {
    "child_age_months": 24.0, "child_sex": 0.0, "birth_order": 1.0, "birth_interval": 36.0,
    "anc_visits": 4.0, "caesarean": 0.0, "diarrhea_recent": 0.0, "fever_recent": 0.0,
    "mother_age": 26.0, "mother_education": 2.0, "wealth_index": 3.0, "mother_anemia": 0.0,
    "electricity": 1.0, "share_toilet": 0.0, "mother_bmi": 21.5,
}
REQUEST_CATEGORICAL = {"toilet_type": "toilet_type_11", "water_source": "water_source_11",
                       "delivery_place": "delivery_place_21"}
# What the short form asks, and what it answers itself.
SHORT_FORM_FIELDS = ["child_age_months", "anc_visits", "toilet_type", "water_source", "diarrhea_recent"]
SHORT_FORM_FIXED = {"child_sex": 0.0, "wealth_index": 2.0, "mother_education": 1.0}


def build_features(df: DataFrame, feature_names: Sequence[str], numeric: Mapping[str, str] | None = None,
                   categorical: Mapping[str, str] | None = None, defaults: Mapping[str, float] = REQUEST_DEFAULTS,
                   keep: Sequence[str] = (), derive=None) -> DataFrame:
    """SCO1/SCO6: raw request rows -> feature columns aligned to ``feature_names``.

    ``numeric`` maps a request field to its source column (absent -> the
    declared default); a value that fails to cast is NULL and reported in
    ``error`` instead of the row being dropped. ``categorical`` maps a field
    to a source column whose text names an indicator column ("toilet_type_31");
    unknown names set nothing. ``derive`` recomputes derived features so
    scoring and training share one feature function. One projection.
    """
    numeric = dict(numeric or {})
    categorical = dict(categorical or {})
    cols, errs = {}, []
    for f, dflt in defaults.items():
        src = numeric.get(f)
        if src is not None and src in df.columns:
            raw = F.col(src)
            v = raw.cast("string").try_cast("double")
            errs.append(F.when(raw.isNotNull() & v.isNull(), F.lit(f)))
            cols[f] = F.coalesce(v, F.lit(dflt))
        else:
            cols[f] = F.lit(float(dflt))
    ind = {}
    for f, dflt in REQUEST_CATEGORICAL.items():
        src = categorical.get(f)
        val = F.coalesce(F.col(src).cast("string"), F.lit(dflt)) if src in df.columns else F.lit(dflt)
        ind[f] = val
    out = df.select(*keep, *[v.alias(k) for k, v in cols.items()],
                    *[v.alias(f"__{k}") for k, v in ind.items()],
                    F.concat_ws(",", *errs).alias("error") if errs else F.lit("").alias("error"))
    exprs = {}
    for n in feature_names:
        if n in cols:
            continue
        hits = [F.col(f"__{f}") == F.lit(n) for f in ind if n.startswith(f + "_")]
        if hits:
            exprs[n] = F.coalesce(hits[0], F.lit(False)).cast("double")
    # level text after the prefix ('toilet_type_31' -> '31') for the derived features
    exprs.update({f: F.when(F.col(f"__{f}").startswith(f + "_"), F.expr(f"substring(`__{f}`, {len(f) + 2})"))
                  for f in ind})
    out = out.withColumns(exprs) if exprs else out
    if derive is not None:
        out = derive(out)
    missing = [n for n in feature_names if n not in out.columns]
    out = out.withColumns({n: F.lit(0.0) for n in missing}) if missing else out
    return out.select(*keep, *[F.col(n).cast("double").alias(n) for n in feature_names], "error")
