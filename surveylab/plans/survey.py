"""Survey-role view of the driver tables, its feature set, scorer and packages.

Role columns are declared once as SQL expression text that Spark
(``F.expr``) and DuckDB evaluate identically; they are the *fixture*. The
operators applied on top (recode, features, scoring, simulation,
attribution) are the code under test, and their SQL twins below are
written independently for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveylab.operators import clean
from surveylab.operators.encode import recode
from surveylab.operators.features import add_features
from surveylab.operators.scoring import LinearScorer
from surveylab.operators.simulate import Override, Package
from surveylab.plans.linked import linked_frame, linked_sql
from surveylab.plans.tables import CHILD_KEY

# Fixed values of this repo's fixture: role -> SQL expression over the linked table.
ROLE_EXPRS = {
    "area": "c_nationkey",
    "child_age_months": "l_quantity",
    "child_sex": "CAST(1 + l_partkey % 2 AS INTEGER)",
    "birth_order": "l_linenumber",
    "birth_interval": "l_tax * CAST(1000 AS DOUBLE)",
    "anc_visits": "l_discount * CAST(100 AS DOUBLE)",
    "diarrhea_recent": "CAST(l_linestatus = 'O' AS INTEGER)",
    "fever_recent": "CAST(o_orderstatus = 'P' AS INTEGER)",
    "caesarean": "CAST(l_linenumber % 2 AS INTEGER)",
    "mother_age": "CAST(15 + o_custkey % 35 AS DOUBLE)",
    "mother_education": "LEAST(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1, 3)",
    "wealth_index": "CAST(1 + c_nationkey % 5 AS INTEGER)",
    "mother_anemia": "CAST(1 + l_orderkey % 4 AS INTEGER)",
    "mother_bmi": "15 + c_acctbal / CAST(500 AS DOUBLE)",
    "share_toilet": "CAST(c_custkey % 3 = 0 AS INTEGER)",
    "electricity": "CAST(o_totalprice > 100000 AS INTEGER)",
    "toilet_type": "c_mktsegment",
    "water_source": "o_orderpriority",
    "delivery_place": "o_orderstatus",
    "stunting_label": "CAST(l_returnflag = 'R' AS INTEGER)",
}
ANEMIA_MAP = {1: 3, 2: 2, 3: 1, 4: 0}          # reversed severity scale (reference)
SEX_MAP = {1: 0, 2: 1}
OPEN_DEFECATION_LEVEL = "BUILDING"
UNSAFE_WATER_LEVELS = ["5-LOW", "4-NOT SPECIFIED"]
SAFE_TOILET_LEVEL = "HOUSEHOLD"
SAFE_WATER_LEVEL = "1-URGENT"
IMMUTABLE = ["child_sex", "child_age_months", "birth_order", "birth_interval", "caesarean",
             "mother_age", "mother_age_group"]

ROLES = {
    "share_toilet": "share_toilet", "diarrhea": "diarrhea_recent", "fever": "fever_recent",
    "mother_age": "mother_age", "mother_education": "mother_education", "mother_anemia": "mother_anemia",
    "mother_bmi": "mother_bmi", "birth_order": "birth_order", "birth_interval": "birth_interval",
    "wealth": "wealth_index", "child_age": "child_age_months", "anc_visits": "anc_visits",
    "water_source": "water_source", "toilet_type": "toilet_type",
}


def survey_frame(spark: SparkSession, sf_dir: str, encoded: bool = True) -> DataFrame:
    """Linked rows with a child age, as survey roles; anaemia/sex recoded (ENC1/ENC2)."""
    df = clean.drop_missing(linked_frame(spark, sf_dir), ["l_quantity"])
    df = df.select(*CHILD_KEY, *[F.expr(e).alias(r) for r, e in ROLE_EXPRS.items()])
    if encoded:
        df = recode(df, "mother_anemia", ANEMIA_MAP, keep_unmapped=True)
        df = recode(df, "child_sex", SEX_MAP, keep_unmapped=False)
    return df


def survey_sql(encoded: bool = True) -> str:
    """CTE chain ``linked, survey`` matching :func:`survey_frame`."""
    roles = ",\n       ".join(f"{e} AS {r}" for r, e in ROLE_EXPRS.items())
    base = f"WITH linked AS ({linked_sql()}),\nsurvey0 AS (SELECT {', '.join(CHILD_KEY)},\n       {roles}\n  FROM linked WHERE l_quantity IS NOT NULL)"
    if not encoded:
        return base + ",\nsurvey AS (SELECT * FROM survey0)"
    anemia = " ".join(f"WHEN {k} THEN {v}" for k, v in ANEMIA_MAP.items())
    sex = " ".join(f"WHEN {k} THEN {v}" for k, v in SEX_MAP.items())
    return base + (f",\nsurvey AS (SELECT * REPLACE (CASE mother_anemia {anemia} ELSE mother_anemia END AS mother_anemia,"
                   f" CASE child_sex {sex} END AS child_sex) FROM survey0)")


def derive(df: DataFrame) -> DataFrame:
    """The one feature function used for training, scoring and simulation."""
    return add_features(df, ROLES, UNSAFE_WATER_LEVELS, OPEN_DEFECATION_LEVEL)


def _f(cond: str) -> str:
    return f"CAST(coalesce({cond}, false) AS DOUBLE)"


def features_sql_exprs() -> dict[str, str]:
    """Independent SQL text of FEA1-FEA10 over role columns (oracle side)."""
    d = lambda c: f"CAST({c} AS DOUBLE)"
    age, edu, anc = d("mother_age"), d("mother_education"), d("anc_visits")
    wealth, cage = d("wealth_index"), d("child_age_months")
    bmi, anemia = f"coalesce({d('mother_bmi')}, 20.0)", f"coalesce({d('mother_anemia')}, 0.0)"
    diar = f"coalesce({d('diarrhea_recent')}, 0.0)"
    san = f"({_f(f'toilet_type = {OPEN_DEFECATION_LEVEL!r}')} * 2.0 + coalesce({d('share_toilet')}, 0.0))"
    crit = _f(f"{cage} BETWEEN 6.0 AND 24.0")
    unsafe = ", ".join(repr(x) for x in UNSAFE_WATER_LEVELS)
    return {
        "sanitation_score": san,
        "anc_adequacy_flag": _f(f"{anc} >= 4.0"),
        "disease_burden_index": f"({diar} + coalesce({d('fever_recent')}, 0.0))",
        "maternal_vulnerability_score": (f"({_f(f'{age} < 20.0 OR {age} > 35.0')} + {_f(f'{edu} = 0')} * 1.5"
                                         f" + {_f(f'{edu} = 1')} * 0.5 + {anemia} + {_f(f'{bmi} < 18.5')} * 2.0)"),
        "child_vulnerability_score": f"({_f(d('birth_order') + ' > 3.0')} * 1.5 + {_f(d('birth_interval') + ' < 24.0')} * 1.5)",
        "wealth_education_synergy": f"({wealth} * {edu})",
        "unsafe_water_diarrhea_pathway": f"({_f(f'CAST(water_source AS VARCHAR) IN ({unsafe})')} * {diar})",
        "bmi_anemia_synergy": f"({_f(f'{bmi} < 18.5')} * {anemia})",
        "child_age_x_wealth": f"({cage} * {wealth})",
        "education_x_anc": f"({edu} * {anc})",
        "child_age_log": f"ln({cage} + 1.0)",
        "is_critical_age": crit,
        "mother_bmi_sq": f"pow({bmi}, 2)",
        "wash_age_synergy": f"({san} * {crit})",
        "wealth_edu_anc_triple": f"({wealth} * {edu} * {anc})",
        "mother_age_group": (f"CAST(CASE WHEN {age} IS NULL THEN NULL ELSE "
                             f"LEAST(7, GREATEST(1, floor(({age} - 15.0) / 5.0) + 1)) END AS INTEGER)"),
    }


# Fixed coefficients of the reference-free linear scorer used where an oracle
# is needed (not a fitted model).
SCORER_COEFS = {
    "sanitation_score": 0.15, "anc_adequacy_flag": -0.30, "disease_burden_index": 0.20,
    "maternal_vulnerability_score": 0.12, "child_vulnerability_score": 0.10, "wealth_index": -0.08,
    "mother_education": -0.10, "unsafe_water_diarrhea_pathway": 0.25, "child_age_log": 0.05,
    "mother_bmi_sq": -0.0004, "anc_visits": -0.02, "mother_anemia": 0.06,
}
SCORER = LinearScorer(SCORER_COEFS, intercept=-0.9)
SCORE_FEATURES = list(SCORER_COEFS)

# Ids and display names of the scenario packages.
PACKAGES = [
    Package("wash_package", "Sanitation & Clean Water (WASH)", [
        Override.set("toilet_type", SAFE_TOILET_LEVEL), Override.set("share_toilet", 0.0),
        Override.set("water_source", SAFE_WATER_LEVEL)]),
    Package("maternal_care_package", "Maternal Healthcare & Clinical Support", [
        Override.raise_to("anc_visits", 4.0, 3.0), Override.set("diarrhea_recent", 0.0),
        Override.set("fever_recent", 0.0), Override.lower("mother_anemia", 1.0)]),
    Package("comprehensive_package", "Integrated WASH + Maternal & Social Package", [
        Override.raise_to("anc_visits", 5.0, 3.0), Override.set("diarrhea_recent", 0.0),
        Override.set("fever_recent", 0.0), Override.set("mother_anemia", 0.0),
        Override.raise_to("mother_education", 2.0, 1.0)], base="wash_package"),
]


def package_sql_overrides() -> dict[str, dict[str, str]]:
    """SQL twin of PACKAGES: package -> {column: expression}."""
    wash = {"toilet_type": repr(SAFE_TOILET_LEVEL), "share_toilet": "0.0", "water_source": repr(SAFE_WATER_LEVEL)}
    care = {"anc_visits": "GREATEST(4.0, CAST(anc_visits AS DOUBLE) + 3.0)", "diarrhea_recent": "0.0",
            "fever_recent": "0.0", "mother_anemia": "GREATEST(0.0, CAST(mother_anemia AS DOUBLE) - 1.0)"}
    comp = dict(wash)
    comp.update({"anc_visits": "GREATEST(5.0, CAST(anc_visits AS DOUBLE) + 3.0)", "diarrhea_recent": "0.0",
                 "fever_recent": "0.0", "mother_anemia": "0.0",
                 "mother_education": "GREATEST(2.0, CAST(mother_education AS DOUBLE) + 1.0)"})
    return {"wash_package": wash, "maternal_care_package": care, "comprehensive_package": comp}
