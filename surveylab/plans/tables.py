"""The driver tables and the roles they play for the survey operators.

child = lineitem, mother = orders, household = customer, area = nation
(see FIXTURES §8). Sentinel ranges are chosen so the clean tables get NULLs
on both sides of the imputation thresholds: ``c_acctbal < 0`` (about 8 %),
``p_size`` 41-50 (about 20 %), ``l_quantity`` 49-50 (about 4 %).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveylab.session import sf_path

# Fixed values of this repo's role mapping (not from the reference).
SENTINELS = {
    "l_quantity": (49.0, 50.0),
    "c_acctbal": (-1000.0, -0.005),
    "p_size": (41, 50),
}
LABEL_FLAG = "R"          # child label: l_returnflag = 'R'
HOUSEHOLD_DIV = 100        # composite household key (custkey div 100, custkey % 100)
# (l_orderkey, l_linenumber) repeats in the driver data; with part and
# supplier the child key is unique.
CHILD_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(sf_path(sf_dir, name))


def household_key(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """Derive the two-part household key (cluster, number) from one id."""
    return df.withColumns({f"{prefix}_cluster": F.floor(F.col(key) / HOUSEHOLD_DIV).cast("long"),
                           f"{prefix}_number": (F.col(key) % HOUSEHOLD_DIV).cast("long")})


def sql_household_key(key: str, prefix: str) -> str:
    return (f"CAST(floor({key} / {HOUSEHOLD_DIV}) AS BIGINT) AS {prefix}_cluster, "
            f"CAST({key} % {HOUSEHOLD_DIV} AS BIGINT) AS {prefix}_number")


def sql_uniform(seed: int, key_cols, extra: str | None = None) -> str:
    """DuckDB text of :func:`surveylab.functions.expr.uniform`."""
    parts = [f"'{seed}'"] + [f"CAST({c} AS VARCHAR)" for c in key_cols]
    if extra is not None:
        parts.append(extra)
    inner = " || ':' || ".join(parts)
    return f"(('0x' || substr(md5({inner}), 1, 8))::BIGINT / 4294967296.0)"
