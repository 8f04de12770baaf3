"""Column-expression helpers (SCL1-SCL6).

All helpers return ``Column`` objects built from built-in functions so they
stay inside whole-stage code generation; none is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TWO_POW_32 = 4294967296.0


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(cond: Column) -> Column:
    """Boolean condition -> 0.0/1.0 with NULL treated as false.

    pandas compares NaN as False before casting; Spark's NULL comparison is
    NULL, so every derived flag goes through this helper.
    """
    return F.coalesce(cond, F.lit(False)).cast("double")


def clamp(c, lo, hi) -> Column:
    """``min(hi, max(lo, c))`` that keeps NULL as NULL (greatest/least skip NULL)."""
    c = _c(c)
    return F.when(c.isNotNull(), F.least(F.lit(hi), F.greatest(F.lit(lo), c)))


def map_values(c, mapping: Mapping, keep_unmapped: bool = True) -> Column:
    """Dictionary recode. Unmapped values pass through or become NULL."""
    c = _c(c)
    if not mapping:
        return c if keep_unmapped else F.lit(None)
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    looked = F.try_element_at(m, c)
    return F.coalesce(looked, c) if keep_unmapped else looked


def nan_to_null(c) -> Column:
    """NaN -> NULL for floating columns (Spark treats NaN as a value)."""
    c = _c(c)
    return F.when(~F.isnan(c), c)


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN in a floating column."""
    null = F.col(name).isNull()
    return null | F.isnan(F.col(name)) if df.schema[name].dataType.typeName() in ("double", "float") else null


def as_double(df: DataFrame, name: str) -> Column:
    dt = df.schema[name].dataType.typeName()
    col = F.col(name).cast("double")
    return nan_to_null(col) if dt in ("double", "float") else col


def hash_key(*parts) -> Column:
    """Stable text key 'p1:p2:...' used as the md5 input of seeded draws."""
    return F.concat_ws(":", *[F.lit(str(p)) if isinstance(p, int) else _c(p).cast("string")
                              for p in parts])


def uniform(seed: int, *key_parts) -> Column:
    """Deterministic u in [0, 1) from md5(seed:key...).

    Independent of partitioning (unlike ``rand(seed)``) and reproducible in
    any SQL engine: first 8 hex digits of md5 as an unsigned int / 2^32.
    """
    parts = [F.lit(str(seed))] + [F.lit(str(p)) if isinstance(p, int) else _c(p).cast("string")
                                  for p in key_parts]
    h = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(_TWO_POW_32)


def round_half_away(c, dp: int) -> Column:
    """Round half away from zero with plain arithmetic (codegen-friendly).

    ``F.round`` goes through BigDecimal per value; for presentation columns
    of long attribution tables this arithmetic form is several times cheaper
    and agrees with it except on values within 1 ulp of a .5 boundary.
    """
    c = _c(c)
    p = float(10 ** dp)
    return F.signum(c) * F.floor(F.abs(c) * p + 0.5) / p


def ratio(num, den) -> Column:
    """num / den with 0/0 and x/0 -> NULL (ANSI-safe)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def mean_std_text(mean, std, dp: int = 4) -> Column:
    """'m ± s' text as printed in model comparisons."""
    return F.format_string(f"%.{dp}f ± %.{dp}f", _c(mean), _c(std))


def col_or(df: DataFrame, name: str, default) -> Column:
    """PRJ5: the column if present, else a literal default (plan-time branch)."""
    return F.col(name) if name in df.columns else F.lit(default)
