from surveylab.functions.expr import (  # noqa: F401
    flag, clamp, map_values, nan_to_null, uniform, ratio, mean_std_text,
    col_or, as_double, hash_key,
)
