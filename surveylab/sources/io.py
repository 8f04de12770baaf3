"""Sources and sinks (SRC1-SRC6, SNK1-SNK4, SET1-SET2)."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveylab.functions.expr import nan_to_null
from surveylab.session import sf_path


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str = "parquet", header: bool = True, nan_as_null: bool = True) -> DataFrame:
    """SRC2: read a table with a declared schema (no inference on large inputs).

    NaN in floating columns is missing from here on (``nan_as_null=False``
    keeps it, and lets filters on such columns reach the reader).
    """
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.option("header", header)
    df = r.load(path)
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in floating}) if nan_as_null and floating else df


def scan_filtered(spark: SparkSession, path: str, schema=None, cols: Sequence[str] | None = None,
                  filter_col: str | None = None, filter_val=None, obs: Observation | None = None,
                  fmt: str = "parquet") -> DataFrame:
    """SRC1: column-pruned, filtered scan of a large record file.

    With ``obs`` the rows scanned before the filter are counted in the same
    pass (``obs.get["rows_scanned"]`` after an action). Observing before the
    filter stops the filter from reaching the Parquet reader, so it is opt-in.
    """
    df = read_table(spark, path, schema, fmt)
    if cols is not None:
        keep = list(dict.fromkeys(list(cols) + ([filter_col] if filter_col else [])))
        df = df.select(*keep)
    if obs is not None:
        df = df.observe(obs, F.count(F.lit(1)).alias("rows_scanned"))
    if filter_col is not None:
        df = df.filter(F.col(filter_col) == F.lit(filter_val))
    return df


def require_columns(df: DataFrame, cols: Iterable[str], label: str = "table") -> DataFrame:
    """SRC3: fail with the full list of missing columns (plan-time, no job)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{label}: missing required columns {missing}")
    return df


def codebook(df: DataFrame) -> DataFrame:
    """SRC4: one row per variable with its label, read from the schema only.

    The label is the field's ``comment``/``label`` metadata, else empty.
    Size is bounded by the number of columns.
    """
    rows = [(f.name, str(f.metadata.get("label", f.metadata.get("comment", ""))),
             f.dataType.simpleString()) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(
        rows, "variable string, label string, data_type string")


def value_labels(dict_df: DataFrame, variable: str, contains: str | None = None) -> DataFrame:
    """SRC5: code -> label list of one variable, optionally filtered by a word."""
    out = dict_df.filter(F.col("variable") == F.lit(variable))
    if contains:
        out = out.filter(F.lower(F.col("label")).contains(contains.lower()))
    return out.select("code", "label").orderBy("code")


def rename_by_dictionary(df: DataFrame, dictionary: DataFrame | Mapping[str, str],
                         code_col: str = "variable_code", name_col: str = "feature_name") -> DataFrame:
    """SRC6: rename coded columns to readable names via a dictionary.

    The dictionary has one row per column, so collecting the entries that
    match the frame's columns is bounded by the schema width.
    """
    if isinstance(dictionary, DataFrame):
        present = dictionary.filter(F.col(code_col).isin(df.columns)).select(code_col, name_col)
        mapping = {r[0]: r[1] for r in present.collect()}
    else:
        mapping = {k: v for k, v in dictionary.items() if k in df.columns}
    return df.withColumnsRenamed(mapping) if mapping else df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] | None = None, header: bool = True) -> None:
    """SNK1: write a table (no index column, optional partitioning)."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", header)
    w.save(path)


def write_split(df: DataFrame, path: str, split_col: str = "split", fmt: str = "parquet") -> None:
    """SNK2: write train/test of one split as partitions of one table."""
    write_table(df, path, fmt=fmt, partition_by=[split_col])


def save_model(model, path: str) -> None:
    """SNK3: persist a fitted pipeline/model (Spark ML writer, overwrite) or a stacked one."""
    if hasattr(model, "write"):
        model.write().overwrite().save(path)
    else:
        model.save(path)


def load_model(path: str):
    """SNK3: load a saved ``PipelineModel`` or stacked model (which has a table of its parts' names); a damaged one raises."""
    from pyspark.ml import PipelineModel
    from pyspark.sql import SparkSession

    from surveylab.operators.modeling import StackedModel
    spark = SparkSession.active()
    names = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/names")
    stacked = names.getFileSystem(spark._jsc.hadoopConfiguration()).exists(names)
    return StackedModel.load(path) if stacked else PipelineModel.load(path)


def write_run_metadata(df: DataFrame, path: str) -> None:
    """SNK4: run metadata / benchmark rows as JSON records (one file)."""
    df.coalesce(1).write.mode("overwrite").json(path)


def feature_list(spark: SparkSession, names: Sequence[str], model: str = "model") -> DataFrame:
    """SNK4: the ordered feature list of a fitted model as one ``array<string>`` row."""
    return spark.createDataFrame([(model, list(names))], "model string, features array<string>")


def union_all(dfs: Sequence[DataFrame], schema: T.StructType | str | None = None,
              spark: SparkSession | None = None) -> DataFrame:
    """SET1/SET2: row-wise union by column name; empty input -> empty frame."""
    dfs = list(dfs)
    if not dfs:
        if spark is None or schema is None:
            raise ValueError("empty union needs spark and schema")
        return spark.createDataFrame([], schema)
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def load_tables(spark: SparkSession, sf_dir: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """Driver test tables as lazy DataFrames."""
    return {n: spark.read.parquet(sf_path(sf_dir, n)) for n in names}
