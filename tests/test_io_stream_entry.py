"""Sources/sinks, stream-batch equality and the driver contract."""

import math
import os
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF001
from surveylab.sources import io
from surveylab.session import checkpoint_dir

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _scratch(spark):
    return os.path.join(checkpoint_dir(spark), "tests", uuid.uuid4().hex)


def test_require_columns_lists_all_missing(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match=r"\['b', 'c'\]"):
        io.require_columns(df, ["a", "b", "c"], "child")


def test_codebook_from_metadata_and_rename(spark):
    schema = T.StructType([T.StructField("hw70", T.DoubleType(), True, {"label": "height-for-age z"}),
                           T.StructField("b4", T.IntegerType(), True)])
    df = spark.createDataFrame([(1.0, 1)], schema)
    cb = {r.variable: r.label for r in io.codebook(df).collect()}
    assert cb == {"hw70": "height-for-age z", "b4": ""}
    d = spark.createDataFrame([("hw70", "stunting_haz"), ("zz", "nothing")], "variable_code string, feature_name string")
    assert io.rename_by_dictionary(df, d).columns == ["stunting_haz", "b4"]


def test_write_read_csv_and_split_partitions(spark):
    base = _scratch(spark)
    df = spark.createDataFrame([(1, "train"), (2, "test"), (3, "train")], "id int, split string")
    io.write_table(df, base + "/csv", fmt="csv")
    back = io.read_table(spark, base + "/csv", "id int, split string", fmt="csv")
    assert sorted(r.id for r in back.collect()) == [1, 2, 3]
    io.write_split(df, base + "/split")
    assert sorted(os.listdir(base + "/split"))[:2] == ["_SUCCESS", "split=test"] or \
        {"split=test", "split=train"} <= set(os.listdir(base + "/split"))
    io.write_run_metadata(spark.createDataFrame([("rf", 0.59)], "model string, auc double"), base + "/meta")
    assert spark.read.json(base + "/meta").first().model == "rf"
    empty = io.union_all([], "a int", spark)
    assert empty.count() == 0 and empty.columns == ["a"]


def test_scan_filtered_observes_raw_rows(spark):
    from pyspark.sql import Observation
    obs = Observation("scan")
    df = io.scan_filtered(spark, f"{SF001}/customer.parquet", cols=["c_custkey"], filter_col="c_nationkey",
                          filter_val=3, obs=obs)
    n = df.count()
    assert obs.get["rows_scanned"] == spark.read.parquet(f"{SF001}/customer.parquet").count() and n >= 0


def test_stream_equals_batch(spark):
    import __spark_entry__ as E
    s = {tuple(r) for r in E.queries()["score_stream_events"](spark, SF001).collect()}
    b = {tuple(r) for r in E.queries()["score_requests_batch"](spark, SF001).collect()}
    assert s == b and len(s) > 0


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns == ["c_mktsegment", "rate_pct", "n", "mean_acctbal"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _sorted_rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


_DUCK_TYPE = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
              "float": "FLOAT", "timestamp_ntz": "TIMESTAMP"}


def _sql_names():
    import __spark_entry__ as E
    return sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", _sql_names())
def test_query_matches_duckdb(spark, duck, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, SF001)
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    rel = duck.sql(E.oracle_sql()[name])
    dtypes = dict(zip(rel.columns, [str(t) for t in rel.types]))
    stypes = {f.name: _DUCK_TYPE.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    assert stypes == dtypes
    assert _sorted_rows(df.columns, [tuple(r) for r in df.collect()]) == _sorted_rows(dcols, res.fetchall())


def test_feature_list_round_trip(spark):
    base = _scratch(spark)
    io.write_run_metadata(io.feature_list(spark, ["b", "a", "c"], "rf"), base + "/features")
    r = spark.read.json(base + "/features").first()
    assert r.model == "rf" and list(r.features) == ["b", "a", "c"]


def test_stream_restart_is_exactly_once(spark):
    from surveylab.streaming import score_stream
    base = _scratch(spark)
    schema = spark.read.parquet(f"{SF001}/events.parquet").schema
    src = lambda: (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
                   .option("maxFilesPerTrigger", 1).parquet(SF001))
    tf = lambda d: d.select("event_id", (F.col("value") * 2).alias("v2"))
    for _ in range(2):   # second run resumes from the checkpoint and finds nothing new
        q = score_stream(src(), tf, base + "/out", base + "/ckpt")
        q.awaitTermination()
    out = spark.read.parquet(base + "/out")
    n = spark.read.parquet(f"{SF001}/events.parquet").count()
    assert out.count() == n and out.select("event_id").distinct().count() == n


def test_nan_is_null_from_ingest_on(spark, tmp_path):
    from surveylab.sources.io import read_table
    spark.createDataFrame([(1, float("nan")), (2, 3.0)], "id int, x double").write.parquet(str(tmp_path / "t"))
    assert read_table(spark, str(tmp_path / "t")).filter("x is null").count() == 1
    assert read_table(spark, str(tmp_path / "t"), nan_as_null=False).filter("x is null").count() == 0
