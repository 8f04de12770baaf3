"""Session construction and lineage management."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Parquet splits of 128 MB keep one task's input bounded at any scale.
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}

# Runtime SQL settings for wide derived-feature plans: dozens of aliased
# feature expressions above a filter make Catalyst's constraint inference
# grow combinatorially (driver OOM while planning); the filters it would
# infer are already explicit in these plans. Java only interprets methods of
# more than 8000 bytes of code, so that such a plan is several times slower as
# one generated method than operator by operator (in methods that Spark splits).
PLAN_SETTINGS = {
    "spark.sql.constraintPropagation.enabled": "false",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Spark puts up to 64 MB of a shuffle, packed, into one task, whose sort holds
# several times as much. Smaller parts keep the memory of a join's task the
# same at any size of the tables; a session's own smaller figure stays.
PART_MB = 16


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "surveylab", extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the settings every operator assumes.

    On a cluster the master and shuffle partition count come from the
    submitting environment; locally they default to ``local[*]`` and 8.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions is not None:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**PLAN_SETTINGS, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def plan_settings(spark: SparkSession) -> SparkSession:
    """Apply :data:`PLAN_SETTINGS` to a session created elsewhere."""
    for k, v in PLAN_SETTINGS.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    part = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if _size_bytes(spark.conf.get(part, "64m")) > PART_MB * 2 ** 20:
        spark.conf.set(part, f"{PART_MB}m")
    return spark


def _size_bytes(text: str) -> int:
    """Bytes of a size as Spark writes it ('67108864b', '64MB', '16m')."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)i?b?\s*", text.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (distributed) folder there and we use it as is.
    Only a session on one machine (``local[...]``, as in tests) gets a fresh
    scratch folder when nothing is configured; elsewhere that is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="surveylab-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def kept(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder of ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage like a reliable checkpoint (a lost executor re-reads the
    files instead of replaying the plan), but later readers fetch only the
    columns they need, in vectorised form, and Spark knows the table's size.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Truncate lineage between rounds of iterative work (stacking, searches, folds): see :func:`kept`."""
    return kept(df)


def sf_path(sf_dir: str, table: str) -> str:
    return os.path.join(sf_dir, f"{table}.parquet")
