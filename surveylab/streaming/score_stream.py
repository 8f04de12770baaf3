"""STR1: score records as they arrive (stateless Structured Streaming).

The batch functions (``build_features``, scoring, risk index, tiers) are
row-local projections, so the same code runs unchanged on a streaming
DataFrame: no state store, no watermark. Output is appended to a file sink
whose checkpoint lives in the shared checkpoint folder, so a restarted query
resumes exactly where it stopped (exactly-once file sink).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from surveylab.session import checkpoint_dir


def score_stream(stream_df: DataFrame, transform: Callable[[DataFrame], DataFrame], sink_path: str,
                 checkpoint_location: str, fmt: str = "parquet", available_now: bool = True,
                 processing_time: str | None = None) -> StreamingQuery:
    """Start ``transform(stream_df)`` appending to ``sink_path``.

    ``available_now`` processes everything present and stops (batch-like
    runs, tests); otherwise a processing-time trigger keeps it running.
    """
    out = transform(stream_df)
    w = (out.writeStream.format(fmt).outputMode("append")
         .option("path", sink_path).option("checkpointLocation", checkpoint_location))
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def run_to_table(spark: SparkSession, source_path: str, schema, transform: Callable[[DataFrame], DataFrame],
                 name: str, fmt: str = "parquet", max_files_per_trigger: int = 1,
                 file_filter: str | None = None) -> DataFrame:
    """Run a stream over ``source_path`` to completion and return the sink as a table.

    Sink and checkpoint get a fresh folder under the shared checkpoint dir.
    """
    base = os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex}")
    r = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files_per_trigger)
    if file_filter:
        r = r.option("pathGlobFilter", file_filter)
    src = r.load(source_path)
    q = score_stream(src, transform, os.path.join(base, "out"), os.path.join(base, "checkpoint"), fmt="parquet")
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.parquet(os.path.join(base, "out"))
