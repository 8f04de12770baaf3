"""Shared helpers of the text operators: row maps over Arrow batches, shared-folder tables, file loading."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from surveylab.session import checkpoint_dir, sf_path

#: Texts are handled in slices of at most about this many characters, so that a
#: batch of long documents never needs one huge output buffer.
SLICE_BYTES = 4 << 20

_INPUT = "__llm_in_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(sf_path(sf_dir, name))


def vocabulary_bytes(path: str) -> bytes:
    """A vocabulary file, read on the driver; operators ship it to the tasks (a few MB at most)."""
    with open(path, "rb") as f:
        return f.read()


def slices(batch: pa.RecordBatch, text_index: int, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into consecutive slices of bounded text size (a longer single text is a slice of its own)."""
    col = batch.column(text_index)
    if batch.num_rows == 0:
        return
    if col.nbytes <= max_bytes:
        yield batch
        return
    length = pc.list_value_length if pa.types.is_list(col.type) else pc.binary_length
    width = 4 if pa.types.is_list(col.type) else 1
    sizes = [width * n for n in pc.fill_null(length(col), 0).to_pylist()]
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start, batch.num_rows - start)


def map_columns(df: DataFrame, inputs: Sequence[str], fields: Iterable[StructField],
                fn: Callable[[], Callable[..., Sequence[pa.Array] | tuple]], keep: Sequence[str] | None = None,
                bound_by: int = 0) -> DataFrame:
    """Append columns computed from ``inputs`` by Python over Arrow batches.

    ``fn`` is called once per task and returns the function that maps the input
    arrays of a batch to one array per field. ``keep`` names the columns of
    ``df`` that stay (default: all); a kept column with the name of a new field
    is replaced. Batches are cut by the size of input number ``bound_by``.
    """
    fields = list(fields)
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    names = [f"{_INPUT}{i}" for i in range(len(inputs))]
    src = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(n) for c, n in zip(inputs, names)])
    kept_fields = [src.schema[c] for c in kept]
    schema = StructType([StructField(f.name, f.dataType, True) for f in kept_fields] + fields)
    at, out_names = len(kept), kept + [f.name for f in fields]

    def run(batches):
        apply = fn()
        for whole in batches:
            for batch in slices(whole, at + bound_by):
                cols = batch.columns
                made = apply(*cols[at:])
                yield pa.RecordBatch.from_arrays([*cols[:at], *made], names=out_names)

    return src.mapInArrow(run, schema)


def texts(col: pa.Array) -> list[str]:
    """The texts of an Arrow column, null as empty."""
    return [x or "" for x in col.to_pylist()]


def text_bytes(col: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8, null as empty."""
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def stored(df: DataFrame, name: str = "llm") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder of ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage like ``checkpoint()`` does, but keeps column statistics, so
    that Spark sizes later joins by what was written. Survives lost executors.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cached_in_task(key, build: Callable[[], object], _kept: dict = {}):  # noqa: B006
    """An object kept between the tasks of a reused Python worker: the last two, so that the tables of one stage
    do not stay in memory in the next ones."""
    if key not in _kept:
        while len(_kept) >= 2:
            del _kept[next(iter(_kept))]
        _kept[key] = build()
    return _kept[key]
