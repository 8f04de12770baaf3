"""Small documents with every odd case, and plain versions of what the operators compute."""

import random

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()),
                     StructField("lang", StringType()), StructField("source", StringType()),
                     StructField("n_chars", LongType())])
#: Columns that clash with names that operators use.
CLASHES = ["fp", "ids", "label", "score", "kept", "span", "hits", "size", "start", "n_tokens", "component_id", "share",
           "statistics", "shard", "features", "predicted", "text_hash", "spots", "part", "guest", "n_rows", "hash"]


def texts(seed=7, n=40):
    rng = random.Random(seed)
    vocab = ["alpha", "beta", "gamma", "delta", "Epsilon", "zeta,", "eta.", "thé", "иота", "漢字", "x1", "and", "of", "the"]
    out = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 120))) for _ in range(n)]
    base = " ".join(rng.choice(vocab) for _ in range(200))
    out += [base] * 5 + [base + " tail", base.replace("alpha", "Alpha"), base + "\n" + base]
    out += [None, "", " \n\t ", "a", "A b", "😀 \x00 end", "é" * 3000, "ab" * 20000, "word " * 5000, "#$% ***\n#$% ***\n\n"]
    return out


def documents(spark, rows=None, clash=False, repeats=True):
    """Documents with null ids, repeated rows and odd texts."""
    rows = texts() if rows is None else rows
    data = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(rows)]
    if repeats:
        data += [data[0], data[min(3, len(data) - 1)], (None, "null id text here", None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("x") for c in CLASHES}) if clash else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))
