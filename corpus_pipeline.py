"""Training-data pipeline over ``documents``: rules, toxicity, near-duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet in the shared folder of ``spark.checkpoint.dir`` and reads it
again as the next stage's documents. All stages but the last return the columns
of the documents. What the stages learn or compare with (labels, benchmark
items) comes from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from surveylab.llm import decontaminate, quality_rules, queries, simhash, toxicity
from surveylab.llm.common import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base counts and the tokeniser-fertility bands keep."""
    return quality_rules.good_rows(docs, queries.vocabulary("byte_bpe_multi_50k.tiktoken"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic by the model of the labelled documents."""
    return toxicity.ordinary_rows(docs, queries.toxicity_model(spark, sf_dir))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of SimHash near-duplicates."""
    return simhash.one_of_each(docs, shingle=3, max_bits=2)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than 5 % of the words lie in passages of the benchmark."""
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"), size=13)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the piece ids of each document and of their decoded text."""
    return queries.piece_digests(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", token_stage),
]

#: Tokenisers and compression distances are not expressible in SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
