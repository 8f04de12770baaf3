"""Labelled rows for the classifiers: which may be learnt from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rows of each class that a classifier is fitted on.
MOST_LABELLED = 10_000


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, doc_id: str = "doc_id",
           text: str = "text", most: int = MOST_LABELLED) -> tuple[DataFrame, dict[int, int]]:
    """((doc_id, text, label) of at most ``most`` rows of each class outside the held-out fold, and the number of
    labelled ids of each class). Of repeated labels of an id the largest counts; null labels don't. Of repeated rows of
    an id that with the least hash of the text is taken."""
    known = (labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & (fold(doc_id, folds) != held_out))
             .groupBy(F.col(doc_id).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("label")))
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    parts = [known.where(F.col("label") == c).orderBy(F.xxhash64("__id"), "__id").limit(most) for c in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # 2 * most rows of an id and a number
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # A minimum is taken before the shuffle, so that an id with many rows sends one a task.
    first = (texts.join(chosen, F.col("doc_id") == F.col("__id")).groupBy("__id", "label")
             .agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "doc_id")).alias("row")))
    return first.select("row.doc_id", "row.text", "label"), counts
