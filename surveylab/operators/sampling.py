"""Stratified splits, folds and class weights (SPL1-SPL3, IMB1).

Row order inside each class is md5(seed:key) (then the key), identical in
any engine and independent of partitioning. The per-class rank is built in
two levels so no window ever holds a whole class: rows are bucketed by
their draw (a monotone function of it), ranked inside (class, bucket), and
shifted by the rows of lower buckets taken from a small counts table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveylab.functions.expr import is_missing, uniform
from surveylab.session import cut_lineage


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def class_rank(df: DataFrame, label: str, key, seed: int = 42, buckets: int | None = None,
               extra: Column | None = None, group: Sequence[str] = ()) -> DataFrame:
    """Adds ``__u`` (draw), ``class_n`` and ``class_rank`` (1-based, by draw then key).

    ``group`` adds outer grouping columns (e.g. a repeat number) to the class.
    ``buckets`` defaults to one per ~1M rows (at least 64), from one count.
    Rows with a NULL label are a class of their own.
    """
    keys = _keys(key)
    parts = list(group) + ([extra] if extra is not None else []) + keys
    strata = list(group) + [label]
    d = df.withColumn("__u", uniform(seed, *parts))
    if buckets is None:
        n = df.select(*keys).count()
        buckets = max(64, n // 1_000_000 + 1)
    d = d.withColumn("__b", F.least(F.floor(F.col("__u") * buckets), F.lit(buckets - 1)).cast("int"))
    per_bucket = d.groupBy(*strata, "__b").agg(F.count(F.lit(1)).alias("__nb"))
    wcls = Window.partitionBy(*strata)
    offsets = (per_bucket
               .withColumn("__off", F.coalesce(F.sum("__nb").over(
                   wcls.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .withColumn("class_n", F.sum("__nb").over(wcls))
               .select(*[F.col(s).alias(f"__s{i}") for i, s in enumerate(strata)], F.col("__b").alias("__ob"),
                       "__off", "class_n"))
    same = F.col("__b") == F.col("__ob")
    for i, s in enumerate(strata):
        same = same & F.col(s).eqNullSafe(F.col(f"__s{i}"))
    inner = Window.partitionBy(*strata, "__b").orderBy("__u", *keys)
    return (d.withColumn("__r", F.row_number().over(inner))
            .join(offsets, same, how="inner").drop("__ob", *[f"__s{i}" for i in range(len(strata))])
            .withColumn("class_rank", F.col("__off") + F.col("__r"))
            .drop("__b", "__r", "__off"))


def stratified_split(df: DataFrame, label: str, key, test: float = 0.2, seed: int = 42,
                     exact: bool = True, buckets: int | None = None) -> DataFrame:
    """SPL1: adds ``split`` in {'train','test'}; exactly round(test·n_c) test rows per class.

    ``exact=False`` is the large-data mode: test iff draw < test (no ranking,
    no shuffle; counts exact only in expectation).
    """
    if not exact:
        return df.withColumn("split", F.when(uniform(seed, *_keys(key)) < test, "test").otherwise("train"))
    r = class_rank(df, label, key, seed, buckets)
    n_test = F.floor(F.col("class_n") * F.lit(test) + 0.5)
    return (r.withColumn("split", F.when(F.col("class_rank") <= n_test, "test").otherwise("train"))
            .drop("__u", "class_n", "class_rank"))


def stratified_folds(df: DataFrame, label: str, key, k: int = 5, seed: int = 42,
                     buckets: int | None = None) -> DataFrame:
    """SPL2: adds ``fold`` in 0..k-1; per class fold sizes differ by at most one."""
    r = class_rank(df, label, key, seed, buckets)
    return (r.withColumn("fold", ((F.col("class_rank") - 1) % k).cast("int"))
            .drop("__u", "class_n", "class_rank"))


def repeated_folds(df: DataFrame, label: str, key, k: int = 5, repeats: int = 3, seed: int = 42,
                   buckets: int | None = None) -> DataFrame:
    """SPL3: (repeat, fold) for each row and repeat; draw = md5(seed:repeat:key)."""
    rep = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    r = class_rank(rep, label, key, seed, buckets, group=["repeat"])
    return (r.withColumn("fold", ((F.col("class_rank") - 1) % k).cast("int"))
            .drop("__u", "class_n", "class_rank"))


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """IMB1: balanced weight n / (n_classes · n_c) attached to every row.

    One count per label value reaches the driver and the weights travel as
    literals: the rows are not moved. NULL labels get a NULL weight.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).agg(F.count(F.lit(1))).collect()}
    n, k = sum(counts.values()), len([c for c in counts if c is not None])
    w = F.lit(None).cast("double")
    for value, m in counts.items():
        if value is not None:
            w = F.when(F.col(label) == F.lit(value), F.lit(n / (k * m))).otherwise(w)
    return df.withColumn(out, w)


def _refuse_missing(df: DataFrame, features: Sequence[str]) -> None:
    """Distances and synthetic rows need complete rows: impute before oversampling."""
    seen = df.agg(*[F.max(is_missing(df, c)).alias(c) for c in features]).first()
    if bad := [c for c in features if seen[c]]:
        raise ValueError(f"impute before oversampling; missing values in {bad}")


# ---------------------------------------------------------------- IMB3 / IMB4
def _neighbours(queries: DataFrame, targets: DataFrame, q_key: str, t_key: str, feats, k: int, seed: int,
                pivots: int | None, search: str) -> DataFrame:
    """k nearest targets: ``search`` is 'exact' or 'hashed' (approximate, by an index). Searched once, read several times."""
    if search == "hashed":
        from surveylab.operators.hash_index import knn_hashed
        return cut_lineage(knn_hashed(queries, targets, q_key, t_key, feats, k=k, seed=seed))
    if search != "exact":
        raise ValueError(f"unknown search {search}")
    from surveylab.operators.neighbors import knn
    return cut_lineage(knn(queries, targets, q_key, t_key, feats, k=k, exclude_self=True, pivots=pivots, seed=seed))


def _once(df: DataFrame, *cols: str) -> DataFrame:
    """The columns that oversampling reads, computed once: counts, neighbours and rows are separate passes."""
    return cut_lineage(df.select(*dict.fromkeys(cols)))


def _interpolate(minority: DataFrame, quotas: DataFrame, key: str, features, k: int, seed: int,
                 pivots: int | None = None, search: str = "exact") -> DataFrame:
    """Synthetic rows: for each minority row and j in 1..quota, a point on the
    segment to one of its k minority neighbours (md5-seeded choice and gap)."""
    feats = list(features)
    nn = _neighbours(minority, minority.withColumnRenamed(key, "__nb"), key, "__nb", feats, k, seed, pivots, search)
    n_nb = nn.groupBy(key).agg(F.count(F.lit(1)).alias("__nn"))
    q = (quotas.filter(F.col("quota") > 0).join(n_nb, key, "inner")
         .withColumn("syn_index", F.explode(F.sequence(F.lit(1), F.col("quota"))))
         .withColumn("rank", (F.floor(uniform(seed, key, F.col("syn_index"), F.lit("nb")) * F.col("__nn")) + 1).cast("int"))
         .withColumn("__gap", uniform(seed, key, F.col("syn_index"), F.lit("gap"))))
    q = q.join(nn.select(key, "__nb", "rank"), [key, "rank"], "inner")
    x = minority.select(key, *[F.col(c).cast("double").alias(c) for c in feats])
    nb = minority.select(F.col(key).alias("__nb"), *[F.col(c).cast("double").alias(f"__n_{c}") for c in feats])
    j = q.join(x, key).join(nb, "__nb")
    return j.select(key, "syn_index", *[(F.col(c) + F.col("__gap") * (F.col(f"__n_{c}") - F.col(c))).alias(c)
                                        for c in feats])


def _with_synthetic(df: DataFrame, syn: DataFrame, label: str, key: str, features, minority) -> DataFrame:
    feats = list(features)
    orig = df.select(key, *[F.col(c).cast("double").alias(c) for c in feats], F.col(label),
                     F.lit(0).alias("syn_index"), F.lit(False).alias("is_synthetic"))
    s = syn.select(key, *feats, F.lit(minority).cast(df.schema[label].dataType).alias(label), "syn_index",
                   F.lit(True).alias("is_synthetic"))
    return orig.unionByName(s)


def smote(df: DataFrame, label: str, features, key: str, k: int = 5, seed: int = 42,
          minority=1, pivots: int | None = None, search: str = "exact") -> DataFrame:
    """IMB3: oversample the minority class until both classes have equal counts.

    Each minority row gets floor(G / n_min) synthetic rows, and the first
    G mod n_min rows in md5(seed:key) order one more (G = n_maj - n_min),
    so the total is exact. Each synthetic row lies on the segment between
    its parent and one of the parent's k nearest minority neighbours
    (``search``: exact, or by a hash index; no cross join). Output: original rows plus synthetic
    rows (``is_synthetic``, ``syn_index``; ``key`` = parent key).
    """
    df = _once(df, key, label, *features)
    _refuse_missing(df, features)
    y = F.col(label)
    n_min = df.filter(y == minority).count()
    n_maj = df.filter(y != minority).count()
    G = n_maj - n_min
    if G <= 0 or n_min < 2:
        return _with_synthetic(df, df.limit(0).select(key, *features, F.lit(0).alias("syn_index")), label, key,
                               features, minority)
    minority_df = df.filter(y == minority)
    base, rem = divmod(G, n_min)
    ranked = class_rank(minority_df.select(key, label), label, key, seed)
    quotas = ranked.select(key, (F.lit(base) + (F.col("class_rank") <= rem).cast("int")).alias("quota"))
    syn = _interpolate(minority_df, quotas, key, features, k, seed, pivots, search)
    return _with_synthetic(df, syn, label, key, features, minority)


def adasyn(df: DataFrame, label: str, features, key: str, k: int = 5, seed: int = 42,
           minority=1, pivots: int | None = None, search: str = "exact") -> DataFrame:
    """IMB4: ADASYN - quota per minority row proportional to the share of
    majority rows among its k nearest neighbours in all data.

    quota_i = rint(r_i / Σr · G) (G = n_maj - n_min), then interpolation as in
    SMOTE. With no majority neighbour anywhere nothing is synthesised.
    """
    df = _once(df, key, label, *features)
    _refuse_missing(df, features)
    y = F.col(label)
    n_min = df.filter(y == minority).count()
    n_maj = df.filter(y != minority).count()
    G = n_maj - n_min
    minority_df = df.filter(y == minority)
    empty = df.limit(0).select(key, *features, F.lit(0).alias("syn_index"))
    if G <= 0 or n_min < 2:
        return _with_synthetic(df, empty, label, key, features, minority)
    nn = _neighbours(minority_df, df.withColumnRenamed(key, "__t"), key, "__t", list(features), k, seed, pivots, search)
    lab = df.select(F.col(key).alias("__t"), (F.col(label) != minority).cast("double").alias("__maj"))
    r = nn.join(lab, "__t").groupBy(key).agg((F.sum("__maj") / k).alias("__r"))
    total = r.select(F.sum("__r")).first()[0] or 0.0
    if total <= 0:
        return _with_synthetic(df, empty, label, key, features, minority)
    quotas = r.select(key, F.rint(F.col("__r") / F.lit(total) * F.lit(G)).cast("int").alias("quota"))
    syn = _interpolate(minority_df, quotas, key, features, k, seed, pivots, search)
    return _with_synthetic(df, syn, label, key, features, minority)
