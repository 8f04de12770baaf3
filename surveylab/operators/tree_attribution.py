"""Exact attribution of tree models (EXP8).

For one row x and one background row b, a leaf counts in a coalition game with
few players: the features on its path whose condition x meets and b doesn't
(they must come from x), and those that b meets and x doesn't (they must come
from b). A leaf with a condition that neither meets is out of reach; features
that both meet play no part. With n1 and n0 such features, the Shapley value
of the leaf's value v is ``v (n1-1)! n0! / (n1+n0)!`` for each of the first
and ``-v n1! (n0-1)! / (n1+n0)!`` for each of the second, so that the sum over
all leaves, trees and background rows is exact and costs a pass over the
leaves instead of one scoring for every coalition.

The fitted trees are read as node tables, merged to one interval for each
feature of a leaf's path. The background is reduced to the numbers of rows
with the same conditions met, leaf by leaf. Both are bounded by the model
(trees x leaves) and the background, and go to the rows; a batch of rows
passes each leaf as arrays.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveylab.session import checkpoint_dir, kept

#: Leaves that one task goes through for its rows, and most tasks.
TASK_LEAVES, MOST_TASKS = 20_000_000, 512
#: Spark's tree learners: the trees' share in the model's output.
_KINDS = {"DecisionTreeClassificationModel": "one", "RandomForestClassificationModel": "mean",
          "GBTClassificationModel": "sum"}


def _split_pipeline(model: PipelineModel, features: Sequence[str]):
    """(stages that prepare the features, the tree model, the features in the order of its vector)."""
    tree = model.stages[-1]
    if type(tree).__name__ not in _KINDS:
        raise ValueError(f"not a tree model: {type(tree).__name__}")
    assembler = next((s for s in model.stages if type(s).__name__ == "VectorAssembler"
                      and s.getOutputCol() == tree.getFeaturesCol()), None)
    if assembler is None:
        raise ValueError("the trees must take their features straight from a vector assembler")
    order = list(assembler.getInputCols())
    if sorted(order) != sorted(features):
        raise ValueError(f"the model has other features: {order}")
    before = model.stages[:model.stages.index(assembler)]
    return PipelineModel(list(before)), tree, order


def leaves(spark: SparkSession, tree) -> DataFrame:
    """(tree, leaf, value, features, above, upto) of every leaf of a fitted tree model: its share in the output, and for
    each feature of its path the interval above < x <= upto (upto NaN: no bound, as NaN comes last).

    The output is the probability of class 1 of a tree or forest, and the raw
    margin of boosted trees. Reads the model's saved node tables.
    """
    kind = _KINDS[type(tree).__name__]
    path = f"{checkpoint_dir(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
    tree.save(path)
    nodes = spark.read.parquet(f"{path}/data")
    nodes = (nodes.select(F.lit(0).alias("treeID"), F.struct("*").alias("nodeData")) if kind == "one" else nodes)
    by: dict[int, dict[int, tuple]] = {}
    for r in nodes.select("treeID", "nodeData.*").collect():  # as many rows as the model has nodes
        by.setdefault(r["treeID"], {})[r["id"]] = r
    n_trees = len(by)
    weights = tree.treeWeights if kind == "sum" else [1.0 / n_trees] * n_trees
    out = []
    for t, own in sorted(by.items()):
        stack = [(0, {})]
        while stack:
            at, met = stack.pop()
            r = own[at]
            if r["leftChild"] < 0:
                stats = r["impurityStats"]
                value = r["prediction"] if kind == "sum" else (stats[1] / sum(stats) if sum(stats) else 0.0)
                names = sorted(met)
                out.append((t, len(out), float(weights[t] * value), names, [met[f][0] for f in names],
                            [met[f][1] for f in names]))
                continue
            f, bounds, categories = r["split"]["featureIndex"], r["split"]["leftCategoriesOrThreshold"], r["split"]["numCategories"]
            if categories != -1:
                raise ValueError("splits by categories are not supported")
            lo, hi = met.get(f, (float("-inf"), float("nan")))
            stack.append((r["leftChild"], {**met, f: (lo, bounds[0] if math.isnan(hi) else min(hi, bounds[0]))}))
            stack.append((r["rightChild"], {**met, f: (max(lo, bounds[0]), hi)}))
    return spark.createDataFrame(
        out, "tree int, leaf int, value double, features array<int>, above array<double>, upto array<double>")


#: Bits of the path's features whose condition the row's vector ``v`` meets.
_MET = """aggregate(sequence(0, size(features)), 0L, (m, i) -> if(i < size(features)
    and v[features[least(i, size(features) - 1)]] > above[least(i, size(features) - 1)]
    and v[features[least(i, size(features) - 1)]] <= upto[least(i, size(features) - 1)], m | shiftleft(1L, i), m))"""


def _placed(df: DataFrame, cols: list, order: list[str], prep: PipelineModel, paths: DataFrame) -> DataFrame:
    """The rows of ``df`` beside every leaf, with the bits of the conditions met."""
    vector = F.array(*[F.col(f"`{c}`").cast("double") for c in order])
    rows = prep.transform(df).select(*cols, vector.alias("v"))
    trees = paths.agg(F.max("tree")).first()[0]
    rows = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees))))
    # As many rows as the model has leaves.
    return rows.join(F.broadcast(paths), "tree").withColumn("met", F.expr(_MET)).drop("v", "above", "upto", "tree")


def _shares(known: list[tuple], dims: int):
    """Per row and feature, the sum over all leaves of the feature's share in the leaf's value; the background rows with the
    same conditions met count together, and so do the rows of a batch."""
    fact = math.factorial
    most = max(2, dims) + 1
    # By n1 and n0: the weight of a feature that must come from the row, and of one that must come from the background.
    own, other = ([[fact(a - mine) * fact(c - 1 + mine) / fact(a + c) if (a if mine else c) else 0.0 for c in range(most)]
                   for a in range(most)] for mine in (1, 0))

    def run(batches):
        from_row, from_background = np.array(own), np.array(other)
        leaves_ = [(fs, lo, hi, value, np.array(met, "i8"), np.array(n, "f8")) for fs, lo, hi, value, met, n in known]
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("v").flatten()
            x = flat.to_numpy(zero_copy_only=False).reshape(-1, dims).T.copy()
            nan = np.isnan(x) & flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, dims).T
            total = np.zeros((dims, batch.num_rows))
            for fs, lo, hi, value, others, n in leaves_:
                met = np.zeros(batch.num_rows, "i8")
                for i, f in enumerate(fs):
                    # NaN comes last
                    inside = (x[f] > lo[i]) | nan[f] if math.isnan(hi[i]) else (x[f] > lo[i]) & (x[f] <= hi[i])
                    met |= inside.astype("i8") << i
                kinds, at = np.unique(met, return_inverse=True)
                m, o = kinds[:, None], others[None, :]
                mine, theirs = m & ~o, o & ~m
                bits = np.arange(len(fs))[:, None, None]
                mine, theirs = (mine >> bits & 1).astype(bool), (theirs >> bits & 1).astype(bool)
                n1, n0 = mine.sum(0), theirs.sum(0)
                live = ((m | o) == (1 << len(fs)) - 1) * n
                part = value * (mine * (from_row[n1, n0] * live) - theirs * (from_background[n1, n0] * live)).sum(2)
                for i, f in enumerate(fs):
                    total[f] += part[i][at]
            take = np.repeat(np.arange(batch.num_rows), dims)
            codes = np.tile(np.arange(dims, dtype="i4"), batch.num_rows)
            keys = [batch.column(c).take(pa.array(take)) for c in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(codes), pa.array(total.T.ravel())],
                                             names=[*batch.schema.names[:-1], "j", "d"])

    return run


def attribute_trees(df: DataFrame, key, features: Sequence[str], model: PipelineModel, background: DataFrame) -> DataFrame:
    """EXP8: exact Shapley values of a fitted tree model against a background (a bounded sample).

    Output long (key, feature_code, value, shap_value) with a row for every
    feature of the model; the values of a row add up to its output less the mean
    output of the background (class-1 probability; raw margin for boosted
    trees). Missing values count as what the model's own imputer makes of them.
    """
    keys = [key] if isinstance(key, str) else list(key)
    prep, tree, order = _split_pipeline(model, features)
    if any(c in keys for c in order):
        raise ValueError("a key is a feature")
    paths = leaves(df.sparkSession, tree)
    n = background.count()
    if not n:
        raise ValueError("the background has no rows")
    seen = (_placed(background, [], order, prep, paths).groupBy("leaf", "met").agg(F.count("*").alias("n"))
            .groupBy("leaf").agg(F.collect_list(F.struct("met", "n")).alias("others")))
    # As many rows as the model has leaves; they travel with the function below.
    known = [(r["features"], r["above"], r["upto"], r["value"], [o["met"] for o in r["others"]], [o["n"] for o in r["others"]])
             for r in paths.where("value <> 0").join(seen, "leaf").orderBy("leaf").collect()]
    vector = F.array(*[F.col(f"`{c}`").cast("double") for c in order])
    rows = prep.transform(df).select(*keys, vector.alias("v"))
    tasks = int(min(MOST_TASKS, max(1, df.count() * len(known) // TASK_LEAVES)))
    # The few bytes of the rows are much work: they are dealt by it.
    reached = rows.repartition(tasks).mapInArrow(_shares(known, len(order)), T.StructType(
        [*rows.schema.fields[:-1], T.StructField("j", T.IntegerType()), T.StructField("d", T.DoubleType())]))
    # Kept: the pass is a job of its own, as the plans of registered queries hold no Python.
    sums = kept(reached.groupBy(*keys, "j").agg((F.sum("d") / F.lit(float(n))).alias("shap_value")))
    every = df.select(*keys, F.posexplode(F.array(*[F.struct(F.lit(c).alias("feature_code"),
                                                             F.col(f"`{c}`").cast("double").alias("value"))
                                                    for c in order])).alias("j", "x")).select(*keys, "j", "x.*")
    same = [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in [*keys, "j"]]
    joined = every.alias("l")
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return joined.join(sums.alias("r"), cond, "left").select(
        *[F.col(f"l.`{k}`") for k in keys], "feature_code", "value", F.coalesce("shap_value", F.lit(0.0)).alias("shap_value"))
