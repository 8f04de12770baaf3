"""Feature attribution (EXP1-EXP7; exact attribution of tree models, EXP8, is in ``tree_attribution``).

EXP1 is a sampled-permutation Shapley estimate: the coalition points of all
rows and permutations (each distinct one once) meet the whole background in
blocks, are scored in one batch, and the marginal contributions are summed with
one ``groupBy``. For every (row, permutation) the contributions telescope, so
the attributions sum to score(x) − mean background score.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveylab.functions.expr import round_half_away, uniform
from surveylab.session import kept

NEUTRAL_EPS = 0.01  # fixed value: |contribution| above this is 'increases'/'reduces'


def _keys(key):
    return [key] if isinstance(key, str) else list(key)


def base_value(background: DataFrame, scorer) -> DataFrame:
    """EXP3: mean score on the background (one row)."""
    return scorer.score(background).agg(F.avg(scorer.prob_col).alias("base_value"))


def attribute_linear(df: DataFrame, key, features: Sequence[str], scorer, background: DataFrame,
                     wide: bool = False) -> DataFrame:
    """EXP2: exact attribution of a linear margin, β·(x − background mean).

    Output long (key, feature_code, value, shap_value); contributions sum to
    margin(x) − mean background margin. ``wide=True`` keeps one row per key
    with an ``attribution`` array of those structs (no explode), which
    :func:`explain_arrays` ranks without any shuffle.
    """
    keys = _keys(key)
    means = background.agg(*[F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c)
                             for c in features]).first()
    structs = [F.struct(F.lit(c).alias("feature_code"), F.col(c).cast("double").alias("value"),
                        (F.lit(float(scorer.coefs.get(c, 0.0))) *
                         (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(float(means[c] or 0.0)))).alias("shap_value"))
               for c in features]
    if wide:
        return df.select(*keys, F.array(*structs).alias("attribution"))
    return df.select(*keys, F.explode(F.array(*structs)).alias("a")).select(*keys, "a.*")


#: Background values that travel together as one array, points that meet them in one part, pairs to score in one task, most tasks.
BACKGROUND_BLOCK, POINTS_PART, TASK_PAIRS, MOST_TASKS = 128, 16384, 500_000, 512
_GROUPS = 8  # parts of the background that meet all sets


def attribute(df: DataFrame, key, features: Sequence[str], scorer, background: DataFrame,
              permutations: int = 3, seed: int = 42) -> DataFrame:
    """EXP1/EXP8: sampled-permutation Shapley values of ``scorer`` for every row of ``df``.

    The score of a coalition (the row's values in a set of features, the
    background's in the others) is its mean over the whole background. It is
    the same for all rows and permutations that share the set and the values in
    it, so that each such point is scored once, with every distinct combination
    that the background has in the other features, weighed by its count. These
    are at most rows × permutations × |background| × (features + 1) scorings
    (where all values differ). Both sides are dealt in parts, so that either may
    have any size. Output long (key, feature_code, value, shap_value).
    """
    keys = _keys(key)
    feats = list(features)
    nf = len(feats)
    xs, at_t = [f"__x{j}" for j in range(nf)], F.col("t")
    # permutation: features sorted by a seeded draw; at step t the first t of them are the row's
    order = F.array_sort(F.array(*[F.struct(uniform(seed, *keys, F.col("perm"), F.lit(j)).alias("u"),
                                            F.lit(j).alias("j")) for j in range(nf)]))
    rows = kept(df.select(*keys, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"__v{j}") for j, c in enumerate(feats)],
                          F.array(*[F.col(c).cast("double") for c in feats]).alias("__attr_x"))
                .withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
                .withColumn("__ord", F.transform(order, lambda s: s["j"])))
    own = [F.array_position("__ord", j) <= at_t for j in range(nf)]
    steps = (rows.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(nf))))
             .select(*keys, "t", "__ord", "__attr_x", F.concat(*[o.cast("int").cast("string") for o in own]).alias("__set"),
                     *[F.when(o, F.col(f"__v{j}")).otherwise(F.lit(0.0)).alias(c) for j, (o, c) in enumerate(zip(own, xs))]))
    points = kept(steps.select("__set", *xs).distinct().withColumn("__point", F.monotonically_increasing_id()))
    sets = points.groupBy("__set").agg(F.count(F.lit(1)).alias("__n_points"))

    # what the background has in the features outside of each set
    inside = [F.substring("__set", j + 1, 1) == "1" for j in range(nf)]
    every = sets.select("__set", F.explode(F.sequence(F.lit(0), F.lit(_GROUPS - 1))).alias("__group"))
    others = kept(background.select(F.pmod(F.monotonically_increasing_id(), F.lit(_GROUPS)).cast("int").alias("__group"),
                                    *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(x) for c, x in zip(feats, xs)])
                  .join(every, "__group")
                  .groupBy("__set", *[F.when(i, F.lit(0.0)).otherwise(F.col(x)).alias(x) for i, x in zip(inside, xs)])
                  .agg(F.count(F.lit(1)).alias("__n")))
    parts = kept(sets.join(others.groupBy("__set").agg(F.count(F.lit(1)).alias("__n_others"), F.sum("__n").alias("__nb")), "__set")
                 .select("__set", "__nb", (F.col("__n_points").cast("double") * F.col("__n_others")).alias("__pairs"),
                         F.ceil(F.col("__n_points") / POINTS_PART).cast("int").alias("__parts"),
                         F.ceil(F.col("__n_others") / BACKGROUND_BLOCK).cast("int").alias("__blocks")))
    pairs = parts.agg(F.sum("__pairs")).first()[0] or 0.0
    tasks, tile = int(min(MOST_TASKS, max(1, pairs // TASK_PAIRS))), ["__set", "__part", "__block"]
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = (others.join(parts, "__set").withColumn("__block", F.pmod(F.xxhash64(*xs), F.col("__blocks")).cast("int"))
            .groupBy("__set", "__block", "__parts").agg(F.collect_list(F.struct("__n", *xs)).alias("__bs"))
            .withColumn("__part", upto("__parts")).select(*tile, "__bs").repartition(tasks, *tile))
    met = (points.join(parts, "__set").withColumn("__part", F.pmod(F.xxhash64("__point"), F.col("__parts")).cast("int"))
           .withColumn("__block", upto("__blocks")).select(*tile, "__point", "__nb", *xs).repartition(tasks, *tile)
           .join(held.hint("shuffle_hash"), tile)
           .select("__point", "__nb", *xs, *[i.alias(f"__i{j}") for j, i in enumerate(inside)], F.explode("__bs").alias("b")))
    pts = met.select("__point", "__nb", F.col("b.__n").alias("__n"),
                     *[F.when(F.col(f"__i{j}"), F.col(x)).otherwise(F.col(f"b.{x}")).alias(c) for j, (x, c) in enumerate(zip(xs, feats))])
    p = F.col(scorer.prob_col)
    scored = (scorer.score(pts).groupBy("__point").agg((F.sum(p * F.col("__n")) / F.first("__nb")).alias("__p")))
    valued = kept(points.join(scored, "__point").drop("__point"))

    # a point counts for the feature it brings in and against the next one
    part = lambda at, sign: F.struct(F.element_at("__ord", at).alias("j"), (sign * F.col("__p")).alias("d"))
    sides = F.array_compact(F.array(F.when(at_t > 0, part(F.greatest(at_t, F.lit(1)), F.lit(1.0))),
                                    F.when(at_t < nf, part(F.least(at_t + 1, F.lit(nf)), F.lit(-1.0)))))
    names = F.array(*[F.lit(c) for c in feats])
    return (steps.join(valued, ["__set", *xs]).select(*keys, "__attr_x", F.explode(sides).alias("e"))
            .select(*keys, F.col("e.j").alias("j"), F.col("e.d").alias("d"),
                    F.element_at("__attr_x", F.col("e.j") + 1).alias("v"))
            .groupBy(*keys, "j").agg((F.sum("d") / F.lit(float(permutations))).alias("shap_value"),
                                     F.first("v").alias("value"))
            .select(*keys, F.element_at(names, F.col("j") + 1).alias("feature_code"), "value", "shap_value"))


def label_direction(attr: DataFrame, eps: float = NEUTRAL_EPS) -> DataFrame:
    """EXP4: direction label, percent impact and presentation rounding."""
    s = F.col("shap_value")
    return attr.withColumns({
        "direction": F.when(s > eps, "increases_risk").when(s < -eps, "reduces_risk").otherwise("neutral"),
        "impact_pct": round_half_away(s * 100.0, 2),
        "value": round_half_away(F.col("value"), 2),
        "shap_value": round_half_away(s, 4)})


def _size_order():
    """Descending |shap| (equal to nine decimals: a tie), then name."""
    return F.desc(F.round(F.abs("shap_value"), 9)), F.col("feature_code")


def explain(attr: DataFrame, key, top: int = 10, side: int = 5) -> DataFrame:
    """EXP5: per row top features by |shap|, top raising and top lowering ones.

    Long output with ``list`` in {top, risk, protective} and ``rank``; a
    per-row nested view is ``groupBy(key, list).agg(collect_list(struct))``.
    One window (one shuffle, one sort): the rank among raising (lowering)
    features is the running count of positive (negative) values in the same
    |shap| order.
    """
    keys = _keys(key)
    w = Window.partitionBy(*keys).orderBy(*_size_order())
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    s = F.col("shap_value")
    r = attr.withColumns({"__rt": F.row_number().over(w),
                          "__rp": F.sum((s > 0).cast("int")).over(run).cast("int"),
                          "__rn": F.sum((s < 0).cast("int")).over(run).cast("int")})
    item = lambda name, rk: F.struct(F.lit(name).alias("list"), rk.alias("rank"))
    lists = F.array(F.when(F.col("__rt") <= top, item("top", F.col("__rt"))),
                    F.when((s > 0) & (F.col("__rp") <= side), item("risk", F.col("__rp"))),
                    F.when((s < 0) & (F.col("__rn") <= side), item("protective", F.col("__rn"))))
    return (r.select(*attr.columns, F.explode(lists).alias("__l")).filter(F.col("__l").isNotNull())
            .select(*attr.columns, F.col("__l.list").alias("list"), F.col("__l.rank").alias("rank")))


def _by_size(arr: str):
    """The attribution array ordered by descending |shap| (equal to nine decimals: a tie), then name."""
    return F.array_sort(F.transform(arr, lambda a: F.struct(
        (-F.round(F.abs(a["shap_value"]), 9)).alias("o"), a["feature_code"].alias("feature_code"),
        a["shap_value"].alias("shap_value"), a["value"].alias("value"))))


def _ordered(wide: DataFrame, keys: list[str], n: int, arr: str) -> DataFrame:
    """keys, the n attributions of a row as struct columns ``__a0``… in the order of :func:`_size_order` and their sizes
    ``__s0``…: the native array sort and plain columns, no function called for each element."""
    order = F.sort_array(F.array(*[F.struct(
        F.col(arr)[i]["shap_value"].isNull().alias("last"), (-F.round(F.abs(F.col(arr)[i]["shap_value"]), 9)).alias("o"),
        F.col(arr)[i]["feature_code"].alias("feature_code"), F.lit(i).alias("i"), F.col(arr)[i]["value"].alias("value"),
        F.col(arr)[i]["shap_value"].alias("shap_value")) for i in range(n)]))
    return (wide.select(*keys, order.alias("__s"))
            .select(*keys, *[F.col("__s")[i].alias(f"__a{i}") for i in range(n)])
            .select("*", *[F.col(f"__a{i}.shap_value").alias(f"__s{i}") for i in range(n)]))


def explain_arrays(wide: DataFrame, key, top: int = 10, side: int = 5, arr: str = "attribution",
                   features: Sequence[str] | None = None) -> DataFrame:
    """EXP5 from one row per key with an attribution array: ranked inside the row, no shuffle.

    With the ``features`` of the array (their number is what counts) the ranks are plain columns, which Spark compiles.
    """
    keys = _keys(key)
    if features is not None:
        n = len(features)
        rows = _ordered(wide, keys, n, arr)
        up = [F.coalesce((F.col(f"__s{i}") > 0).cast("int"), F.lit(0)) for i in range(n)]
        down = [F.coalesce((F.col(f"__s{i}") < 0).cast("int"), F.lit(0)) for i in range(n)]
        rows = rows.select("*", *[sum(x[1:i + 1], x[0]).alias(f"__{name}{i}") for name, x in (("up", up), ("down", down)) for i in range(n)])

        entries = [F.struct(*[F.col(f"__a{i}")[c].alias(c) for c in ("feature_code", "value", "shap_value")], F.lit(i + 1).alias("t"),
                            F.col(f"__up{i}").alias("p"), F.col(f"__down{i}").alias("n")) for i in range(n)]
        item = lambda name, rk: F.struct(F.lit(name).alias("list"), rk.alias("rank"))
        s = F.col("shap_value")
        lists = F.array(F.when(F.col("t") <= top, item("top", F.col("t"))),
                        F.when((s > 0) & (F.col("p") <= side), item("risk", F.col("p"))),
                        F.when((s < 0) & (F.col("n") <= side), item("protective", F.col("n"))))
        own = [*keys, "feature_code", "value", "shap_value"]
        return (rows.select(*keys, F.explode(F.array(*entries)).alias("x")).select(*keys, "x.*")
                .select(*own, F.explode(lists).alias("l")).filter(F.col("l").isNotNull()).select(*own, "l.list", "l.rank"))
    sides = {"top": (lambda x: x["o"].isNotNull(), top), "risk": (lambda x: x["shap_value"] > 0, side),
             "protective": (lambda x: x["shap_value"] < 0, side)}

    def ranked(name):
        return lambda x, i: F.struct(x["feature_code"].alias("feature_code"), x["value"].alias("value"),
                                     x["shap_value"].alias("shap_value"), F.lit(name).alias("list"), (i + 1).alias("rank"))

    lists = [F.transform(F.slice(F.filter("__s", cond), 1, n), ranked(name)) for name, (cond, n) in sides.items()]
    return (wide.select(*keys, _by_size(arr).alias("__s")).select(*keys, F.explode(F.concat(*lists)).alias("x"))
            .select(*keys, "x.*"))


def global_importance(attr: DataFrame, n: int = 15) -> DataFrame:
    """EXP6: mean |attribution| per feature, top n (a top-n report)."""
    g = attr.groupBy("feature_code").agg(F.avg(F.abs("shap_value")).alias("m"))
    return (g.select("feature_code", F.round("m", 4).alias("mean_abs_shap"),
                     F.round(F.col("m") * 100.0, 2).alias("importance_score"), "m")
            .orderBy(F.desc("m"), "feature_code").limit(n).drop("m"))


def global_importance_arrays(df: DataFrame, features: Sequence[str], arr: str = "attribution",
                             n: int = 15) -> DataFrame:
    """EXP6 from one row per key with an attribution array: one wide aggregate
    (one mean |shap| per feature), no explode and no shuffle."""
    feats = list(features)
    agg = df.agg(*[F.avg(F.abs(F.col(arr)[i]["shap_value"])).alias(f"m{i}") for i in range(len(feats))])
    rows = agg.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature_code"), F.col(f"m{i}").alias("m"))
                                          for i, c in enumerate(feats)])).alias("x")).select("x.*")
    return (rows.select("feature_code", F.round("m", 4).alias("mean_abs_shap"),
                        F.round(F.col("m") * 100.0, 2).alias("importance_score"), "m")
            .orderBy(F.desc("m"), "feature_code").limit(n).drop("m"))


def waterfall(attr: DataFrame, key, base: float | None = None, base_df: DataFrame | None = None) -> DataFrame:
    """EXP7: ordered contributions with running total from the base value."""
    keys = _keys(key)
    b = F.lit(base) if base is not None else base_df.select(F.first("base_value")).scalar()
    w = Window.partitionBy(*keys).orderBy(*_size_order())
    return (attr.withColumn("step", F.row_number().over(w))
            .withColumn("running_total", b + F.sum("shap_value").over(w.rowsBetween(Window.unboundedPreceding, 0))))


def waterfall_arrays(wide: DataFrame, key, base, arr: str = "attribution", features: Sequence[str] | None = None) -> DataFrame:
    """EXP7 from one row per key with an attribution array: running totals inside the row, no shuffle (``features`` as in
    :func:`explain_arrays`)."""
    keys = _keys(key)
    if features is not None:
        n = len(features)
        rows = _ordered(wide, keys, n, arr).withColumn("__t0", F.col("__s0"))
        for i in range(1, n):  # a sum passes by nulls, which come last
            rows = rows.withColumn(f"__t{i}", F.col(f"__t{i - 1}") + F.coalesce(F.col(f"__s{i}"), F.lit(0.0)))
        entries = [F.struct(F.col(f"__a{i}.feature_code").alias("feature_code"), F.col(f"__a{i}.value").alias("value"),
                            F.col(f"__a{i}.shap_value").alias("shap_value"), F.lit(i + 1).alias("step"),
                            (F.lit(base) + F.col(f"__t{i}")).alias("running_total")) for i in range(n)]
        return rows.select(*keys, F.explode(F.array(*entries)).alias("x")).select(*keys, "x.*")
    steps = F.transform("__s", lambda x, i: F.struct(
        x["feature_code"].alias("feature_code"), x["value"].alias("value"), x["shap_value"].alias("shap_value"),
        (i + 1).alias("step"),
        (F.lit(base) + F.aggregate(F.slice("__s", 1, i + 1), F.lit(0.0), lambda a, y: a + y["shap_value"])).alias("running_total")))
    return (wide.select(*keys, _by_size(arr).alias("__s")).select(*keys, F.explode(steps).alias("x"))
            .select(*keys, "x.*"))
