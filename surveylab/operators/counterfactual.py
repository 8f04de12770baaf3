"""Counterfactuals over every mutable column (SIM5), with what may change learnt from the data.

Each column that is neither a key nor immutable is a player: a column with few
levels (numbers or text) moves to an observed level, drawn by its frequency; a
number with many values to a point of its observed quantiles; indicator columns
of one category (0/1, same name up to the last underscore, at most one set in
any row) move together, as one level or none. One hash a draw, cut into
numbers of 16 bits, decides for all columns which change and to what.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveylab.functions.expr import nan_to_null
from surveylab.operators.quantiles import exact_quantiles
from surveylab.session import kept

#: A column with more distinct values than this is drawn from its quantiles (numbers) or its most frequent levels (text).
MOST_LEVELS = 64
QUANTILES = 21
_NUMBERS = 8  # of 16 bits, in one md5


@dataclass
class Player:
    """What one draw may change: ``columns`` (several for an indicator group), the ``levels`` and their running counts."""
    name: str
    columns: list[str]
    levels: list
    upto: list[float]


def _indicator_groups(df: DataFrame, cols: Sequence[str]) -> dict[str, list[str]]:
    """Columns of one category as 0/1 indicators, by one aggregate."""
    by: dict[str, list[str]] = {}
    for c in cols:
        if "_" in c and isinstance(df.schema[c].dataType, T.NumericType):
            by.setdefault(c.rsplit("_", 1)[0], []).append(c)
    by = {p: cs for p, cs in by.items() if len(cs) > 1}
    if not by:
        return {}
    tests = []
    for p, cs in by.items():
        binary = [F.coalesce(F.col(f"`{c}`").cast("double").isin(0.0, 1.0), F.lit(False)) for c in cs]
        total = sum((F.col(f"`{c}`").cast("double") for c in cs), F.lit(0.0))
        ok = total <= 1.0
        for b in binary:
            ok = b & ok
        tests.append(F.min(F.coalesce(ok, F.lit(False)).cast("int")).alias(p))
    found = df.agg(*tests).first()
    return {p: cs for p, cs in by.items() if found[p]}


def players(df: DataFrame, keys: Sequence[str], immutable: Sequence[str], most_levels: int = MOST_LEVELS,
            quantiles: int = QUANTILES) -> list[Player]:
    """What may change in ``df`` and how often each level occurs, from the whole table (in the order of the columns)."""
    free = [c for c in df.columns if c not in {*keys, *immutable}]
    groups = _indicator_groups(df, free)
    grouped = {c: p for p, cs in groups.items() for c in cs}
    single = [c for c in free if c not in grouped]
    number = {c: isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType)) for c in single}
    text = {c: (nan_to_null(F.col(f"`{c}`").cast("double")).cast("string") if number[c] else F.col(f"`{c}`").cast("string"))
            for c in single}
    distinct = df.agg(*[F.approx_count_distinct(e).alias(c) for c, e in text.items()]).first().asDict() if single else {}
    many = [c for c in single if number[c] and distinct[c] > most_levels]
    few = [c for c in single if c not in many]
    stacked = {c: text[c] for c in few} | {
        p: F.coalesce(*[F.when(F.col(f"`{c}`").cast("double") == 1.0, F.lit(c)) for c in cs], F.lit("")) for p, cs in groups.items()}
    counts: dict[str, list] = {c: [] for c in stacked}
    if stacked:
        long = df.select(*[e.alias(f"v{i}") for i, e in enumerate(stacked.values())]).unpivot(
            [], [f"v{i}" for i in range(len(stacked))], "player", "level").where("level is not null")
        order = Window.partitionBy("player").orderBy(F.desc("n"), "level")
        top = (long.groupBy("player", "level").agg(F.count(F.lit(1)).alias("n"))
               .withColumn("r", F.row_number().over(order)).where(F.col("r") <= most_levels))
        names = list(stacked)
        for r in top.collect():  # at most ``most_levels`` rows a player
            counts[names[int(r["player"][1:])]].append((r["level"], r["n"]))
    grids = exact_quantiles(df, many, [i / (quantiles - 1) for i in range(quantiles)])
    out, done = [], set()
    for c in free:
        p = grouped.get(c, c)
        if p in done:
            continue
        done.add(p)
        if p in many:
            pairs = [(x, 1) for x in grids[p] if x is not None]
        elif number.get(p) and p not in groups:
            pairs = sorted((float(v), n) for v, n in counts[p])
        else:
            pairs = sorted(counts[p])
        if pairs:
            upto, at = [], 0
            for _, n in pairs:
                at += n
                upto.append(float(at))
            out.append(Player(p, groups.get(p, [p]), [v for v, _ in pairs], upto))
    return out


def _number(i: int) -> Column:
    """Number i in [0, 1) of a draw, from the hash that holds it."""
    return F.conv(F.substring(F.col(f"__h{i // _NUMBERS}"), 4 * (i % _NUMBERS) + 1, 4), 16, 10).cast("double") / 65536.0


def search(df: DataFrame, key, scorer, immutable: Sequence[str], n: int = 2, draws: int = 20, seed: int = 42,
           p_min: float = 0.35, p_target: float = 0.5, derive: Callable[[DataFrame], DataFrame] | None = None,
           learnt: list[Player] | None = None) -> DataFrame:
    """SIM5: for rows with p > p_min, up to n changed versions with p < p_target.

    Each of ``draws`` candidates changes each player with probability 1/2.
    They are ranked by (players changed, distance, draw): the distance adds
    the differences of numbers, and 1 for a changed text or indicator group.
    Only each task's best n of a row are shuffled. A row without a candidate
    stays with one line of ``status`` 'none'. Players default to
    :func:`players` of ``df``; a NULL that is changed counts 1.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if learnt is None:
        df = kept(df)  # read several times: the input's own plan (a join, say) runs once
    own = players(df, keys, immutable) if learnt is None else learnt
    base = scorer.score(derive(df) if derive is not None else df)
    hot = base.filter(F.col(scorer.prob_col) > p_min).select(*[f"`{c}`" for c in df.columns])
    fan = hot.withColumn("cf_id", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(f"`{k}`").cast("string") for k in keys], F.col("cf_id").cast("string"))
    fan = fan.withColumns({f"__h{b}": F.md5(F.concat(text, F.lit(f":{b}"))) for b in range(-(-2 * len(own) // _NUMBERS))})
    fan = fan.withColumns({f"__u{i}": _number(2 * i + 1) for i in range(len(own))})
    new, changed, distance = {}, F.lit(0), F.lit(0.0)
    for i, p in enumerate(own):
        pick = _number(2 * i) < 0.5
        # The first level whose share is above the number, as compiled comparisons.
        level = F.lit(p.levels[-1])
        if len(p.levels) > 1:
            level = F.when(F.col(f"__u{i}") < p.upto[0] / p.upto[-1], F.lit(p.levels[0]))
            for u, v in zip(p.upto[1:-1], p.levels[1:-1]):
                level = level.when(F.col(f"__u{i}") < u / p.upto[-1], F.lit(v))
            level = level.otherwise(F.lit(p.levels[-1]))
        if len(p.columns) > 1 or p.columns[0] != p.name:
            was = [F.col(f"`{c}`").cast("double") for c in p.columns]
            to = [F.when(pick, (level == F.lit(c)).cast("double")).otherwise(w) for c, w in zip(p.columns, was)]
            moved = F.lit(False)
            for c, w, t in zip(p.columns, was, to):
                new[c] = t
                moved = moved | ~w.eqNullSafe(t)
            step = F.lit(1.0)
        else:
            number = not isinstance(p.levels[0], str)
            was = F.col(f"`{p.name}`").cast("double" if number else "string")
            to = new[p.name] = F.when(pick, level).otherwise(was)
            moved = ~was.eqNullSafe(to)
            step = F.coalesce(F.abs(to - was), F.lit(1.0)) if number else F.lit(1.0)
        changed = changed + moved.cast("int")
        distance = distance + F.when(moved, step).otherwise(0.0)
    fan = fan.withColumns({"n_changed": changed, "distance": distance, **{f"__n_{c}": e for c, e in new.items()}})
    fan = fan.select(*[(F.col(f"__n_{c}") if c in new else F.col(f"`{c}`")).alias(c) for c in df.columns],
                     "cf_id", "n_changed", "distance")
    s = scorer.score(derive(fan) if derive is not None else fan)
    good = F.coalesce((F.col(scorer.prob_col) < p_target) & (F.col("n_changed") > 0), F.lit(False))
    w = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy("status", "n_changed", "distance", "cf_id")
    return (s.withColumn("status", F.when(good, "found").otherwise("none")).withColumn("cf_rank", F.row_number().over(w))
            .filter(F.col("cf_rank") <= n).filter((F.col("status") == "found") | (F.col("cf_rank") == 1)))
