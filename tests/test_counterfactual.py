"""Counterfactuals over all mutable columns: what may change is learnt, groups move as one."""

import hashlib

from pyspark.sql import functions as F

from conftest import SF001
from surveylab.operators import counterfactual
from surveylab.operators.scoring import LinearScorer


def frame(spark):
    return spark.range(200).select(
        "id", (F.col("id") % 3).cast("int").alias("level"), (F.col("id") * 1.0).alias("wide"),
        F.when(F.col("id") % 4 > 0, F.concat(F.lit("t"), (F.col("id") % 2).cast("string"))).alias("name"),
        (F.col("id") % 5 == 0).cast("int").alias("kind_a"), (F.col("id") % 5 == 1).cast("int").alias("kind_b"),
        (F.col("id") % 7).cast("double").alias("fixed"), F.lit(None).cast("double").alias("none"))


def test_players_are_learnt_from_the_data(spark):
    found = {p.name: p for p in counterfactual.players(frame(spark), ["id"], ["fixed"])}
    assert list(found) == ["level", "wide", "name", "kind"]
    assert found["level"].levels == [0.0, 1.0, 2.0] and found["level"].upto == [67.0, 134.0, 200.0]
    assert found["name"].levels == ["t0", "t1"] and found["name"].upto == [50.0, 150.0]
    assert found["kind"].columns == ["kind_a", "kind_b"] and found["kind"].levels == ["", "kind_a", "kind_b"]
    assert len(found["wide"].levels) == 21 and found["wide"].levels[0] == 0.0 and found["wide"].levels[-1] == 199.0


def test_found_rows_change_only_what_they_may(spark):
    df = frame(spark)
    scorer = LinearScorer({"level": 1.5, "kind_a": 2.0, "kind_b": -1.0, "wide": 0.01}, intercept=-2.0)
    got = counterfactual.search(df, "id", scorer, ["fixed"], n=3, draws=30, p_min=0.5, p_target=0.4).collect()
    own = {r["id"]: r for r in df.collect()}
    hot = {r["id"] for r in scorer.score(df).where(F.col(scorer.prob_col) > 0.5).collect()}
    assert {r["id"] for r in got} == hot and any(r["status"] == "found" for r in got)
    for r in got:
        o = own[r["id"]]
        assert r["fixed"] == o["fixed"] and r["none"] is None and r["kind_a"] + r["kind_b"] <= 1
        if r["status"] == "found":
            moved = [c for c in ("level", "wide", "name") if r[c] != o[c]] + ["kind"] * ((r["kind_a"], r["kind_b"]) != (o["kind_a"], o["kind_b"]))
            assert r["n_changed"] == len(moved) > 0 and r[scorer.prob_col] < 0.4
            far = sum(abs(r[c] - o[c]) if c in ("level", "wide") else 1.0 for c in moved)
            assert abs(r["distance"] - far) < 1e-9
    ranks = {}
    for r in got:
        ranks.setdefault(r["id"], []).append((r["cf_rank"], r["n_changed"], r["distance"]))
    for v in ranks.values():
        v.sort()
        assert [x[0] for x in v] == list(range(1, len(v) + 1)) and [x[1:] for x in v] == sorted(x[1:] for x in v)
    again = counterfactual.search(df.repartition(7), "id", scorer, ["fixed"], n=3, draws=30, p_min=0.5, p_target=0.4).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert counterfactual.search(df.limit(0), "id", scorer, ["fixed"]).count() == 0


def test_the_input_runs_once_and_no_method_is_too_long(spark):
    """The players, the scores and the candidates read kept rows, not the input's join again; plans with many features run
    operator by operator where Java would not compile them as one method."""
    from surveylab.plans.survey import IMMUTABLE, SCORER, derive, survey_frame
    from surveylab.plans.tables import CHILD_KEY

    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    s = survey_frame(spark, SF001)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    assert "Join" in s._jdf.queryExecution().executedPlan().toString()
    cf = counterfactual.search(s, CHILD_KEY, SCORER, [*IMMUTABLE, "area", "stunting_label"], draws=3, derive=derive)
    assert "Join" not in cf._jdf.queryExecution().executedPlan().toString()


def test_levels_are_drawn_by_their_shares(spark):
    c = counterfactual
    df = spark.range(50).select("id", F.lit(1.0).alias("x"), F.lit("a").alias("t"))
    learnt = [c.Player("x", ["x"], [1.0, 2.0, 3.0], [2.0, 3.0, 8.0]), c.Player("t", ["t"], ["b"], [4.0])]
    rows = c.search(df, "id", LinearScorer({"x": 0.0}), [], n=10, draws=10, p_target=0.6, learnt=learnt).collect()
    assert {r["t"] for r in rows} == {"a", "b"} and {r["x"] for r in rows} == {1.0, 2.0, 3.0}
    for r in rows:
        hashed = hashlib.md5(f"42:{r['id']}:{r['cf_id']}:0".encode()).hexdigest()
        pick, at = (int(hashed[4 * i:4 * i + 4], 16) / 65536 for i in (0, 1))
        want = 1.0 if pick >= 0.5 or at < 2 / 8 else 2.0 if at < 3 / 8 else 3.0
        assert r["x"] == want
