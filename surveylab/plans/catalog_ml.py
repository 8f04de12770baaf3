"""Registered queries: neighbours, oversampling, fitted models, sampled
attribution, counterfactuals, fitted feature transformers.

Fitted-model results depend on Spark's learners, so most of these have no
SQL twin; the exact neighbour search and the k-NN classifier do.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from surveylab.operators import clean, counterfactual, link, stats
from surveylab.operators.attribution import attribute, global_importance
from surveylab.operators.features import CentredPCA, KMeansDistance
from surveylab.operators.hash_index import knn_hashed
from surveylab.operators.impute import mice
from surveylab.operators.modeling import (ModelSpec, ablation, cv_benchmark, fit, knn_classify, quality_gate,
                                          random_search, resampled, split_report, stack, summarize_cv,
                                          with_balanced_weights)
from surveylab.operators.neighbors import knn
from surveylab.operators.sampling import adasyn, smote, stratified_folds, stratified_split
from surveylab.operators.scoring import ModelScorer
from surveylab.operators.simulate import counterfactuals, mutable_columns
from surveylab.operators.tree_attribution import attribute_trees
from surveylab.plans.catalog_prep import _survey_with_size
from surveylab.plans.linked import linked_frame
from surveylab.plans.registry import register
from surveylab.plans.survey import IMMUTABLE, SCORER, derive, survey_frame
from surveylab.plans.tables import CHILD_KEY, SENTINELS, sql_uniform, table
from surveylab.session import kept

DP = 6
MODEL_FEATURES = ["child_age_months", "birth_order", "birth_interval", "anc_visits", "mother_age",
                  "mother_education", "wealth_index", "mother_anemia", "mother_bmi", "sanitation_score",
                  "disease_burden_index", "maternal_vulnerability_score", "child_vulnerability_score"]
DOC_FEATURES = ["f_len", "f_words", "f_digit_share", "f_upper_share", "f_lang_en", "f_lang_de"]


def survey_model_frame(spark, sf, k: int = 5, seed: int = 42):
    """Survey features + label + stratified fold (SPL2)."""
    f = derive(survey_frame(spark, sf)).select(*CHILD_KEY, *MODEL_FEATURES, "stunting_label")
    return stratified_folds(f, "stunting_label", CHILD_KEY, k=k, seed=seed)


def doc_model_frame(spark, sf):
    """labels ⋈ documents with whole-text features (imbalanced: toxic)."""
    lab = table(spark, sf, "labels")
    doc = table(spark, sf, "documents")
    t = F.coalesce(F.col("text"), F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    # Runs of other characters are matched at once; one by one they take most of the time.
    d = doc.select("doc_id", F.log1p(F.coalesce(F.col("n_chars"), F.lit(0))).alias("f_len"),
                   F.log1p(F.size(F.split(t, r"\s+"))).alias("f_words"),
                   (F.length(F.regexp_replace(t, "[^0-9]+", "")) / n).alias("f_digit_share"),
                   (F.length(F.regexp_replace(t, "[^A-Z]+", "")) / n).alias("f_upper_share"),
                   F.col("lang").eqNullSafe("en").cast("double").alias("f_lang_en"),
                   F.col("lang").eqNullSafe("de").cast("double").alias("f_lang_de"))
    return lab.select("doc_id", "toxic", "quality").join(d, "doc_id")


# ------------------------------------------------------------------ neighbours
_EMB = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings"


@register("knn_embeddings", ids=("IMB2",), sql=f"""
WITH e AS ({_EMB}),
p AS (SELECT a.vec_id AS q, b.vec_id AS t, list_distance(a.v, b.v) AS d FROM e a, e b WHERE a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, t) AS rk FROM p)
SELECT q AS vec_id, t AS neighbor_id, round(d, {DP}) AS distance, CAST(rk AS INTEGER) AS rank FROM r WHERE rk <= 5
""")
def q_knn(spark, sf):
    e = table(spark, sf, "embeddings")
    nn = knn(e, e.withColumnRenamed("vec_id", "neighbor_id"), "vec_id", "neighbor_id", "embedding", k=5)
    return nn.select("vec_id", "neighbor_id", F.round("distance", DP).alias("distance"), "rank")


@register("knn_hashed_embeddings", ids=("IMB2",))
def q_knn_hashed(spark, sf):
    """Approximate neighbours of every 20th vector among all vectors (recall measured in tests)."""
    e = table(spark, sf, "embeddings")
    nn = knn_hashed(e.filter("vec_id % 20 = 0"), e.withColumnRenamed("vec_id", "neighbor_id"), "vec_id", "neighbor_id",
                    "embedding", k=5)
    return nn.select("vec_id", "neighbor_id", F.round("distance", DP).alias("distance"), "rank")


_EMB_SPLIT = f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(label >= 5 AS INTEGER) AS y FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {sql_uniform(3, ['vec_id'])}, vec_id) AS rk,
             count(*) OVER (PARTITION BY y) AS n_c FROM e),
s AS (SELECT *, CASE WHEN rk <= floor(n_c * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split FROM r)"""


@register("knn_classify_embeddings", ids=("MOD5", "SPL1"), sql=f"""
{_EMB_SPLIT},
p AS (SELECT a.vec_id, b.y, list_distance(a.v, b.v) AS d, b.vec_id AS t
      FROM s a, s b WHERE a.split = 'test' AND b.split = 'train'),
nn AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, t) AS nrk FROM p)
SELECT vec_id, round(avg(y), {DP}) AS p, count(*)::BIGINT AS n_neighbors FROM nn WHERE nrk <= 15 GROUP BY vec_id
""")
def q_knn_cls(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("y", (F.col("label") >= 5).cast("int"))
    s = stratified_split(e, "y", "vec_id", test=0.2, seed=3)
    out = knn_classify(s.filter(F.col("split") == "train"), s.filter(F.col("split") == "test"),
                       "vec_id", "vec_id", "embedding", "y", k=15)
    return out.select("vec_id", F.round("p", DP).alias("p"), "n_neighbors")


# ------------------------------------------------------------------ oversampling
def _u(parts: str) -> str:
    return f"(('0x' || substr(md5({parts}), 1, 8))::BIGINT / 4294967296.0)"


_DOC_SQL = """
SELECT l.doc_id, l.toxic,
       ln(1 + coalesce(d.n_chars, 0)) AS f_len,
       ln(1 + len(regexp_split_to_array(d.text, '\\s+'))) AS f_words,
       length(regexp_replace(d.text, '[^0-9]', '', 'g')) / greatest(length(d.text), 1) AS f_digit_share,
       length(regexp_replace(d.text, '[^A-Z]', '', 'g')) / greatest(length(d.text), 1) AS f_upper_share,
       CAST(d.lang = 'en' AS DOUBLE) AS f_lang_en, CAST(d.lang = 'de' AS DOUBLE) AS f_lang_de
FROM labels l JOIN (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, n_chars FROM documents) d
  ON l.doc_id = d.doc_id"""

_FEATS = ", ".join(DOC_FEATURES)
_VEC = "[" + ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0)" for c in DOC_FEATURES) + "]"

SMOTE_SQL = f"""
WITH d AS ({_DOC_SQL}),
mi AS (SELECT *, {_VEC}::DOUBLE[] AS v FROM d WHERE toxic = 1),
cnt AS (SELECT sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS n_min, sum(CASE WHEN toxic <> 1 THEN 1 ELSE 0 END) AS n_maj FROM d),
rk AS (SELECT mi.*, row_number() OVER (ORDER BY {_u("'42:' || CAST(doc_id AS VARCHAR)")}, doc_id) AS r FROM mi),
q AS (SELECT rk.*, (cnt.n_maj - cnt.n_min) // cnt.n_min + CAST(r <= (cnt.n_maj - cnt.n_min) % cnt.n_min AS INTEGER) AS quota
      FROM rk, cnt WHERE cnt.n_maj > cnt.n_min),
pairs AS (SELECT a.doc_id, b.doc_id AS nb, list_distance(a.v, b.v) AS dist FROM mi a, mi b WHERE a.doc_id <> b.doc_id),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dist, nb) AS rank FROM pairs) WHERE rank <= 5),
nnn AS (SELECT doc_id, count(*) AS n_nb FROM nn GROUP BY doc_id),
ex AS (SELECT q.doc_id, q.v, unnest(range(1, CAST(q.quota AS BIGINT) + 1)) AS syn_index, nnn.n_nb FROM q JOIN nnn USING (doc_id) WHERE q.quota > 0),
ch AS (SELECT ex.*, CAST(floor({_u("'42:' || CAST(doc_id AS VARCHAR) || ':' || CAST(syn_index AS VARCHAR) || ':nb'")} * n_nb) + 1 AS BIGINT) AS rank,
              {_u("'42:' || CAST(doc_id AS VARCHAR) || ':' || CAST(syn_index AS VARCHAR) || ':gap'")} AS gap FROM ex),
syn AS (SELECT ch.doc_id, ch.syn_index, ch.v AS x, nb_t.v AS y, ch.gap
        FROM ch JOIN nn ON ch.doc_id = nn.doc_id AND ch.rank = nn.rank JOIN mi nb_t ON nn.nb = nb_t.doc_id),
allrows AS (
  SELECT toxic, false AS is_synthetic, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in DOC_FEATURES)} FROM d
  UNION ALL
  SELECT 1, true, {", ".join(f"x[{i + 1}] + gap * (y[{i + 1}] - x[{i + 1}]) AS {c}" for i, c in enumerate(DOC_FEATURES))} FROM syn)
SELECT toxic, is_synthetic, count(*)::BIGINT AS n, {", ".join(f"round(avg({c}), {DP}) AS mean_{c}" for c in DOC_FEATURES)}
FROM allrows GROUP BY toxic, is_synthetic
"""


@register("smote_class_balance", ids=("IMB3", "AGG7"), sql=SMOTE_SQL)
def q_smote(spark, sf):
    d = doc_model_frame(spark, sf)
    s = smote(d, "toxic", DOC_FEATURES, "doc_id", k=5, seed=42)
    return s.groupBy("toxic", "is_synthetic").agg(F.count(F.lit(1)).alias("n"),
                                                  *[F.round(F.avg(c), DP).alias(f"mean_{c}") for c in DOC_FEATURES])


ADASYN_SQL = f"""
WITH d AS ({_DOC_SQL}),
al AS (SELECT *, {_VEC}::DOUBLE[] AS v FROM d),
mi AS (SELECT * FROM al WHERE toxic = 1),
cnt AS (SELECT sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS n_min, sum(CASE WHEN toxic <> 1 THEN 1 ELSE 0 END) AS n_maj FROM d),
pa AS (SELECT a.doc_id, b.doc_id AS t, b.toxic AS tt, list_distance(a.v, b.v) AS dist FROM mi a, al b WHERE a.doc_id <> b.doc_id),
na AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dist, t) AS rank FROM pa) WHERE rank <= 5),
r AS (SELECT doc_id, sum(CASE WHEN tt <> 1 THEN 1.0 ELSE 0.0 END) / 5 AS ri FROM na GROUP BY doc_id),
tot AS (SELECT sum(ri) AS s FROM r),
q AS (SELECT mi.*, CAST(round_even(r.ri / tot.s * (cnt.n_maj - cnt.n_min), 0) AS INTEGER) AS quota
      FROM mi JOIN r USING (doc_id), tot, cnt WHERE cnt.n_maj > cnt.n_min AND tot.s > 0),
pairs AS (SELECT a.doc_id, b.doc_id AS nb, list_distance(a.v, b.v) AS dist FROM mi a, mi b WHERE a.doc_id <> b.doc_id),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dist, nb) AS rank FROM pairs) WHERE rank <= 5),
nnn AS (SELECT doc_id, count(*) AS n_nb FROM nn GROUP BY doc_id),
ex AS (SELECT q.doc_id, q.v, unnest(range(1, CAST(q.quota AS BIGINT) + 1)) AS syn_index, nnn.n_nb FROM q JOIN nnn USING (doc_id) WHERE q.quota > 0),
ch AS (SELECT ex.*, CAST(floor({_u("'42:' || CAST(doc_id AS VARCHAR) || ':' || CAST(syn_index AS VARCHAR) || ':nb'")} * n_nb) + 1 AS BIGINT) AS rank,
              {_u("'42:' || CAST(doc_id AS VARCHAR) || ':' || CAST(syn_index AS VARCHAR) || ':gap'")} AS gap FROM ex),
syn AS (SELECT ch.doc_id, ch.v AS x, nb_t.v AS y, ch.gap
        FROM ch JOIN nn ON ch.doc_id = nn.doc_id AND ch.rank = nn.rank JOIN mi nb_t ON nn.nb = nb_t.doc_id),
allrows AS (
  SELECT toxic, false AS is_synthetic, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in DOC_FEATURES)} FROM d
  UNION ALL
  SELECT 1, true, {", ".join(f"x[{i + 1}] + gap * (y[{i + 1}] - x[{i + 1}]) AS {c}" for i, c in enumerate(DOC_FEATURES))} FROM syn)
SELECT toxic, is_synthetic, count(*)::BIGINT AS n, {", ".join(f"round(avg({c}), {DP}) AS mean_{c}" for c in DOC_FEATURES)}
FROM allrows GROUP BY toxic, is_synthetic
"""


@register("adasyn_class_balance", ids=("IMB4",), sql=ADASYN_SQL)
def q_adasyn(spark, sf):
    d = doc_model_frame(spark, sf)
    s = adasyn(d, "toxic", DOC_FEATURES, "doc_id", k=5, seed=42)
    return s.groupBy("toxic", "is_synthetic").agg(F.count(F.lit(1)).alias("n"),
                                                  *[F.round(F.avg(c), DP).alias(f"mean_{c}") for c in DOC_FEATURES])


# ------------------------------------------------------------------ models
SURVEY_SPECS = [
    ModelSpec("logistic_regression", "lr", {"regParam": 0.01}, scale=True, balanced=True),
    ModelSpec("decision_tree", "dt", {"maxDepth": 8}, balanced=True),
    ModelSpec("random_forest", "rf", {"numTrees": 30, "maxDepth": 8}, balanced=True),
    ModelSpec("gradient_boosting", "gbt", {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1}, balanced=True),
    ModelSpec("linear_svm", "svc", {"regParam": 0.01}, scale=True, balanced=True),
]


@register("cv_benchmark_survey", ids=("MOD1", "MOD2", "MOD3", "MOD4", "MOD6", "MOD9", "MOD10", "AGG16", "TOP1", "SPL2", "IMB1"))
def q_cv(spark, sf):
    df = survey_model_frame(spark, sf, k=5)
    cv = cv_benchmark(df, SURVEY_SPECS, MODEL_FEATURES, "stunting_label", parallelism=4)
    return stats.leaderboard(summarize_cv(cv), "auc_mean")


@register("train_test_report", ids=("SPL1", "MOD3", "MET1", "MET2", "MET5", "MOD12", "TOP1", "SET2"))
def q_train_test(spark, sf):
    f = derive(survey_frame(spark, sf)).select(*CHILD_KEY, *MODEL_FEATURES, "stunting_label")
    # The split is one fold: prepared once, scored into one table, its metrics one plan.
    s = stratified_split(f, "stunting_label", CHILD_KEY, test=0.2, seed=42)
    report = split_report(s, SURVEY_SPECS, MODEL_FEATURES, "stunting_label")
    res = report.select("model", F.col("auc").alias("test_auc"), F.col("recall").alias("test_recall"),
                        F.col("precision").alias("test_precision"), F.col("f1").alias("test_f1"),
                        F.col("accuracy").alias("test_accuracy"), "brier")
    return quality_gate(stats.leaderboard(res, "test_auc"), "test_auc")


@register("cv_benchmark_documents", ids=("MOD7", "MOD9", "IMB3", "MOD10"))
def q_cv_docs(spark, sf):
    d = stratified_folds(doc_model_frame(spark, sf), "toxic", "doc_id", k=5, seed=42)
    specs = [ModelSpec("mlp", "mlp", {"hidden": (128, 64, 32), "maxIter": 50}, scale=True),
             ModelSpec("random_forest", "rf", {"numTrees": 30}),
             ModelSpec("logistic_regression", "lr", {}, scale=True)]
    over = lambda tr, feats: smote(tr, "toxic", feats, "doc_id", k=5, seed=42) \
        .select("doc_id", *feats, "toxic")
    cv = cv_benchmark(d, specs, DOC_FEATURES, "toxic", oversample=over, parallelism=3)
    return stats.leaderboard(summarize_cv(cv), "auc_mean")


@register("cv_weighted_network_documents", ids=("MOD7", "IMB1", "MOD10"))
def q_cv_mlp(spark, sf):
    d = stratified_folds(doc_model_frame(spark, sf), "toxic", "doc_id", k=3, seed=42)
    cv = cv_benchmark(d, [ModelSpec("mlp_weighted", "mlp", {"hidden": (16, 8), "maxIter": 40}, scale=True, balanced=True),
                          ModelSpec("mlp_plain", "mlp", {"hidden": (16, 8), "maxIter": 40}, scale=True)],
                      DOC_FEATURES, "toxic", parallelism=2)
    return stats.leaderboard(summarize_cv(cv), "auc_mean")


_RESAMPLED_KEY = "'42:' || CAST(doc_id AS VARCHAR)"


@register("resampled_class_counts", ids=("MOD7", "IMB1"), sql=f"""
WITH k AS (SELECT toxic, count(*) AS m FROM labels GROUP BY toxic),
w AS (SELECT l.doc_id, l.toxic, (SELECT sum(m) FROM k) / ((SELECT count(*) FROM k) * k.m) AS w
      FROM labels l JOIN k ON l.toxic = k.toxic),
t AS (SELECT toxic, floor(w) + CASE WHEN {_u(_RESAMPLED_KEY)} < w - floor(w) THEN 1 ELSE 0 END AS times FROM w)
SELECT toxic, count(*)::BIGINT AS n_rows, CAST(sum(times) AS BIGINT) AS n_resampled FROM t GROUP BY toxic
""")
def q_resampled(spark, sf):
    rows = with_balanced_weights(table(spark, sf, "labels").select("doc_id", "toxic"), "toxic")
    got = resampled(rows, "__w", 42, ["doc_id"]).groupBy("toxic").agg(F.count(F.lit(1)).alias("n_resampled"))
    return rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n_rows")).join(got, "toxic", "left").select(
        "toxic", "n_rows", F.coalesce("n_resampled", F.lit(0)).cast("long").alias("n_resampled"))


@register("stacking_documents", ids=("MOD8", "SCO2"))
def q_stack(spark, sf):
    d = stratified_folds(doc_model_frame(spark, sf), "toxic", "doc_id", k=5, seed=42)
    specs = [ModelSpec("rf", "rf", {"numTrees": 30}), ModelSpec("gbt", "gbt", {"maxIter": 20})]
    sm = stack(d, ["doc_id"], specs, DOC_FEATURES, "toxic", passthrough=False)
    s = sm.score(d)
    return s.select("doc_id", "toxic", F.round(sm.prob_col, DP).alias("probability"))


@register("random_search_lr", ids=("MOD11",))
def q_search(spark, sf):
    d = stratified_folds(doc_model_frame(spark, sf), "toxic", "doc_id", k=3, seed=42)
    res, _ = random_search(d, "lr", {"regParam": [0.001, 0.01, 0.1, 1.0], "maxIter": [50, 100]}, 4,
                           DOC_FEATURES, "toxic", scale=True, balanced=True)
    return res


@register("ablation_oversampling", ids=("MOD13", "IMB3"))
def q_ablation(spark, sf):
    d = stratified_folds(doc_model_frame(spark, sf), "toxic", "doc_id", k=5, seed=42)
    over = lambda tr, feats: smote(tr, "toxic", feats, "doc_id", k=5, seed=42) \
        .select("doc_id", *feats, "toxic")
    rf = ModelSpec("rf", "rf", {"numTrees": 30})
    return ablation(d, {"rf_no_oversampling": {"spec": rf}, "rf_smote_in_fold": {"spec": rf, "oversample": over},
                        "rf_no_length": {"spec": rf, "features": DOC_FEATURES[1:]}}, DOC_FEATURES, "toxic")


# ------------------------------------------------------------------ fitted transformers
_PCA_COLS = ["wealth_index", "mother_education", "sanitation_score", "share_toilet", "electricity"]
_KMEANS_COLS = ["mother_age", "mother_bmi", "wealth_index", "mother_education", "child_age_months"]


@register("pca_kmeans_features", ids=("FEA11", "FEA12"))
def q_pca_km(spark, sf):
    # The linkage is run once and the split ranked once: both transformers and the output read them several times.
    f = kept(derive(survey_frame(spark, sf)).select(*CHILD_KEY, "stunting_label", *dict.fromkeys(_PCA_COLS + _KMEANS_COLS)))
    s = kept(stratified_split(f, "stunting_label", CHILD_KEY, test=0.2, seed=42))
    train = s.filter(F.col("split") == "train")
    pca = CentredPCA(inputCols=[*_PCA_COLS, "absent_column"], k=2, prefix="pca_socio_wash_").fit(train)
    km = KMeansDistance(inputCols=_KMEANS_COLS, k=5, seed=42, restarts=10).fit(train)
    out = km.transform(pca.transform(s))
    cols = [f"pca_socio_wash_{i}" for i in (1, 2)] + [f"kmeans_dist_{i}" for i in range(5)]
    return out.select(*CHILD_KEY, "split", *[F.round(c, DP).alias(c) for c in cols])


_CF_LEVELS = ["anc_visits", "diarrhea_recent", "fever_recent", "mother_education", "wealth_index", "mother_anemia",
              "share_toilet", "electricity"]
_CF_TEXT = ["toilet_type", "water_source", "delivery_place"]
_CF_PLAYERS = ["anc_visits", "diarrhea_recent", "fever_recent", "mother_education", "wealth_index", "mother_anemia", "mother_bmi",
               "share_toilet", "electricity", *_CF_TEXT]


def _cf_all_sql() -> str:
    from surveylab.operators.features import FEATURE_NAMES
    from surveylab.plans.catalog_score import _feat_cols_sql
    from surveylab.plans.survey import survey_sql
    keys = " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in CHILD_KEY)
    number = lambda i: (f"(('0x' || substr(md5('42:' || {keys} || ':' || CAST(cf_id AS VARCHAR) || ':{i // 8}'),"  # noqa: E731
                        f" {4 * (i % 8) + 1}, 4))::INTEGER / 65536.0)")
    tables, new, orig, moved, dist = [], [], [], [], []
    for c in _CF_LEVELS + _CF_TEXT:
        v = f"CAST({c} AS DOUBLE)" if c in _CF_LEVELS else c
        tables.append(f"l_{c} AS (SELECT list(v ORDER BY v) AS v, list(u ORDER BY v) AS u FROM (SELECT v, sum(n) OVER (ORDER BY v"
                      f" ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS u FROM (SELECT {v} AS v, count(*) AS n FROM survey"
                      f" WHERE {c} IS NOT NULL GROUP BY 1)))")
    grid = ", ".join(str(i / 20) for i in range(21))
    tables.append(f"l_mother_bmi AS (SELECT quantile_cont(mother_bmi, [{grid}]) AS v,"
                  " list_transform(range(1, 22), lambda i: i / 21.0) AS u FROM survey)")
    for i, c in enumerate(_CF_PLAYERS):
        was = c if c in _CF_TEXT else f"CAST({c} AS DOUBLE)"
        at = f"len(list_filter((SELECT u FROM l_{c}), lambda x: x <= {number(2 * i + 1)})) + 1"
        new.append(f"CASE WHEN {number(2 * i)} < 0.5 THEN (SELECT v FROM l_{c})[{at}] ELSE {was} END AS {c}")
        orig.append(f"{was.replace(c, 'fan.' + c)} AS o_{c}")
        moved.append(f"CAST({c} IS DISTINCT FROM o_{c} AS INTEGER)")
        step = "1.0" if c in _CF_TEXT else f"coalesce(abs({c} - o_{c}), 1.0)"
        dist.append(f"CASE WHEN {c} IS DISTINCT FROM o_{c} THEN {step} ELSE 0.0 END")
    return (survey_sql() + ",\n" + ",\n".join(tables) + f""",
f0 AS ({_feat_cols_sql()}),
hot AS (SELECT * EXCLUDE ({", ".join(FEATURE_NAMES)}, p0) FROM (SELECT f0.*, {SCORER.sql_prob()} AS p0 FROM f0) WHERE p0 > 0.45),
fan AS (SELECT hot.*, unnest(range(1, 11)) AS cf_id FROM hot),
cand0 AS (SELECT fan.* REPLACE ({", ".join(new)}), {", ".join(orig)} FROM fan),
cand AS (SELECT cand0.*, {" + ".join(moved)} AS n_changed, {" + ".join(dist)} AS distance FROM cand0),
cf AS ({_feat_cols_sql('cand')}),
sc AS (SELECT cf.*, {SCORER.sql_prob()} AS probability FROM cf),
ok AS (SELECT *, CASE WHEN probability < 0.40 AND n_changed > 0 THEN 'found' ELSE 'none' END AS status FROM sc),
rk AS (SELECT *, row_number() OVER (PARTITION BY {", ".join(CHILD_KEY)} ORDER BY status, n_changed, distance, cf_id) AS cf_rank
       FROM ok)
SELECT {", ".join(CHILD_KEY)}, CAST(cf_id AS INTEGER) AS cf_id, CAST(cf_rank AS INTEGER) AS cf_rank, n_changed, toilet_type,
       water_source, round(distance, {DP}) AS distance, round(probability, {DP}) AS probability, status
FROM rk WHERE cf_rank <= 2 AND (status = 'found' OR cf_rank = 1)
""")


@register("counterfactuals_all_columns", ids=("SIM5", "SIM7"), sql=_cf_all_sql())
def q_cf_all(spark, sf):
    s = survey_frame(spark, sf)
    cf = counterfactual.search(s, CHILD_KEY, SCORER, [*IMMUTABLE, "area", "stunting_label"], n=2, draws=10, seed=42,
                               p_min=0.45, p_target=0.40, derive=derive)
    return cf.select(*CHILD_KEY, "cf_id", "cf_rank", "n_changed", "toilet_type", "water_source",
                     F.round("distance", DP).alias("distance"), F.round("probability", DP).alias("probability"), "status")


_KM_COLS, _KM_K, _KM_SETS, _KM_ROUNDS = ["mother_age", "mother_bmi", "child_age_months"], 3, 2, 3


def _km_sql() -> str:
    from surveylab.plans.survey import survey_sql
    keys, d = ", ".join(CHILD_KEY), range(len(_KM_COLS))
    xs = ", ".join(f"CAST({c} AS DOUBLE) AS x{i}" for i, c in enumerate(_KM_COLS))
    away = " + ".join(f"(p.x{i} - c.x{i}) * (p.x{i} - c.x{i})" for i in d)
    # A child key may repeat, so that rows are numbered.
    q = [survey_sql() + f", pts AS (SELECT row_number() OVER () AS rid, {keys}, {xs} FROM survey WHERE "
         + " AND ".join(f"{c} IS NOT NULL" for c in _KM_COLS) + ")",
         f"c0 AS (SELECT r, n, x0, x1, x2 FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY "
         f"{sql_uniform(42, CHILD_KEY, 'CAST(r AS VARCHAR)')}, {keys}, x0, x1, x2) AS n FROM pts, (SELECT unnest(range(0, {_KM_SETS})) AS r))"
         f" WHERE n <= {_KM_K})"]
    for t in range(1, _KM_ROUNDS + 2):
        q.append(f"a{t} AS (SELECT * FROM (SELECT {', '.join(f'p.x{i}' for i in d)}, c.r, c.n, {away} AS away, row_number() OVER"
                 f" (PARTITION BY p.rid, c.r ORDER BY {away}, c.n) AS rk"
                 f" FROM pts p, c{t - 1} c) WHERE rk = 1)")
        if t <= _KM_ROUNDS:
            q.append(f"c{t} AS (SELECT c.r, c.n, " + ", ".join(f"coalesce(m.x{i}, c.x{i}) AS x{i}" for i in d) + f" FROM c{t - 1} c"
                     f" LEFT JOIN (SELECT r, n, " + ", ".join(f"avg(x{i}) AS x{i}" for i in d) + f" FROM a{t} GROUP BY r, n) m"
                     " ON c.r = m.r AND c.n = m.n)")
    q.append(f"best AS (SELECT r FROM (SELECT r, sum(away) AS cost FROM a{_KM_ROUNDS + 1} GROUP BY r) ORDER BY cost, r LIMIT 1)")
    q.append(f"o AS (SELECT c.* FROM c{_KM_ROUNDS} c JOIN best USING (r))")
    dist = ", ".join("round(sqrt(" + " + ".join(f"pow({c} - (SELECT x{i} FROM o WHERE n = {j + 1}), 2)"
                                                 for i, c in enumerate(_KM_COLS)) + f"), 4) AS kmeans_dist_{j}" for j in range(_KM_K))
    return ",\n".join(q) + f"\nSELECT {keys}, {dist} FROM survey"


@register("kmeans_distances_survey", ids=("FEA12",), sql=_km_sql())
def q_kmeans(spark, sf):
    f = survey_frame(spark, sf)
    km = KMeansDistance(inputCols=_KM_COLS, k=_KM_K, seed=42, restarts=_KM_SETS, maxIter=_KM_ROUNDS, tol=0.0,
                        keyCols=CHILD_KEY).fit(f)
    return km.transform(f).select(*CHILD_KEY, *[F.round(f"kmeans_dist_{j}", 4).alias(f"kmeans_dist_{j}") for j in range(_KM_K)])


def _mice_sql(rounds: int = 10) -> str:
    from surveylab.plans.catalog_prep import SURVEY_SIZE_SQL
    keys = ", ".join(CHILD_KEY)
    q = [SURVEY_SIZE_SQL + ",",
         "m0 AS (SELECT avg(CAST(hh_size AS DOUBLE)) AS a, avg(mother_bmi) AS b FROM ss),",
         f"s0 AS (SELECT {keys}, hh_size IS NULL AS ma, mother_bmi IS NULL AS mb,"
         " coalesce(CAST(hh_size AS DOUBLE), (SELECT a FROM m0)) AS hh_size,"
         " coalesce(mother_bmi, (SELECT b FROM m0)) AS mother_bmi FROM ss),"]
    prev = "s0"
    for r in range(1, rounds + 1):
        q.append(f"ca{r} AS (SELECT regr_slope(hh_size, mother_bmi) AS k, regr_intercept(hh_size, mother_bmi) AS c"
                 f" FROM {prev} WHERE NOT ma),")
        q.append(f"ta{r} AS (SELECT * REPLACE (CASE WHEN ma THEN (SELECT c FROM ca{r}) + (SELECT k FROM ca{r}) * mother_bmi"
                 f" ELSE hh_size END AS hh_size) FROM {prev}),")
        q.append(f"cb{r} AS (SELECT regr_slope(mother_bmi, hh_size) AS k, regr_intercept(mother_bmi, hh_size) AS c"
                 f" FROM ta{r} WHERE NOT mb),")
        q.append(f"s{r} AS (SELECT * REPLACE (CASE WHEN mb THEN (SELECT c FROM cb{r}) + (SELECT k FROM cb{r}) * hh_size"
                 f" ELSE mother_bmi END AS mother_bmi) FROM ta{r}),")
        prev = f"s{r}"
    q[-1] = q[-1].rstrip(",")
    return "\n".join(q) + (f"\nSELECT {keys}, round(hh_size, {DP}) AS hh_size, round(mother_bmi, {DP}) AS mother_bmi"
                           f" FROM {prev}")


@register("mice_two_columns", ids=("IMP4",), sql=_mice_sql())
def q_mice(spark, sf):
    df = _survey_with_size(spark, sf).select(*CHILD_KEY, "hh_size", "mother_bmi", "wealth_index")
    out = mice(df, ["hh_size", "mother_bmi"], rounds=10)
    return out.select(*CHILD_KEY, F.round("hh_size", DP).alias("hh_size"), F.round("mother_bmi", DP).alias("mother_bmi"))


# ------------------------------------------------------------------ sampled attribution / counterfactuals
def _mice3_sql(rounds: int = 10) -> str:
    """Chained equations over three columns of the linked table, two predictors each, by their normal equations."""
    from surveylab.plans.catalog_prep import P_SIZE_SQL
    from surveylab.plans.linked import linked_sql
    keys, cols = ", ".join(CHILD_KEY), ["l_quantity", "c_acctbal", "p_size"]
    q = [f"WITH linked AS ({linked_sql()}), t AS (SELECT {keys}, CAST(l_quantity AS DOUBLE) AS l_quantity,"
         f" CAST(c_acctbal AS DOUBLE) AS c_acctbal, CAST({P_SIZE_SQL} AS DOUBLE) AS p_size"
         " FROM linked JOIN part ON l_partkey = p_partkey)",
         f"s0 AS (SELECT {keys}, " + ", ".join(f"{c} IS NULL AS m_{c}, coalesce({c}, (SELECT avg({c}) FROM t)) AS {c}"
                                               for c in cols) + " FROM t)"]
    prev = "s0"
    for r in range(1, rounds + 1):
        for c in cols:
            a, b = (x for x in cols if x != c)
            name = f"{c}_{r}"
            q.append(f"g_{name} AS (SELECT avg({c}) AS my, avg({a}) AS ma, avg({b}) AS mb, covar_pop({a}, {a}) AS aa,"
                     f" covar_pop({b}, {b}) AS bb, covar_pop({a}, {b}) AS ab, covar_pop({a}, {c}) AS ay,"
                     f" covar_pop({b}, {c}) AS yb FROM {prev} WHERE NOT m_{c})")
            q.append(f"k_{name} AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS ka,"
                     f" (yb * aa - ay * ab) / (aa * bb - ab * ab) AS kb FROM g_{name})")
            q.append(f"s_{name} AS (SELECT s.* REPLACE (CASE WHEN m_{c} THEN k.my + k.ka * (s.{a} - k.ma) + k.kb * (s.{b} - k.mb)"
                     f" ELSE s.{c} END AS {c}) FROM {prev} s, k_{name} k)")
            prev = f"s_{name}"
    return ",\n".join(q) + f"\nSELECT {keys}, " + ", ".join(f"round({c}, {DP}) AS {c}" for c in cols) + f" FROM {prev}"


@register("mice_three_columns", ids=("IMP4",), sql=_mice3_sql())
def q_mice3(spark, sf):
    p = clean.null_sentinels(table(spark, sf, "part").select("p_partkey", "p_size"), SENTINELS)
    df = link.link_records(linked_frame(spark, sf), p, [("l_partkey", "p_partkey")])
    cols = ["l_quantity", "c_acctbal", "p_size"]
    return mice(df.select(*CHILD_KEY, *cols), cols).select(*CHILD_KEY, *[F.round(c, DP).alias(c) for c in cols])


def _forest_attribution(spark, sf, how):
    """Global importance of a forest's features: all test rows against 50 seeded training rows (the original's size)."""
    d = kept(doc_model_frame(spark, sf))
    s = stratified_split(d, "toxic", "doc_id", test=0.2, seed=42)
    train, test = s.filter(F.col("split") == "train"), s.filter(F.col("split") == "test")
    model = fit(ModelSpec("rf", "rf", {"numTrees": 30}), train, DOC_FEATURES, "toxic")
    return global_importance(how(test, model, stats.sample_n(train, 50, 42, "doc_id")), 15)


@register("attribution_forest_test_rows", ids=("EXP8", "EXP6", "TOP5"))
def q_attr_rf(spark, sf):
    return _forest_attribution(spark, sf, lambda rows, model, bg: attribute_trees(rows, "doc_id", DOC_FEATURES, model, bg))


@register("attribution_sampled_test_rows", ids=("EXP1", "EXP6", "TOP5"))
def q_attr_sampled(spark, sf):
    return _forest_attribution(spark, sf, lambda rows, model, bg: attribute(
        rows, "doc_id", DOC_FEATURES, ModelScorer(model), bg, permutations=3, seed=42))


def _cf_sql():
    from surveylab.operators.features import FEATURE_NAMES
    from surveylab.plans.catalog_score import _feat_cols_sql
    from surveylab.plans.survey import survey_sql
    keys = " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in CHILD_KEY)
    u = lambda tag: _u(f"'42:' || {keys} || ':' || CAST(cf_id AS VARCHAR) || ':{tag}'")
    levels = {"mother_education": [0, 1, 2, 3], "mother_anemia": [0, 1, 2, 3], "share_toilet": [0, 1]}
    cont = {"anc_visits": ("lo_a", "hi_a"), "mother_bmi": ("lo_b", "hi_b")}
    rep, orig, changed, dist = [], [], [], []
    for c, (lo, hi) in cont.items():
        rep.append(f"CASE WHEN {u(c + ':pick')} < 0.5 THEN round({lo} + {u(c)} * ({hi} - {lo}), 0) "
                   f"ELSE CAST({c} AS DOUBLE) END AS {c}")
    for c, lv in levels.items():
        arr = "[" + ", ".join(f"{float(x)}" for x in lv) + "]"
        rep.append(f"CASE WHEN {u(c + ':pick')} < 0.5 THEN ({arr}::DOUBLE[])[CAST(floor({u(c)} * {len(lv)}) AS INTEGER) + 1] "
                   f"ELSE CAST({c} AS DOUBLE) END AS {c}")
    for c in list(cont) + list(levels):
        orig.append(f"CAST(fan.{c} AS DOUBLE) AS o_{c}")
        changed.append(f"CAST({c} IS DISTINCT FROM o_{c} AS INTEGER)")
        dist.append(f"coalesce(abs({c} - o_{c}), 0.0)")
    feats = ", ".join(FEATURE_NAMES)
    return (survey_sql() + f""",
f0 AS ({_feat_cols_sql()}),
hot AS (SELECT * EXCLUDE ({feats}, p0) FROM (SELECT f0.*, {SCORER.sql_prob()} AS p0 FROM f0) WHERE p0 > 0.35),
rng AS (SELECT min(anc_visits) AS lo_a, max(anc_visits) AS hi_a, min(mother_bmi) AS lo_b, max(mother_bmi) AS hi_b FROM survey),
fan AS (SELECT hot.*, unnest(range(1, 21)) AS cf_id FROM hot),
cand0 AS (SELECT fan.* REPLACE ({", ".join(rep)}), {", ".join(orig)} FROM fan, rng),
cand AS (SELECT cand0.*, {" + ".join(changed)} AS n_changed, {" + ".join(dist)} AS distance FROM cand0),
cf AS ({_feat_cols_sql('cand')}),
sc AS (SELECT cf.*, {SCORER.sql_prob()} AS probability FROM cf),
ok AS (SELECT *, CASE WHEN probability < 0.40 AND n_changed > 0 THEN 'found' ELSE 'none' END AS status FROM sc),
rk AS (SELECT *, row_number() OVER (PARTITION BY {", ".join(CHILD_KEY)} ORDER BY status, n_changed, distance, cf_id) AS cf_rank
       FROM ok)
SELECT {", ".join(CHILD_KEY)}, CAST(cf_id AS INTEGER) AS cf_id, CAST(cf_rank AS INTEGER) AS cf_rank, n_changed,
       round(distance, {DP}) AS distance, round(probability, {DP}) AS probability, status
FROM rk WHERE cf_rank <= 2 AND (status = 'found' OR cf_rank = 1)
""")


@register("counterfactuals_linear", ids=("SIM5", "SIM7"), sql=_cf_sql())
def q_cf(spark, sf):
    s = survey_frame(spark, sf)
    mut = [c for c in mutable_columns(s, IMMUTABLE) if c in ("anc_visits", "mother_bmi")]
    cf = counterfactuals(s, CHILD_KEY, mut, {"mother_education": [0, 1, 2, 3], "mother_anemia": [0, 1, 2, 3],
                                             "share_toilet": [0, 1]},
                         SCORER, n=2, draws=20, seed=42, p_min=0.35, p_target=0.40, derive=derive)
    return cf.select(*CHILD_KEY, "cf_id", "cf_rank", "n_changed", F.round("distance", DP).alias("distance"),
                     F.round("probability", DP).alias("probability"), "status")


