"""Derived features (FEA1-FEA13).

Row-local features are plain expressions added in **one** ``withColumns``
projection (no UDF, one codegen stage). ``roles`` maps a role name to a
column so the same functions run on any table; an absent role falls back to
the documented default (PRJ5).
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveylab.functions.expr import clamp, flag, nan_to_null, uniform
from surveylab.session import kept

# Role defaults used when a role column is absent (as the
# reference's feature builder does), and its risk cut points.
ROLE_DEFAULTS = {
    "open_defecation": 0.0, "share_toilet": 0.0, "diarrhea": 0.0, "fever": 0.0,
    "mother_age": 25.0, "mother_education": 1.0, "mother_anemia": 0.0, "mother_bmi": 20.0,
    "birth_order": 1.0, "birth_interval": 30.0, "wealth": 3.0, "child_age": 24.0, "anc_visits": 2.0,
}
ANC_ADEQUATE = 4.0
LOW_BMI = 18.5
YOUNG_MOTHER, OLD_MOTHER = 20.0, 35.0
HIGH_ORDER, SHORT_INTERVAL = 3.0, 24.0
CRITICAL_AGE = (6.0, 24.0)

FEATURE_NAMES = [
    "sanitation_score", "anc_adequacy_flag", "disease_burden_index", "maternal_vulnerability_score",
    "child_vulnerability_score", "wealth_education_synergy", "unsafe_water_diarrhea_pathway",
    "bmi_anemia_synergy", "child_age_x_wealth", "education_x_anc", "child_age_log", "is_critical_age",
    "mother_bmi_sq", "wash_age_synergy", "wealth_edu_anc_triple", "mother_age_group",
]


def _role(df: DataFrame, roles: Mapping[str, str], name: str) -> Column:
    c = roles.get(name)
    if c is not None and c in df.columns:
        return nan_to_null(F.col(c).cast("double"))
    return F.lit(ROLE_DEFAULTS.get(name)).cast("double")


def _filled(df, roles, name) -> Column:
    return F.coalesce(_role(df, roles, name), F.lit(ROLE_DEFAULTS[name]))


def sanitation_score(df, roles) -> Column:
    """FEA1: 2 × open-defecation flag + shared toilet (NULL -> 0)."""
    return _filled(df, roles, "open_defecation") * 2.0 + _filled(df, roles, "share_toilet")


def anc_adequacy(df, roles) -> Column:
    """FEA2: visits >= 4, NULL -> 0."""
    return flag(_role(df, roles, "anc_visits") >= ANC_ADEQUATE)


def disease_burden(df, roles) -> Column:
    """FEA3: diarrhoea + fever, NULLs as 0."""
    return _filled(df, roles, "diarrhea") + _filled(df, roles, "fever")


def maternal_vulnerability(df, roles) -> Column:
    """FEA4: age risk + education risk + anaemia grade + 2 × low BMI."""
    age = _role(df, roles, "mother_age")
    edu = _role(df, roles, "mother_education")
    return (flag((age < YOUNG_MOTHER) | (age > OLD_MOTHER))
            + flag(edu == 0) * 1.5 + flag(edu == 1) * 0.5
            + _filled(df, roles, "mother_anemia")
            + flag(_filled(df, roles, "mother_bmi") < LOW_BMI) * 2.0)


def child_vulnerability(df, roles) -> Column:
    """FEA5: 1.5 × [order > 3] + 1.5 × [interval < 24]."""
    return (flag(_role(df, roles, "birth_order") > HIGH_ORDER) * 1.5
            + flag(_role(df, roles, "birth_interval") < SHORT_INTERVAL) * 1.5)


def unsafe_water_flag(df, roles, unsafe_levels: Sequence[str]) -> Column:
    """FEA7: the water source is one of the unsafe levels (a parameter)."""
    c = roles.get("water_source")
    if c is None or c not in df.columns:
        return F.lit(0.0)
    return flag(F.col(c).cast("string").isin(list(unsafe_levels)))


def age_group(age: Column) -> Column:
    """FEA10: clamp(floor((age - 15) / 5) + 1, 1, 7) (floor, not truncation)."""
    return clamp(F.floor((age - 15.0) / 5.0) + 1, 1, 7).cast("int")


def add_features(df: DataFrame, roles: Mapping[str, str], unsafe_levels: Sequence[str] = (),
                 open_defecation_level: str | None = None) -> DataFrame:
    """FEA1-FEA10 in one projection.

    ``open_defecation_level`` (with role ``toilet_type``) derives the
    open-defecation flag from a nominal column when no indicator column is
    mapped.
    """
    roles = dict(roles)
    if "open_defecation" not in roles and open_defecation_level is not None and roles.get("toilet_type") in df.columns:
        df = df.withColumn("__open_def", flag(F.col(roles["toilet_type"]).cast("string") == F.lit(open_defecation_level)))
        roles["open_defecation"] = "__open_def"
    wealth = _role(df, roles, "wealth")
    edu = _role(df, roles, "mother_education")
    anc = _role(df, roles, "anc_visits")
    child_age = _role(df, roles, "child_age")
    bmi = _filled(df, roles, "mother_bmi")
    anemia = _filled(df, roles, "mother_anemia")
    san = sanitation_score(df, roles)
    crit = flag(child_age.between(*CRITICAL_AGE))
    exprs = {
        "sanitation_score": san,
        "anc_adequacy_flag": anc_adequacy(df, roles),
        "disease_burden_index": disease_burden(df, roles),
        "maternal_vulnerability_score": maternal_vulnerability(df, roles),
        "child_vulnerability_score": child_vulnerability(df, roles),
        "wealth_education_synergy": wealth * edu,                                   # FEA6 / FEA9
        "unsafe_water_diarrhea_pathway": unsafe_water_flag(df, roles, unsafe_levels) * _filled(df, roles, "diarrhea"),
        "bmi_anemia_synergy": flag(bmi < LOW_BMI) * anemia,
        "child_age_x_wealth": child_age * wealth,
        "education_x_anc": edu * anc,
        "child_age_log": F.log1p(child_age),                                       # FEA8
        "is_critical_age": crit,
        "mother_bmi_sq": F.pow(bmi, 2),
        "wash_age_synergy": san * crit,
        "wealth_edu_anc_triple": wealth * edu * anc,
        "mother_age_group": age_group(_role(df, roles, "mother_age")),             # FEA10
    }
    out = df.withColumns(exprs)
    return out.drop("__open_def") if "__open_def" in out.columns else out


def first_present(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """FEA9: the first candidate column name present (plan-time lookup)."""
    return next((c for c in candidates if c in df.columns), None)


def feature_labels(long_df: DataFrame, dictionary: DataFrame, code_col: str = "feature_code",
                   dict_code: str = "feature_code", dict_name: str = "feature_name") -> DataFrame:
    """FEA13: attach readable names; unknown codes keep the code.

    The dictionary has a row per feature and is sent to the rows: dealt by
    feature, a long table would land in as many tasks as there are features.
    """
    d = dictionary.select(F.col(dict_code).alias("__code"), F.col(dict_name).alias("__name"))
    return (long_df.join(F.broadcast(d), long_df[code_col] == F.col("__code"), "left")
            .withColumn("feature_name", F.coalesce(F.col("__name"), F.col(code_col)))
            .drop("__code", "__name"))


# ---------------------------------------------------------------- FEA11 / FEA12
class _VecParams(HasInputCols):
    prefix = Param(Params._dummy(), "prefix", "output column prefix", typeConverter=TypeConverters.toString)
    k = Param(Params._dummy(), "k", "components / clusters", typeConverter=TypeConverters.toInt)
    centre = Param(Params._dummy(), "centre", "column means", typeConverter=TypeConverters.toListFloat)
    loadings = Param(Params._dummy(), "loadings", "row-major k × d matrix", typeConverter=TypeConverters.toListFloat)
    seed = Param(Params._dummy(), "seed", "random seed", typeConverter=TypeConverters.toInt)
    restarts = Param(Params._dummy(), "restarts", "k-means restarts", typeConverter=TypeConverters.toInt)


def _present(cols, df):
    return [c for c in cols if c in df.columns]


class CentredPCA(Estimator, _VecParams, DefaultParamsReadable, DefaultParamsWritable):
    """FEA11: principal components of centred columns, fitted on training rows.

    Centring uses the fitted means (Spark's PCA does not centre at
    transform); each component's sign is fixed so its largest absolute
    loading is positive. Absent columns are skipped; with none, the outputs
    are 0. The transform is pure column arithmetic.
    """

    @keyword_only
    def __init__(self, *, inputCols=None, k=2, prefix="pca_"):
        super().__init__()
        self._setDefault(k=2, prefix="pca_")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "CentredPCAModel":
        from pyspark.ml.feature import PCA, VectorAssembler
        cols = _present(self.getInputCols(), dataset)
        k = self.getOrDefault(self.k)
        if not cols:
            return CentredPCAModel(inputCols=[], k=k, centre=[], loadings=[],
                                   prefix=self.getOrDefault(self.prefix))
        row = dataset.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).first()
        centre = [float(row[c] or 0.0) for c in cols]
        centred = dataset.select(*[(F.col(c).cast("double") - F.lit(m)).alias(c) for c, m in zip(cols, centre)])
        vec = VectorAssembler(inputCols=cols, outputCol="__v", handleInvalid="skip").transform(centred)
        kk = min(k, len(cols))
        pc = PCA(k=kk, inputCol="__v").fit(vec).pc.toArray()  # d × kk
        load = []
        for j in range(kk):
            col = [float(pc[i, j]) for i in range(len(cols))]
            big = max(range(len(col)), key=lambda i: abs(col[i]))
            s = -1.0 if col[big] < 0 else 1.0
            load += [s * x for x in col]
        # only the present columns are kept (no _copyValues: it would restore absent ones)
        return CentredPCAModel(inputCols=cols, k=k, centre=centre, loadings=load,
                               prefix=self.getOrDefault(self.prefix))


class CentredPCAModel(Model, _VecParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCols=None, k=2, centre=None, loadings=None, prefix="pca_"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cols = self.getInputCols()
        k = self.getOrDefault(self.k)
        centre, load = self.getOrDefault(self.centre), self.getOrDefault(self.loadings)
        d = len(cols)
        out = {}
        for j in range(k):
            name = f"{self.getOrDefault(self.prefix)}{j + 1}"
            if d == 0 or (j + 1) * d > len(load):
                out[name] = F.lit(0.0)
                continue
            e = F.lit(0.0)
            for i, c in enumerate(cols):
                e = e + (F.col(c).cast("double") - F.lit(centre[i])) * F.lit(load[j * d + i])
            out[name] = e
        return dataset.withColumns(out)


def _draw(seed: int, restart: Column, keys: Sequence[str], cols: Sequence[str]) -> Column:
    """Seeded draw of a row, by its key columns or else by its values."""
    own = [F.col(k) for k in keys] if keys else [F.xxhash64(*cols)]
    return uniform(seed, *own, restart)


class KMeansDistance(Estimator, _VecParams, DefaultParamsReadable, DefaultParamsWritable):
    """FEA12: Euclidean distance to each of k k-means centres (unscaled columns).

    ``restarts`` sets of centres start at the k rows with the least seeded draws
    each and are advanced together: one aggregate a round assigns every row to
    its nearest centre of every set and gives the new centres (k x restarts
    rows) and costs. Rounds end after ``maxIter``, or when no centre has moved
    by more than ``tol``. The set with the least cost is kept (the first of
    equal ones). A centre without rows stays where it is. Rows with NULL inputs
    are skipped at fit time. ``keyCols`` name the rows in the draws (default: their values).
    """

    maxIter = Param(Params._dummy(), "maxIter", "most rounds", typeConverter=TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "greatest move of a centre that ends the rounds", typeConverter=TypeConverters.toFloat)
    keyCols = Param(Params._dummy(), "keyCols", "columns that name a row", typeConverter=TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCols=None, k=5, seed=42, restarts=10, prefix="kmeans_dist_", maxIter=20, tol=1e-4, keyCols=()):
        super().__init__()
        self._setDefault(k=5, seed=42, restarts=10, prefix="kmeans_dist_", maxIter=20, tol=1e-4, keyCols=[])
        self._input_kwargs["keyCols"] = list(keyCols)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "KMeansDistanceModel":
        import numpy as np
        get = self.getOrDefault
        cols = _present(self.getInputCols(), dataset)
        k, seed, sets, d = get(self.k), get(self.seed), get(self.restarts), len(cols)
        if not cols:
            return KMeansDistanceModel(inputCols=[], k=k, centre=[], prefix=get(self.prefix))
        keys = [c for c in get(self.keyCols) if c not in cols]
        rows = kept(dataset.select(*keys, *[nan_to_null(F.col(c).cast("double")).alias(c) for c in cols]).na.drop(subset=cols))
        # Every task keeps the k least rows of each set; no row is sorted or sent that is not among them.
        fan = functools.reduce(DataFrame.unionAll, [
            rows.withColumn("__r", F.lit(r)).withColumn("__u", _draw(seed, F.lit(r), get(self.keyCols), cols))
            .orderBy("__u", *keys, *cols).limit(k) for r in range(sets)])
        order = Window.partitionBy("__r").orderBy("__u", *keys, *cols)
        first = fan.withColumn("__n", F.row_number().over(order)).select("__r", "__n", *cols).collect()
        if not first:
            return KMeansDistanceModel(inputCols=cols, k=0, centre=[], prefix=get(self.prefix))
        k = max(r["__n"] for r in first)  # fewer rows than centres: as many centres as rows
        centres = np.zeros((sets, k, d))
        for r in first:
            centres[r["__r"], r["__n"] - 1] = [r[c] for c in cols]
        for _ in range(get(self.maxIter)):
            _, counts, sums = self._advance(rows, cols, centres)
            moved = np.where(counts[:, :, None] > 0, sums / np.maximum(counts, 1)[:, :, None], centres)
            step, centres = np.sqrt(((moved - centres) ** 2).sum(2)).max(), moved
            if step <= get(self.tol):
                break
        cost = self._advance(rows, cols, centres)[0]
        best = centres[int(np.argmin(cost))]
        return KMeansDistanceModel(inputCols=cols, k=k, centre=[float(x) for x in best.ravel()], prefix=get(self.prefix))

    @staticmethod
    def _advance(rows: DataFrame, cols: Sequence[str], centres):
        """(cost of each set, rows of each centre, their sums) of one pass."""
        import numpy as np
        sets, k, d = centres.shape

        def part(batches):
            """The sums of one task's rows: a row for each centre. Few rows at a time, in arrays that are used again."""
            import pyarrow as pa
            most, planes = 4096, centres.transpose(1, 0, 2).reshape(k, sets, d, 1)  # a plane for each centre of the sets
            cost, counts, sums = np.zeros(sets * k), np.zeros(sets * k, "i8"), np.zeros((sets * k, d))
            first = k * np.arange(sets)[:, None]
            held = [np.empty((sets, most)) for _ in range(3)] + [np.empty((sets, most), "i8"), np.empty((sets, most), bool)]
            for b in batches:
                whole = [c.to_numpy(zero_copy_only=False) for c in b.columns]
                for at in range(0, len(whole[0]), most):
                    x = [c[at:at + most] for c in whole]
                    step, away, least, near, nearer = (h[:, :len(x[0])] for h in held)
                    near[:] = 0
                    for j in range(k):
                        to = away if j else least
                        to[:] = 0.0
                        for i in range(d):
                            np.subtract(planes[j, :, i], x[i], out=step)
                            np.multiply(step, step, out=step)
                            np.add(to, step, out=to)
                        if j:
                            np.less(away, least, out=nearer)  # the first of equally near ones stays
                            np.minimum(least, away, out=least)
                            np.putmask(near, nearer, j)
                    own = (near + first).ravel()
                    cost += np.bincount(own, least.ravel(), sets * k)
                    counts += np.bincount(own, minlength=sets * k)
                    for i in range(d):
                        sums[:, i] += np.bincount(own, np.tile(x[i], sets), sets * k)
            at = np.nonzero(counts)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array((at // k).astype("i4")), pa.array((at % k).astype("i4")), pa.array(cost[at]), pa.array(counts[at]),
                 *[pa.array(sums[at, i]) for i in range(d)]], ["r", "j", "cost", "n", *[f"s{i}" for i in range(d)]])

        schema = "r int, j int, cost double, n long, " + ", ".join(f"s{i} double" for i in range(d))
        got = rows.select(*cols).mapInArrow(part, schema).groupBy("r", "j").agg(
            F.sum("cost").alias("cost"), F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(d)]).collect()
        cost, counts, sums = np.zeros(sets), np.zeros((sets, k)), np.zeros((sets, k, d))
        for g in got:  # a row for each centre
            cost[g["r"]] += g["cost"]
            counts[g["r"], g["j"]] = g["n"]
            sums[g["r"], g["j"]] = [g[f"s{i}"] for i in range(d)]
        return cost, counts, sums


class KMeansDistanceModel(Model, _VecParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCols=None, k=5, centre=None, prefix="kmeans_dist_"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cols = self.getInputCols()
        k, cen = self.getOrDefault(self.k), self.getOrDefault(self.centre)
        d = len(cols)
        out = {}
        for j in range(k):
            name = f"{self.getOrDefault(self.prefix)}{j}"
            if d == 0:
                out[name] = F.lit(0.0)
                continue
            s = F.lit(0.0)
            for i, c in enumerate(cols):
                step = F.col(c).cast("double") - F.lit(cen[j * d + i])
                s = s + step * step
            out[name] = F.sqrt(s)
        return dataset.withColumns(out)
