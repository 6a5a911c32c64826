"""Model queries (SURVEY §2.11, §2.5 agg_importance_*, agg_effect_pivot, §2.8 top_*,
§2.9 set_shared/unique_features, §2.7 win_importance_rank)."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from ..operators import linear as L
from ..operators import ml as ML
from ..operators.joins import grown
from ..operators.model_store import ModelRegistry
from ..session import checkpoint_dir, scratch_path
from ..sources import tables as T
from ..sources.files import memo
from .common import rounded
from .feature_plans import _MAT_COLS, _MATRIX_SQL, _stored_matrix as _matrix
from .registry import register

TARGETS = ["target_peak_shaving_benefit", "target_energy_procurement_optimization", "target_trading_revenue"]
MODELS = [t.replace("target_", "") for t in TARGETS]
FEATURES = list(_MAT_COLS)
_M = len(FEATURES)
_U = [f"u{i}" for i in range(_M)]


class _Models:
    """The ridge models of a data directory: moments, fits and labelled rows over the stored matrix."""

    def __init__(self, spark, sf):
        mat = _matrix(spark, sf).withColumnsRenamed(dict(zip(TARGETS, MODELS)))
        self.middle = L.medians(mat, FEATURES)
        self.rows = L.labelled(mat, FEATURES, MODELS, self.middle)
        # a row per client and target, read by the moments and by every hold-out query
        path = scratch_path(spark, f"sides-{uuid.uuid4().hex}")
        L.sides(mat, MODELS).write.parquet(path)
        self.sides = spark.read.parquet(path)
        # a row per client, joined before a configuration becomes a row per target; stored, since
        # the fits and every query on them go through these rows, and the join moves the matrix
        L.by_client(self.sides).write.parquet(f"{path}-by-client")
        both = grown(mat.select("config_id", "client_name", *FEATURES, *MODELS), spark.read.parquet(f"{path}-by-client"), "client_name")
        both.write.option("compression", "zstd").parquet(f"{path}-rows")
        both = spark.read.schema(both.schema).parquet(f"{path}-rows")
        self.known = L.labelled(both, FEATURES, MODELS, self.middle, keep=("_sides",)).where("y IS NOT NULL") \
            .withColumn("_side", F.col("_sides")[F.col("target")]).where("_side IS NOT NULL").select("*", "_side.*").drop("_side", "_sides")
        self.moments = L.moments(self.known, _M)
        self.fits, self.scales = L.fit(self.moments, MODELS)

    def held_out(self):
        return self.known.where("is_test")


def _models(spark, sf) -> _Models:
    """The models of the driver tables as they are now: fitted once, used by every query."""
    return memo(spark, ("models", checkpoint_dir(spark), T.tag(spark, sf)), lambda: _Models(spark, sf))


def trained_registry(spark, sf) -> ModelRegistry:
    """A registry with a ridge model of every target, trained on the stored matrix: hold-out
    metrics, cross-validation scores and |coefficient|·scale importances with each."""
    m = _models(spark, sf)
    registry = ModelRegistry(spark, scratch_path(spark, f"registry-{uuid.uuid4().hex}"))
    test = {r["target"]: r.asDict() for r in ML.metrics(L.predictions(m.held_out(), m.fits)).collect()}
    folds = spark.createDataFrame(L.cross_validated(m.moments, m.scales), "target string, fold int, n long, r2 double")
    cv = {r["target"]: r.asDict() for r in ML.cv_summary(folds, ("target",)).collect()}
    for f in m.fits:
        importance = {x: abs(c) * s for x, c, s in zip(FEATURES, f.coef, m.scales[f.target])}
        score = {k: v for k, v in {**test.get(f.target, {}), **cv.get(f.target, {})}.items() if k != "target"}
        registry.register(f.target, L.as_dict(f, FEATURES, m.middle), score, importance, FEATURES, {"alpha": L.ALPHA}, f.n)
    return registry


def _contrib(spark, sf):
    """Contributions of every feature on the hold-out clients, against the training mean."""
    m = _models(spark, sf)
    return L.contributions(m.held_out(), m.fits, FEATURES, m.middle)


def _contrib_wide(spark, sf, only=None):
    """The same, a row per hold-out row and target."""
    m = _models(spark, sf)
    return L.contributions(m.held_out(), m.fits, FEATURES, m.middle, wide=True, only=only)


def _stats(spark, sf):
    """Contribution statistics per (target, feature), with corr(x, contribution)."""
    return ML.contribution_stats(_contrib(spark, sf))


def _imp(spark, sf):
    return ML.importance_from_stats(_stats(spark, sf))


# --- oracle building blocks: DuckDB gathers the moments and solves the systems itself ------
_T = " UNION ALL ".join(
    f"SELECT config_id, client_name, '{m}' AS target, {t} AS y, {', '.join(_U)} FROM shifted" for t, m in zip(TARGETS, MODELS))
_Z = ["1.0", *_U, "y"]
_PAIRS = [(i, j) for i in range(_M + 2) for j in range(i, _M + 2)]
_DIGITS = "CAST(printf('%.{}e', {}) AS DOUBLE)"
_FIT = _MATRIX_SQL.replace("mat AS (", "mat AS MATERIALIZED (") + f""",
med AS (SELECT {", ".join(f"coalesce(median({f}), 0) AS m{i}" for i, f in enumerate(FEATURES))} FROM mat),
shifted AS MATERIALIZED (SELECT config_id, client_name, {", ".join(TARGETS)},
  {", ".join(f"coalesce({f}, m{i}) - m{i} AS u{i}" for i, f in enumerate(FEATURES))} FROM mat, med),
every AS ({_T}),
cl AS (SELECT target, client_name, count(*) AS n, md5('42:' || client_name) AS h FROM every WHERE y IS NOT NULL GROUP BY ALL),
dealt AS (SELECT target, client_name, row_number() OVER (PARTITION BY target ORDER BY h) <= ceil(0.2 * count(*) OVER (PARTITION BY target)) AS is_test,
                 row_number() OVER (PARTITION BY target ORDER BY n DESC, h) - 1 AS pos,
                 CASE WHEN count(*) OVER (PARTITION BY target) <= 5 THEN count(*) OVER (PARTITION BY target) ELSE 5 END AS k FROM cl),
sides AS (SELECT target, client_name, is_test, CASE WHEN (pos // k) % 2 = 1 THEN k - 1 - pos % k ELSE pos % k END AS fold FROM dealt),
known AS MATERIALIZED (SELECT every.*, is_test, fold FROM every JOIN sides USING (target, client_name) WHERE y IS NOT NULL),
parts AS (SELECT target, is_test, fold, unnest([{", ".join(f"fsum({_Z[i]} * {_Z[j]})" for i, j in _PAIRS)}]) AS v,
                 unnest({[i for i, _ in _PAIRS]}) AS i, unnest({[j for _, j in _PAIRS]}) AS j FROM known GROUP BY target, is_test, fold),
folds AS (SELECT DISTINCT target, fold FROM parts),
half AS (SELECT target, -1 AS kind, i, j, fsum(v) AS v FROM parts WHERE NOT is_test GROUP BY target, i, j
         UNION ALL SELECT p.target, f.fold, i, j, fsum(v) FROM parts p JOIN folds f ON f.target = p.target AND f.fold <> p.fold
         GROUP BY p.target, f.fold, i, j),
mom AS MATERIALIZED (SELECT target, kind, i, j, v FROM half UNION ALL SELECT target, kind, j, i, v FROM half WHERE i <> j),
edge AS (SELECT target, kind, i, v / n AS mean, n FROM mom JOIN (SELECT target, kind, v AS n FROM mom WHERE i = 0 AND j = 0) USING (target, kind) WHERE j = 0),
scale AS (SELECT m.target, m.i, CASE WHEN m.v / e.n - e.mean * e.mean > 1e-12 * m.v / e.n THEN sqrt(m.v / e.n - e.mean * e.mean) ELSE 1 END AS s
          FROM mom m JOIN edge e ON e.target = m.target AND e.kind = m.kind AND e.i = m.i
          WHERE m.kind = -1 AND m.i = m.j AND m.i BETWEEN 1 AND {_M}),
aug AS (SELECT m.target, m.kind, m.i, m.j, (m.v - a.mean * b.mean * a.n) / s.s / coalesce(t.s, 1) + CASE WHEN m.i = m.j THEN 1.0 ELSE 0 END AS v
        FROM mom m JOIN edge a ON a.target = m.target AND a.kind = m.kind AND a.i = m.i
        JOIN edge b ON b.target = m.target AND b.kind = m.kind AND b.i = m.j
        JOIN scale s ON s.target = m.target AND s.i = m.i LEFT JOIN scale t ON t.target = m.target AND t.i = m.j
        WHERE m.i BETWEEN 1 AND {_M} AND m.j >= 1),
gauss AS (SELECT 0 AS k, target, kind, i, j, CAST(v AS DOUBLE) AS v FROM aug
  UNION ALL
  SELECT k + 1, target, kind, i, j, CASE WHEN i = k + 1 THEN rv / piv ELSE v - cv * rv / piv END FROM (
    SELECT *, max(CASE WHEN i = k + 1 THEN v END) OVER (PARTITION BY target, kind, j) AS rv,
              max(CASE WHEN j = k + 1 THEN v END) OVER (PARTITION BY target, kind, i) AS cv,
              max(CASE WHEN i = k + 1 AND j = k + 1 THEN v END) OVER (PARTITION BY target, kind) AS piv FROM gauss) WHERE k < {_M}),
beta AS (SELECT g.target, g.kind, g.i, g.v / s.s AS coef, e.mean FROM gauss g JOIN scale s ON s.target = g.target AND s.i = g.i
         JOIN edge e ON e.target = g.target AND e.kind = g.kind AND e.i = g.i WHERE g.k = {_M} AND g.j = {_M} + 1),
base AS (SELECT target, kind, mean AS base FROM edge WHERE i = {_M} + 1),
model AS MATERIALIZED (SELECT target, {_DIGITS.format(9, "any_value(base)")} AS base,
  {", ".join(f"{_DIGITS.format(7, f'max(CASE WHEN i = {i + 1} THEN coef END)')} AS c{i}" for i in range(_M))},
  {", ".join(f"{_DIGITS.format(9, f'max(CASE WHEN i = {i + 1} THEN mean END)')} AS x{i}" for i in range(_M))}
  FROM beta JOIN base USING (target, kind) WHERE kind = -1 GROUP BY target)
"""
_FIT = re.sub(r"^\s*WITH\b", "WITH RECURSIVE", _FIT)
_PREDICTION = "base + (" + " + ".join(f"c{i} * (u{i} - x{i})" for i in range(_M)) + ")"
_PRED = _FIT + f""",
pred AS (SELECT config_id, target, y, is_test, {_PREDICTION} AS prediction FROM known JOIN model USING (target))"""
_LONG = _FIT + f""",
con AS MATERIALIZED (SELECT config_id, client_name, target, y, base, unnest({FEATURES}) AS feature,
  unnest([{", ".join(f"u{i} + m{i}" for i in range(_M))}]) AS x, unnest([{", ".join(f"c{i} * (u{i} - x{i})" for i in range(_M))}]) AS contribution
  FROM known JOIN model USING (target), med WHERE is_test),
st AS (SELECT target, feature, avg(abs(contribution)) AS mean_abs, stddev_pop(abs(contribution)) AS std_abs,
              avg(contribution) AS mean_contribution FROM con GROUP BY target, feature),
imp AS (SELECT st.target AS model, st.feature, coalesce(st.mean_abs / nullif(t.s, 0), 0) AS importance
        FROM st JOIN (SELECT target, sum(mean_abs) AS s FROM st GROUP BY target) t ON st.target = t.target)
"""


@register("ml_contributions", _LONG + """
SELECT config_id, target, feature, round(contribution, 4) AS contribution FROM con""")
def ml_contributions(spark, sf):
    """Contributions of all features to the predictions of the hold-out rows."""
    return rounded(_contrib(spark, sf)
                   .select("config_id", "target", "feature", "contribution"))


@register("ml_contribution_stats", _LONG + """
SELECT target, feature, round(mean_abs, 4) AS mean_abs, round(std_abs, 4) AS std_abs,
       round(mean_contribution, 2) + 0.0 AS mean_contribution,
       CASE WHEN round(mean_contribution, 6) > 0 THEN 'positive' ELSE 'negative' END AS direction
FROM st WHERE mean_abs IS NOT NULL""")
def ml_contribution_stats(spark, sf):
    """Mean |c|, std |c| (ddof 0), mean c on the hold-out clients and its sign."""
    st = _stats(spark, sf).drop("corr").filter(F.col("mean_abs").isNotNull())
    return rounded(st.withColumn("mean_contribution", F.round("mean_contribution", 2) + F.lit(0.0)))


@register("win_importance_rank", _LONG + """
SELECT target, feature, row_number() OVER (PARTITION BY target ORDER BY mean_abs DESC NULLS LAST, feature) AS rank FROM st""")
def win_importance_rank(spark, sf):
    return ML.rank_features(_stats(spark, sf)).select("target", "feature", "rank")


@register("ml_effect_type", _LONG + """,
r AS (SELECT target, feature, row_number() OVER (PARTITION BY target ORDER BY mean_abs DESC NULLS LAST, feature) AS rank FROM st),
c AS (SELECT target, feature, CASE WHEN stddev_pop(x) = 0 OR stddev_pop(contribution) = 0 THEN NULL
                                   ELSE corr(x, contribution) END AS corr
      FROM con WHERE x IS NOT NULL AND contribution IS NOT NULL GROUP BY target, feature)
SELECT r.target, r.feature, r.rank, round(c.corr, 4) AS corr,
       CASE WHEN c.corr > 0.5 THEN 'linear_positive' WHEN c.corr < -0.5 THEN 'linear_negative' ELSE 'nonlinear' END AS effect_type
FROM r JOIN c ON r.target = c.target AND r.feature = c.feature WHERE r.rank <= 5""")
def ml_effect_type(spark, sf):
    st = ML.rank_features(_stats(spark, sf)).filter(F.col("rank") <= 5)
    lab = (F.when(F.col("corr") > 0.5, "linear_positive").when(F.col("corr") < -0.5, "linear_negative")
           .otherwise("nonlinear"))
    return rounded(st.select("target", "feature", "rank", "corr", lab.alias("effect_type")))


@register("top_contributions", _LONG + """
SELECT config_id, target, feature, round(contribution, 4) AS contribution, rank,
       CASE WHEN contribution > 0 THEN 'increases' ELSE 'decreases' END AS direction FROM (
  SELECT *, row_number() OVER (PARTITION BY target, config_id ORDER BY round(abs(contribution), 6) DESC, feature) AS rank
  FROM con WHERE contribution IS NOT NULL) WHERE rank <= 3""")
def top_contributions(spark, sf):
    return rounded(ML.top_contributions(_contrib_wide(spark, sf), 3).select(
        "config_id", "target", "feature", "contribution", "rank", "direction"))


@register("ml_explain_row", _LONG + """,
tot AS (SELECT target, config_id, any_value(base) AS base, sum(contribution) AS s FROM con GROUP BY target, config_id),
top1 AS (SELECT target, config_id, feature AS top_feature FROM (
  SELECT *, row_number() OVER (PARTITION BY target, config_id ORDER BY round(abs(contribution), 6) DESC, feature) AS rk
  FROM con) WHERE rk = 1)
SELECT tot.target, tot.config_id, round(base, 4) AS base_value, round(base + s, 2) AS prediction, top1.top_feature
FROM tot JOIN top1 ON top1.target = tot.target AND top1.config_id = tot.config_id""")
def ml_explain_row(spark, sf):
    """Base value, the prediction that base and contributions add up to, and the leading feature,
    for every hold-out row and target."""
    c = _contrib_wide(spark, sf)
    total = F.aggregate("contribs", F.lit(0.0), lambda t, s: t + s["contribution"])
    lead = F.get(F.array_sort(F.transform("contribs", lambda s: F.struct(
        (-F.round(F.abs(s["contribution"]), 6)).alias("_size"), s["feature"].alias("feature")))), F.lit(0))["feature"]
    return rounded(c.select("target", "config_id", "base_value", F.round(F.col("base_value") + total, 2).alias("prediction"), lead.alias("top_feature")))


@register("ml_dependence", _LONG + """
SELECT a.config_id, a.target, round(a.x, 4) AS value, round(a.contribution, 4) AS contribution,
       round(b.x, 4) AS interaction_value
FROM con a LEFT JOIN con b ON a.config_id = b.config_id AND a.target = b.target AND b.feature = 'ts__load_kwh_mean'
WHERE a.feature = 'battery_capacity_kwh'""")
def ml_dependence(spark, sf):
    """(value, contribution, interaction value) of one feature for every row."""
    pair = ["battery_capacity_kwh", "ts__load_kwh_mean"]
    c = _contrib_wide(spark, sf, pair)
    a, b = (F.get("contribs", F.lit(sorted(pair, key=FEATURES.index).index(f))) for f in pair)
    return rounded(c.where(a["x"].isNotNull()).select(
        "config_id", "target", a["x"].alias("value"), a["contribution"].alias("contribution"), b["x"].alias("interaction_value")))


_PIV = ", ".join(f"round(max(CASE WHEN target = '{m}' THEN mean_abs END), 4) AS {m}" for m in MODELS)


@register("agg_effect_pivot", _LONG + f"""
SELECT feature, {_PIV}, round(sum(mean_abs), 4) AS total FROM st GROUP BY feature
ORDER BY sum(mean_abs) DESC NULLS LAST, feature LIMIT 10""")
def agg_effect_pivot(spark, sf):
    """Mean |contribution| per feature × target (fixed pivot list), total, top 10."""
    st = _stats(spark, sf)
    p = st.groupBy("feature").pivot("target", MODELS).agg(F.max("mean_abs"))
    p = p.join(st.groupBy("feature").agg(F.sum("mean_abs").alias("total")), "feature")
    return rounded(p.orderBy(F.col("total").desc_nulls_last(), "feature").limit(10))


_MODELS_ARR = ", ".join(f"coalesce(max(CASE WHEN model = '{m}' THEN importance END), 0)" for m in MODELS)


@register("agg_importance_wide", _LONG + f""",
w AS (SELECT feature, {", ".join(f"coalesce(max(CASE WHEN model = '{m}' THEN importance END), 0) AS {m}" for m in MODELS)}
      FROM imp GROUP BY feature),
s AS (SELECT *, greatest({", ".join(MODELS)}) AS mx, ({" + ".join(MODELS)}) / 3.0 AS mean FROM w)
SELECT feature, {", ".join(f"round({m}, 4) AS {m}" for m in MODELS)}, round(mean, 4) AS mean_importance,
       round(mx, 4) AS max_importance,
       round(sqrt(({" + ".join(f"({m} - mean) * ({m} - mean)" for m in MODELS)}) / 2), 4) AS std_importance,
       CASE WHEN mx = 0 THEN 'none' ELSE concat_ws(', ', {", ".join(f"CASE WHEN {m} >= mx * 0.95 THEN '{m}' END" for m in MODELS)}) END
         AS dominant_model
FROM s""")
def agg_importance_wide(spark, sf):
    return rounded(ML.importance_wide(_imp(spark, sf), MODELS))


@register("agg_importance_category", _LONG + """
SELECT model, category, round(CASE WHEN t > 0 THEN s / t * 100 ELSE 0 END, 4) AS pct FROM (
  SELECT model, category, sum(importance) AS s, max(t) AS t FROM (
    SELECT imp.*, CASE WHEN starts_with(feature, 'list_battery_') OR feature IN ('pv_annual_total', 'pv_consumed_percentage')
                            OR starts_with(feature, 'battery_') THEN 'direct'
                       WHEN starts_with(feature, 'ts__') THEN 'load_profile' ELSE 'other' END AS category,
           sum(importance) OVER (PARTITION BY model) AS t FROM imp) GROUP BY model, category)""")
def agg_importance_category(spark, sf):
    return rounded(ML.importance_category(_imp(spark, sf)))


@register("set_shared_features", _LONG + """
SELECT feature FROM imp WHERE importance > 0.01 GROUP BY feature HAVING count(DISTINCT model) = 3""")
def set_shared_features(spark, sf):
    return ML.shared_features(_imp(spark, sf), len(MODELS))


@register("set_unique_features", _LONG + """
SELECT feature FROM imp WHERE model = 'trading_revenue' AND importance > 0.02
EXCEPT SELECT feature FROM imp WHERE model <> 'trading_revenue' AND importance > 0.01""")
def set_unique_features(spark, sf):
    return ML.unique_features(_imp(spark, sf), "trading_revenue")


@register("top_features", _LONG + """
SELECT feature, round(avg(importance), 4) AS mean_importance FROM imp GROUP BY feature
ORDER BY avg(importance) DESC, feature LIMIT 5""")
def top_features(spark, sf):
    imp = _imp(spark, sf)
    return rounded(imp.groupBy("feature").agg(F.avg("importance").alias("mean_importance"))
                   .orderBy(F.col("mean_importance").desc(), "feature").limit(5))


# --- predictions, metrics, CV ----------------------------------------------------
@register("ml_predict", _FIT + f"SELECT config_id, target, round({_PREDICTION}, 4) AS prediction FROM every JOIN model USING (target)")
def ml_predict(spark, sf):
    """pred_<target> of every configuration from all features, a row per target."""
    m = _models(spark, sf)
    return rounded(L.predictions(m.rows, m.fits).select("config_id", "target", "prediction"))


def _scored(spark, sf):
    m = _models(spark, sf)
    return L.predictions(m.known, m.fits)


_MET = """SELECT target, count(*) AS n, round(1 - sum((y - prediction) * (y - prediction)) / (var_pop(y) * count(*)), 4) AS r2,
       round(avg(abs(y - prediction)), 4) AS mae, round(sqrt(sum((y - prediction) * (y - prediction)) / count(*)), 4) AS rmse"""


@register("ml_metrics", _PRED + _MET + " FROM pred WHERE is_test GROUP BY target")
def ml_metrics(spark, sf):
    """R², MAE and RMSE on the hold-out clients."""
    return rounded(ML.metrics(_scored(spark, sf).where("is_test")).select("target", "n", "r2", "mae", "rmse"))


@register("ml_evaluate", _PRED + _MET + """, round(avg(y), 4) AS mean_actual, round(avg(prediction), 4) AS mean_predicted
FROM pred GROUP BY target""")
def ml_evaluate(spark, sf):
    """The same over all rows with a label, with the mean label and prediction."""
    return rounded(ML.metrics(_scored(spark, sf)))


@register("top_best_model", _PRED + """
SELECT target AS model, round(r2, 4) AS r2 FROM (""" + _MET + """ FROM pred WHERE is_test GROUP BY target)
ORDER BY r2 DESC, model LIMIT 1""")
def top_best_model(spark, sf):
    """Model with the highest hold-out R², the first name among equals (one aggregate, no sort)."""
    m = rounded(ML.metrics(_scored(spark, sf).where("is_test")).select("target", "r2"))
    return m.agg(F.min_by("target", F.struct(-F.col("r2"), F.col("target"))).alias("model"), F.max("r2").alias("r2"))


@register("ml_cv_summary", _PRED + f""",
of_fold AS (SELECT target, kind AS fold, any_value(base) AS b,
  {", ".join(f"max(CASE WHEN i = {i + 1} THEN coef END) AS d{i}, max(CASE WHEN i = {i + 1} THEN mean END) AS e{i}" for i in range(_M))}
  FROM beta JOIN base USING (target, kind) WHERE kind >= 0 GROUP BY target, kind),
sc AS (SELECT target, fold, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2 FROM (
  SELECT k.target, k.fold, k.y, b + {" + ".join(f"d{i} * (u{i} - e{i})" for i in range(_M))} AS p
  FROM known k JOIN of_fold w ON w.target = k.target AND w.fold = k.fold) GROUP BY target, fold)
SELECT target, round(avg(r2), 4) AS cv_r2_mean, round(stddev_pop(r2), 4) AS cv_r2_std, count(r2) AS n_folds FROM sc GROUP BY target""")
def ml_cv_summary(spark, sf):
    """Cross-validation by client over :func:`ML.group_folds`: mean ± std (ddof 0) of R², each
    fold fitted on the total moments minus its own."""
    m = _models(spark, sf)
    folds = spark.createDataFrame(L.cross_validated(m.moments, m.scales), "target string, fold int, n long, r2 double")
    return rounded(ML.cv_summary(folds, ("target",)))


# --- splits, imputation, training rows, registry, permutation -----------------------------
@register("ml_group_split", _FIT + "SELECT config_id, client_name, target, is_test FROM known")
def ml_group_split(spark, sf):
    """Labelled rows of every target with ``is_test``; a client lies wholly on one side."""
    return _models(spark, sf).known.select("config_id", "client_name", "target", "is_test")


@register("ml_group_folds", _FIT + "SELECT config_id, client_name, target, CAST(fold AS INTEGER) AS fold FROM known")
def ml_group_folds(spark, sf):
    """Labelled rows of every target with their fold; a client lies wholly in one."""
    return _models(spark, sf).known.select("config_id", "client_name", "target", "fold")


@register("ml_impute_median", _FIT + "SELECT config_id, " + ", ".join(
    f"round(coalesce({f}, m{i}), 4) AS {f}" for i, f in enumerate(FEATURES)) + " FROM mat, med")
def ml_impute_median(spark, sf):
    """Every feature with its exact median in place of nulls (0 where all are null)."""
    mat = _matrix(spark, sf)
    return rounded(mat.select("config_id", *[
        F.coalesce(F.col(f).cast("double"), F.lit(m)).alias(f) for f, m in zip(FEATURES, L.medians(mat, FEATURES))]))


_CV = f""",
of_fold AS (SELECT target, kind AS fold, any_value(base) AS b,
  {", ".join(f"max(CASE WHEN i = {i + 1} THEN coef END) AS d{i}, max(CASE WHEN i = {i + 1} THEN mean END) AS e{i}" for i in range(_M))}
  FROM beta JOIN base USING (target, kind) WHERE kind >= 0 GROUP BY target, kind),
cv AS (SELECT target, round(avg(r2), 4) AS cv_r2_mean, round(stddev_pop(r2), 4) AS cv_r2_std FROM (
  SELECT target, fold, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2 FROM (
  SELECT k.target, k.fold, k.y, b + {" + ".join(f"d{i} * (u{i} - e{i})" for i in range(_M))} AS p
  FROM known k JOIN of_fold w ON w.target = k.target AND w.fold = k.fold) GROUP BY target, fold) GROUP BY target),
met AS ({_MET} FROM pred WHERE is_test GROUP BY target),
size AS (SELECT target, count(*) FILTER (NOT is_test) AS n_train FROM known GROUP BY target)"""


@register("ml_train_ridge", _PRED + _CV + """
SELECT target, 'ridge' AS model, n_train, n AS n_test, r2, mae, rmse, cv_r2_mean, cv_r2_std FROM met JOIN cv USING (target) JOIN size USING (target)""")
def ml_train_ridge(spark, sf):
    """Ridge (alpha 1 on standardised features) of every target: hold-out and cross-validation
    scores; fewer than 10 training rows raise."""
    table = trained_registry(spark, sf).table()
    return rounded(table.select(F.col("name").alias("target"), F.lit("ridge").alias("model"), F.col("n_samples").alias("n_train"),
                                F.col("metrics")["n"].cast("long").alias("n_test"),
                                *[F.col("metrics")[k].alias(k) for k in ("r2", "mae", "rmse", "cv_r2_mean", "cv_r2_std")]))


@register("ml_registry", _PRED + _CV + f"""
SELECT target AS name, version, r2, cv_r2_mean, {_M} AS n_importances, n_train AS n_samples, {_M} AS n_features, version = 2 AS is_current
FROM met JOIN cv USING (target) JOIN size USING (target), (SELECT unnest([1, 2]) AS version)""")
def ml_registry(spark, sf):
    """All versions of a registry after the models of every target were published twice."""
    registry = trained_registry(spark, sf)
    for name in registry.names():
        model, old = registry.load(name)
        registry.register(name, model, old["metrics"], old["feature_importance"], old["features"], n_samples=old["n_samples"], expected=1)
    t = registry.table(history=True)
    return rounded(t.select("name", "version", F.col("metrics")["r2"].alias("r2"), F.col("metrics")["cv_r2_mean"].alias("cv_r2_mean"),
                            F.size("feature_importance").alias("n_importances"), "n_samples", F.col("n_features").cast("int").alias("n_features"),
                            (F.col("version") == 2).alias("is_current")))


@register("ml_permutation", _PRED + f""",
put AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY config_id) AS r,
               row_number() OVER (PARTITION BY target ORDER BY md5(CAST(config_id AS VARCHAR)), config_id) AS q FROM known WHERE is_test),
var AS (SELECT a.target, a.y, {_PREDICTION.replace("(u", "(a.u")} AS p, unnest({FEATURES}) AS feature,
  unnest([{", ".join(f"c{i} * (b.u{i} - a.u{i})" for i in range(_M))}]) AS shift
  FROM put a JOIN put b ON a.target = b.target AND a.r = b.q JOIN model ON model.target = a.target)
SELECT target, feature, round(sqrt(avg((y - p) * (y - p))), 3) AS base_rmse, round(sqrt(avg((y - p - shift) * (y - p - shift))), 3) AS permuted_rmse
FROM var GROUP BY target, feature""")
def ml_permutation(spark, sf):
    """RMSE of each target's model on the hold-out clients, as they are and with one feature's
    values permuted among them."""
    m = _models(spark, sf)
    out = L.permutation_importance(m.held_out(), m.fits, FEATURES)
    return out.select("target", "feature", F.round("base_rmse", 3).alias("base_rmse"), F.round("permuted_rmse", 3).alias("permuted_rmse"))
