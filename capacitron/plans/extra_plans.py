"""Declared-only surface and ad-hoc SQL (§2.12 sql_adhoc)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.nulls import guarded_corr
from ..operators import calendar as C
from ..operators import ml as ML
from .common import Model, rounded
from .feature_plans import _MAT_COLS, _MATRIX_SQL, _stored_matrix as _matrix
from .model_sql import CONFIGS, EVENTS_SERIES, GRP, KPIS, with_
from .registry import register

ES = with_(EVENTS_SERIES)


def _roll_sql():
    sel, agg = [], []
    for w in C.ROLLING_WINDOWS:
        fr = f"OVER (PARTITION BY config_id ORDER BY \"timestamp\" ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        sel += [f"avg(load_kwh) {fr} AS m{w}", f"stddev_samp(load_kwh) {fr} AS s{w}", f"max(load_kwh) {fr} AS x{w}"]
        agg += [f"round(max(m{w}), 8) AS roll{w}_mean_max", f"round(avg(m{w}), 8) AS roll{w}_mean_mean",
                f"round(avg(s{w}), 8) AS roll{w}_std_mean", f"round(avg(x{w}), 8) AS roll{w}_max_mean"]
    return ES + f", r AS (SELECT config_id, {', '.join(sel)} FROM series)\nSELECT config_id, {', '.join(agg)} FROM r GROUP BY config_id"


# windowed means of cent values are multiples of 1/3200: compared at 1e-8
register("dx_rolling", _roll_sql())(lambda spark, sf: rounded(C.rolling(Model(spark, sf).series), 8))

register("dx_fourier", ES + ", t AS (SELECT config_id, load_kwh, epoch_us(\"timestamp\") / 9e8 AS q FROM series)\nSELECT config_id, "
         + ", ".join(f"round(2 * sqrt(power(sum(load_kwh * cos(q * (2 * pi() / {p}))), 2) + power(sum(load_kwh * sin(q * (2 * pi() / {p}))), 2)) / count(load_kwh), 4) AS fourier_p{p}_amplitude"
                     for p in C.FOURIER_PERIODS) + " FROM t GROUP BY config_id")(
    lambda spark, sf: rounded(C.fourier(Model(spark, sf).series)))

_IN = ("month(\"timestamp\") IN (1, 2, 12) AND ((hour(\"timestamp\") * 60 + minute(\"timestamp\") >= 465 AND hour(\"timestamp\") * 60 + minute(\"timestamp\") < 540)"
       " OR (hour(\"timestamp\") * 60 + minute(\"timestamp\") >= 780 AND hour(\"timestamp\") * 60 + minute(\"timestamp\") < 795)"
       " OR (hour(\"timestamp\") * 60 + minute(\"timestamp\") >= 1005 AND hour(\"timestamp\") * 60 + minute(\"timestamp\") < 1200))")

register("dx_peak_window", ES + f"""
SELECT config_id, round(max(load_kwh) FILTER (WHERE {_IN}), 4) AS peak_window_max,
       round(avg(load_kwh) FILTER (WHERE {_IN}), 4) AS peak_window_mean,
       round(max(load_kwh) FILTER (WHERE NOT ({_IN})), 4) AS off_window_max,
       round(avg(load_kwh) FILTER (WHERE NOT ({_IN})), 4) AS off_window_mean
FROM series GROUP BY config_id""")(lambda spark, sf: rounded(C.peak_window(Model(spark, sf).series)))

_HOL = ", ".join(f"(DATE '{d}', '{c}')" for d, _, c in C.OFFPEAK_DAYS_2024)
register("dx_offpeak_days", ES + f""",
cal AS (SELECT * FROM (VALUES {_HOL}) t(d, category)),
j AS (SELECT s.config_id, s.load_kwh, CAST(s."timestamp" AS DATE) AS d,
             coalesce(cal.category, CASE WHEN isodow(s."timestamp") >= 6 THEN 'Weekend' ELSE 'Workday' END) AS category
      FROM series s LEFT JOIN cal ON cal.d = CAST(s."timestamp" AS DATE))
SELECT config_id, category, round(sum(load_kwh), 4) AS load, count(*) AS n_rows, count(DISTINCT d) AS n_days
FROM j GROUP BY config_id, category""")(lambda spark, sf: rounded(C.offpeak_days(Model(spark, sf).series)))

_T = ["target_peak_shaving_benefit", "target_energy_procurement_optimization", "target_trading_revenue"]


@register("dx_feature_target_corr", _MATRIX_SQL + ", lg AS (SELECT * FROM (UNPIVOT (SELECT config_id, "
          + ", ".join(_T) + ", " + ", ".join(_MAT_COLS) + " FROM mat) ON " + ", ".join(_MAT_COLS)
          + " INTO NAME feature VALUE x)),\nc AS ("
          + " UNION ALL ".join(
              f"SELECT '{t}' AS target, feature, CASE WHEN stddev_pop(x) = 0 OR stddev_pop({t}) = 0 THEN NULL ELSE corr(x, {t}) END AS corr "
              f"FROM lg WHERE {t} IS NOT NULL GROUP BY feature" for t in _T)
          + ")\nSELECT target, feature, round(corr, 4) AS corr FROM (SELECT *, row_number() OVER (PARTITION BY target "
            "ORDER BY abs(round(corr, 6)) DESC NULLS LAST, feature) AS rk FROM c) WHERE rk <= 10")
def dx_feature_target_corr(spark, sf):
    """Correlation of every feature with each target, top 10 by |corr| per target."""
    from pyspark.sql import Window
    lg = ML.long_xy(_matrix(spark, sf), list(_MAT_COLS), _T)
    c = lg.groupBy("target", "feature").agg(guarded_corr(F.col("x"), F.col("y")).alias("corr"))
    w = Window.partitionBy("target").orderBy(F.abs(F.round("corr", 6)).desc_nulls_last(), "feature")
    return rounded(c.withColumn("rk", F.row_number().over(w)).filter("rk <= 10").select("target", "feature", "corr"))


@register("dx_kpi_relative", with_(GRP, CONFIGS, KPIS) + """,
base AS (SELECT run_id, config_id AS base_id FROM (
  SELECT run_id, config_id, row_number() OVER (PARTITION BY run_id
         ORDER BY is_baseline DESC, battery_capacity_kwh ASC NULLS FIRST, config_id) AS rn
  FROM configs WHERE is_baseline OR battery_capacity_kwh = 0
     OR lower(config_name) IN ('0kwh','0_kwh','no_battery','0_battery','baseline','no battery','0')
     OR starts_with(lower(config_name), '0kwh')) WHERE rn = 1)
SELECT k.config_id, k.kpi_name, round(k.kpi_value, 4) AS kpi_value, round(k.kpi_value - bk.kpi_value, 4) AS delta,
       round(CASE WHEN bk.kpi_value <> 0 THEN 100 * (k.kpi_value - bk.kpi_value) / bk.kpi_value END, 4) AS delta_pct,
       round(CASE WHEN bk.kpi_value <> 0 THEN k.kpi_value / bk.kpi_value END, 4) AS ratio
FROM kpis k JOIN configs c ON k.config_id = c.config_id JOIN base b ON b.run_id = c.run_id
JOIN kpis bk ON bk.config_id = b.base_id AND bk.kpi_name = k.kpi_name
WHERE NOT c.is_baseline""")
def dx_kpi_relative(spark, sf):
    """kpi_ absolute, delta_, delta_pct_ and ratio_ against the run's baseline (ML variant)."""
    from .benefit_plans import win_baseline_pick_ml
    m = Model(spark, sf)
    base = win_baseline_pick_ml(spark, sf)
    k = (m.kpis.join(m.configs.filter(~F.col("is_baseline")).select("config_id", "run_id"), "config_id")
         .join(base, "run_id"))
    bk = m.kpis.select(F.col("config_id").alias("baseline_config_id"), "kpi_name", F.col("kpi_value").alias("b"))
    j = k.join(bk, ["baseline_config_id", "kpi_name"])
    v, b = F.col("kpi_value"), F.col("b")
    return rounded(j.select("config_id", "kpi_name", "kpi_value", (v - b).alias("delta"),
                            F.when(b != 0, F.try_divide(100 * (v - b), b)).alias("delta_pct"),
                            F.when(b != 0, F.try_divide(v, b)).alias("ratio")))


@register("dx_feature_sets", _MATRIX_SQL + """,
m2 AS (SELECT config_id, """ + ", ".join(_MAT_COLS) + """ FROM mat),
lg AS (SELECT * FROM m2 UNPIVOT INCLUDE NULLS (x FOR feature IN (""" + ", ".join(_MAT_COLS) + """)))
SELECT CASE WHEN starts_with(feature, 'ts__') THEN 'load_profile' ELSE 'direct' END AS feature_set, feature,
       count(x) AS n_known, count(*) - count(x) AS n_missing
FROM lg GROUP BY feature""")
def dx_feature_sets(spark, sf):
    """Feature-set listing over our own feature matrix: set, feature, known / missing."""
    mat = _matrix(spark, sf)
    lg = ML.unpivot(mat, ["config_id"], list(_MAT_COLS))
    return lg.groupBy(F.when(F.col("feature").startswith("ts__"), "load_profile").otherwise("direct")
                      .alias("feature_set"), "feature").agg(
        F.count("x").alias("n_known"), (F.count("*") - F.count("x")).alias("n_missing"))


@register("sql_adhoc", with_(GRP, KPIS) + """
SELECT kpi_name, count(*) AS n, round(avg(kpi_value), 4) AS avg_value FROM kpis WHERE kpi_value > 1000 GROUP BY kpi_name""")
def sql_adhoc(spark, sf):
    """Any SQL text over the model tables, with named parameters (no string splicing)."""
    m = Model(spark, sf)
    m.kpis.createOrReplaceTempView("kpi_summary")
    m.configs.createOrReplaceTempView("battery_configs")
    m.runs.createOrReplaceTempView("runs")
    m.clients.createOrReplaceTempView("clients")
    return spark.sql("SELECT kpi_name, count(*) AS n, round(avg(kpi_value), 4) AS avg_value "
                     "FROM kpi_summary WHERE kpi_value > :min_value GROUP BY kpi_name", args={"min_value": 1000})


@register("jn_feature_sets", _MATRIX_SQL + """,
m2 AS (SELECT config_id, """ + ", ".join(_MAT_COLS) + """ FROM mat),
lg AS (SELECT * FROM m2 UNPIVOT INCLUDE NULLS (x FOR feature IN (""" + ", ".join(_MAT_COLS) + """))),
sets AS (SELECT * FROM (VALUES ('direct'), ('load_profile'), ('kpi_relative')) t(feature_set)),
f AS (SELECT CASE WHEN starts_with(feature, 'ts__') THEN 'load_profile' ELSE 'direct' END AS feature_set, feature,
             count(x) AS n_known FROM lg GROUP BY feature)
SELECT s.feature_set, count(f.feature) AS n_features, coalesce(sum(f.n_known), 0) AS n_values
FROM sets s LEFT JOIN f ON f.feature_set = s.feature_set GROUP BY s.feature_set""")
def jn_feature_sets(spark, sf):
    """Feature sets ⟕ features of our matrix, grouped: features and known values per set
    (a set without features keeps a zero row)."""
    mat = _matrix(spark, sf)
    lg = ML.unpivot(mat, ["config_id"], list(_MAT_COLS))
    f = lg.groupBy(F.when(F.col("feature").startswith("ts__"), "load_profile").otherwise("direct")
                   .alias("feature_set"), "feature").agg(F.count("x").alias("n_known"))
    sets = spark.createDataFrame([("direct",), ("load_profile",), ("kpi_relative",)], "feature_set string")
    return (F.broadcast(sets).join(f, "feature_set", "left").groupBy("feature_set")
            .agg(F.count("feature").alias("n_features"),
                 F.coalesce(F.sum("n_known"), F.lit(0)).cast("long").alias("n_values")))
