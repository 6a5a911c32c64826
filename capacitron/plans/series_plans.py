"""Time-series feature queries over the events-derived series."""

from __future__ import annotations

from ..operators import series as S
from .common import Model, rounded
from .model_sql import EVENTS_SERIES, SHIP_SERIES, with_
from .registry import register

ES = with_(EVENTS_SERIES)


def _ts(spec, names=(), ship=False, roles=None, digits=4):
    def run(spark, sf):
        m = Model(spark, sf)
        src = m.ship if ship else m.series
        return rounded(S.extract(src, spec, names, roles=roles), digits)
    return run


def _skip(col, expr):
    return f"CASE WHEN count({col}) > 0 THEN {expr} END"


register("ts_mean", ES + """
SELECT config_id,
  round(avg(load_kwh), 4) AS load_kwh_mean, round(min(load_kwh), 4) AS load_kwh_min,
  round(max(load_kwh), 4) AS load_kwh_max, round(coalesce(sum(load_kwh), 0), 4) AS load_kwh_sum,
  round(CASE WHEN count(generation_kwh) > 0 THEN avg(generation_kwh) END, 4) AS generation_kwh_mean,
  round(CASE WHEN count(generation_kwh) > 0 THEN min(generation_kwh) END, 4) AS generation_kwh_min,
  round(CASE WHEN count(generation_kwh) > 0 THEN max(generation_kwh) END, 4) AS generation_kwh_max,
  round(CASE WHEN count(generation_kwh) > 0 THEN coalesce(sum(generation_kwh), 0) END, 4) AS generation_kwh_sum
FROM series GROUP BY config_id""")(_ts({
    "load_kwh": {"stats": ["mean", "min", "max", "sum"]},
    "generation_kwh": {"stats": ["mean", "min", "max", "sum"]}}))

register("ts_std", ES + """
SELECT config_id, round(stddev_samp(load_kwh), 4) AS load_kwh_std, round(var_samp(load_kwh), 4) AS load_kwh_var,
  round(stddev_samp(price_eur_mwh), 4) AS price_eur_mwh_std, round(var_samp(price_eur_mwh), 4) AS price_eur_mwh_var
FROM series GROUP BY config_id""")(_ts({
    "load_kwh": {"stats": ["std", "var"]}, "price_eur_mwh": {"stats": ["std", "var"]}}))

register("ts_median", ES + """
SELECT config_id, round(quantile_cont(load_kwh, 0.5), 4) AS load_kwh_median,
  round(quantile_cont(price_eur_mwh, 0.5), 4) AS price_eur_mwh_median
FROM series GROUP BY config_id""")(_ts({
    "load_kwh": {"stats": ["median"]}, "price_eur_mwh": {"stats": ["median"]}}))

_SK = "CASE WHEN count({c}) >= 3 AND var_pop({c}) = 0 THEN 0 ELSE skewness({c}) END"
_KU = "CASE WHEN count({c}) >= 4 AND var_pop({c}) = 0 THEN 0 ELSE kurtosis({c}) END"

register("ts_skew", ES + f"""
SELECT config_id, round({_SK.format(c='load_kwh')}, 4) AS load_kwh_skew,
  round({_SK.format(c='load_kwh')}, 4) AS load_kwh_skewness,
  round({_SK.format(c='power_kw')}, 4) AS power_kw_skew,
  round({_SK.format(c='generation_kwh')}, 4) AS generation_kwh_skewness
FROM series GROUP BY config_id""")(_ts({
    "load_kwh": {"stats": ["skew"], "custom": ["skewness"]},
    "power_kw": {"stats": ["skew"]},
    "generation_kwh": {"custom": ["skewness"]}}))

register("ts_skewness", ES + f"""
SELECT config_id, round({_SK.format(c='soc_percent')}, 4) AS soc_percent_skewness,
  round(CASE WHEN count(generation_kwh) = 0 THEN 0 ELSE {_SK.format(c='generation_kwh')} END, 4)
    AS generation_kwh_skewness
FROM series GROUP BY config_id""")(_ts({
    "soc_percent": {"custom": ["skewness"]},
    "generation_kwh": {"custom": ["skewness"], "skip_if_empty": False}}))

register("ts_kurtosis", ES + f"""
SELECT config_id, round({_KU.format(c='load_kwh')}, 4) AS load_kwh_kurtosis,
  round({_KU.format(c='generation_kwh')}, 4) AS generation_kwh_kurtosis
FROM series GROUP BY config_id""")(_ts({
    "load_kwh": {"stats": ["kurtosis"]}, "generation_kwh": {"stats": ["kurtosis"]}}))

register("ts_percentiles", ES + """
SELECT config_id""" + "".join(
    f",\n  round(quantile_cont(load_kwh, {p / 100}), 4) AS load_kwh_p{p}" for p in (10, 25, 50, 75, 90, 95))
    + "".join(f",\n  round(quantile_cont(price_eur_mwh, {p / 100}), 4) AS price_eur_mwh_p{p}" for p in (10, 50, 90))
    + "\nFROM series GROUP BY config_id")(_ts({
        "load_kwh": {"percentiles": [10, 25, 50, 75, 90, 95]},
        "price_eur_mwh": {"percentiles": [10, 50, 90]}}))

register("ts_peak_to_mean", ES + """
SELECT config_id,
  round(CASE WHEN avg(load_kwh) > 0 THEN max(load_kwh) / avg(load_kwh) ELSE 0 END, 4) AS load_kwh_peak_to_mean,
  round(CASE WHEN avg(grid_import_kwh) > 0 THEN max(grid_import_kwh) / avg(grid_import_kwh) ELSE 0 END, 4)
    AS grid_import_kwh_peak_to_average,
  round(CASE WHEN avg(price_eur_mwh) > 0 THEN max(price_eur_mwh) / avg(price_eur_mwh) ELSE 0 END, 4)
    AS price_eur_mwh_peak_to_mean
FROM series GROUP BY config_id""")(_ts({
    "load_kwh": {"custom": ["peak_to_mean"]}, "grid_import_kwh": {"custom": ["peak_to_average"]},
    "price_eur_mwh": {"custom": ["peak_to_mean"]}}))

register("ts_cv", ES + """
SELECT config_id,
  round(CASE WHEN avg(load_kwh) > 0 THEN stddev_samp(load_kwh) / avg(load_kwh) ELSE 0 END, 4) AS load_kwh_cv,
  round(CASE WHEN avg(price_eur_mwh) > 0 THEN stddev_samp(price_eur_mwh) / avg(price_eur_mwh) ELSE 0 END, 4)
    AS price_eur_mwh_price_volatility,
  round(CASE WHEN avg(power_kw) > 0 THEN stddev_samp(power_kw) / avg(power_kw) ELSE 0 END, 4) AS power_kw_cv
FROM series GROUP BY config_id""")(_ts({
    "load_kwh": {"custom": ["cv"]}, "price_eur_mwh": {"custom": ["price_volatility"]},
    "power_kw": {"custom": ["cv"]}}))

register("ts_iqr", ES + """
SELECT config_id,
  round(quantile_cont(load_kwh, 0.75) - quantile_cont(load_kwh, 0.25), 4) AS load_kwh_iqr,
  round(quantile_cont(power_kw, 0.75) - quantile_cont(power_kw, 0.25), 4) AS power_kw_iqr
FROM series GROUP BY config_id""")(_ts({
    "load_kwh": {"custom": ["iqr"]}, "power_kw": {"custom": ["iqr"]}}))

register("ts_range", ES + """
SELECT config_id, round(max(soc_percent) - min(soc_percent), 4) AS soc_percent_range,
  round(max(price_eur_mwh) - min(price_eur_mwh), 4) AS price_eur_mwh_price_spread
FROM series GROUP BY config_id""")(_ts({
    "soc_percent": {"custom": ["range"]}, "price_eur_mwh": {"custom": ["price_spread"]}}))

register("ts_time_below_20pct", ES + """
SELECT config_id, round(avg(CAST(soc_percent < 20 AS DOUBLE)), 4) AS soc_percent_time_below_20pct,
  round(avg(CAST(soc_percent > 80 AS DOUBLE)), 4) AS soc_percent_time_above_80pct
FROM series GROUP BY config_id""")(_ts({
    "soc_percent": {"custom": ["time_below_20pct", "time_above_80pct"]}}))

register("ts_cycles_equivalent", ES + """,
d AS (SELECT config_id, soc_percent,
        soc_percent - lag(soc_percent) OVER (PARTITION BY config_id ORDER BY "timestamp") AS dsoc
      FROM series WHERE soc_percent IS NOT NULL)
SELECT config_id, round(coalesce(sum(abs(dsoc)), 0) / 200, 6) AS soc_percent_cycles_equivalent
FROM d GROUP BY config_id""")(_ts({"soc_percent": {"custom": ["cycles_equivalent"]}}, digits=6))

register("ts_reversals", ES + """,
d AS (SELECT config_id, power_kw, generation_kwh,
        power_kw - lag(power_kw) OVER (PARTITION BY config_id ORDER BY "timestamp") AS dp
      FROM series WHERE power_kw IS NOT NULL),
g AS (SELECT config_id,
        generation_kwh - lag(generation_kwh) OVER (PARTITION BY config_id ORDER BY "timestamp") AS dg
      FROM series WHERE generation_kwh IS NOT NULL)
SELECT d.config_id, round(CAST(count(*) FILTER (WHERE abs(dp) > 0.1) AS DOUBLE), 4) AS power_kw_reversals,
       round(max(gg.rev), 4) AS generation_kwh_reversals
FROM d LEFT JOIN (SELECT config_id, CAST(count(*) FILTER (WHERE abs(dg) > 0.1) AS DOUBLE) AS rev
                  FROM g GROUP BY config_id) gg ON gg.config_id = d.config_id
GROUP BY d.config_id""")(_ts({
    "power_kw": {"custom": ["reversals"]}, "generation_kwh": {"custom": ["reversals"]}}))

register("ts_charge_energy", ES + """
SELECT config_id, round(coalesce(sum(CASE WHEN power_kw > 0 THEN power_kw END), 0), 4) AS power_kw_charge_energy,
  round(coalesce(sum(CASE WHEN power_kw < 0 THEN -power_kw END), 0), 4) AS power_kw_discharge_energy
FROM series GROUP BY config_id""")(_ts({"power_kw": {"custom": ["charge_energy", "discharge_energy"]}}))

register("ts_utilization", ES + """
SELECT config_id, round(avg(CAST(abs(power_kw) > 0.01 AS DOUBLE)), 4) AS power_kw_utilization
FROM series GROUP BY config_id""")(_ts({"power_kw": {"custom": ["utilization"]}}))

register("ts_export_ratio", ES + """
SELECT config_id, round(avg(CAST(grid_export_kwh > 0 AS DOUBLE)), 4) AS grid_export_kwh_export_ratio
FROM series GROUP BY config_id""")(_ts({"grid_export_kwh": {"custom": ["export_ratio"]}}))

register("ts_capacity_factor", ES + """
SELECT config_id,
  round(CASE WHEN count(generation_kwh) > 0 THEN
        CASE WHEN max(generation_kwh) > 0 THEN avg(generation_kwh) / max(generation_kwh) ELSE 0 END END, 4)
    AS generation_kwh_capacity_factor,
  round(CASE WHEN max(grid_export_kwh) > 0 THEN avg(grid_export_kwh) / max(grid_export_kwh) ELSE 0 END, 4)
    AS grid_export_kwh_capacity_factor
FROM series GROUP BY config_id""")(_ts({
    "generation_kwh": {"custom": ["capacity_factor"]}, "grid_export_kwh": {"custom": ["capacity_factor"]}}))

register("ts_zero_generation_ratio", ES + """
SELECT config_id,
  round(CASE WHEN count(generation_kwh) > 0 THEN avg(CAST(generation_kwh = 0 AS DOUBLE)) END, 4)
    AS generation_kwh_zero_generation_ratio,
  round(avg(CAST(grid_import_kwh = 0 AS DOUBLE)), 4) AS grid_import_kwh_zero_generation_ratio
FROM series GROUP BY config_id""")(_ts({
    "generation_kwh": {"custom": ["zero_generation_ratio"]},
    "grid_import_kwh": {"custom": ["zero_generation_ratio"]}}))

register("ts_self_consumption", ES + """
SELECT config_id,
  round(CASE WHEN coalesce(sum(generation_kwh), 0) > 0
             THEN 1 - coalesce(sum(grid_export_kwh), 0) / coalesce(sum(generation_kwh), 0) END, 4)
    AS self_consumption_ratio
FROM series GROUP BY config_id""")(_ts({}, ["self_consumption_ratio"]))

register("ts_load_pv_corr", ES + """
SELECT config_id,
  round(CASE WHEN count(load_kwh) > 10 AND count(generation_kwh) > 10
              AND count(*) FILTER (WHERE load_kwh IS NOT NULL AND generation_kwh IS NOT NULL) > 10
             THEN CASE WHEN stddev_pop(CASE WHEN generation_kwh IS NOT NULL THEN load_kwh END) = 0
                         OR stddev_pop(generation_kwh) = 0 THEN NULL
                       ELSE corr(load_kwh, generation_kwh) END END, 4) AS load_pv_correlation
FROM series GROUP BY config_id""")(_ts({}, ["load_pv_correlation"]))

register("ts_peak_load_ratio", ES + """
SELECT config_id,
  round(CASE WHEN bool_or(hour("timestamp") BETWEEN 9 AND 17) AND bool_or(NOT hour("timestamp") BETWEEN 9 AND 17)
              AND coalesce(sum(load_kwh), 0) > 0
             THEN coalesce(sum(load_kwh) FILTER (WHERE hour("timestamp") BETWEEN 9 AND 17), 0) / sum(load_kwh) END, 4)
    AS temporal__peak_load_ratio
FROM series GROUP BY config_id""")(_ts({}, ["temporal__peak_load_ratio"]))

register("ts_weekend_ratio", ES + """
SELECT config_id,
  round(CASE WHEN bool_or(isodow("timestamp") >= 6) AND coalesce(sum(load_kwh), 0) > 0
             THEN coalesce(sum(load_kwh) FILTER (WHERE isodow("timestamp") >= 6), 0) / sum(load_kwh) END, 4)
    AS temporal__weekend_load_ratio
FROM series GROUP BY config_id""")(_ts({}, ["temporal__weekend_load_ratio"]))

register("ts_summer_winter", with_(SHIP_SERIES) + """
SELECT config_id,
  round(CASE WHEN bool_or(month("timestamp") IN (6, 7, 8)) AND bool_or(month("timestamp") IN (12, 1, 2))
              AND avg(load_kwh) FILTER (WHERE month("timestamp") IN (12, 1, 2)) > 0
             THEN avg(load_kwh) FILTER (WHERE month("timestamp") IN (6, 7, 8))
                  / avg(load_kwh) FILTER (WHERE month("timestamp") IN (12, 1, 2)) END, 4)
    AS temporal__summer_winter_ratio,
  round(CASE WHEN bool_or(hour("timestamp") BETWEEN 9 AND 17) AND bool_or(NOT hour("timestamp") BETWEEN 9 AND 17)
              AND sum(load_kwh) > 0 THEN 0 END, 4) AS temporal__peak_load_ratio,
  round(CASE WHEN bool_or(isodow("timestamp") >= 6) AND sum(load_kwh) > 0
             THEN coalesce(sum(load_kwh) FILTER (WHERE isodow("timestamp") >= 6), 0) / sum(load_kwh) END, 4)
    AS temporal__weekend_load_ratio
FROM ship GROUP BY config_id""")(_ts({}, ["temporal__summer_winter_ratio", "temporal__peak_load_ratio",
                                          "temporal__weekend_load_ratio"], ship=True))


# ---------------------------------------------------------------------------
# Per-id views of the combined statistics queries above (one entry per §2 id).
# ---------------------------------------------------------------------------
from .registry import ORACLE as _ORACLE, QUERIES as _QUERIES  # noqa: E402

_ALIASES = {
    "ts_min": ("ts_mean", ["load_kwh_min", "generation_kwh_min"]),
    "ts_max": ("ts_mean", ["load_kwh_max", "generation_kwh_max"]),
    "ts_sum": ("ts_mean", ["load_kwh_sum", "generation_kwh_sum"]),
    "ts_var": ("ts_std", ["load_kwh_var", "price_eur_mwh_var"]),
    "ts_peak_to_average": ("ts_peak_to_mean", ["grid_import_kwh_peak_to_average"]),
    "ts_price_volatility": ("ts_cv", ["price_eur_mwh_price_volatility"]),
    "ts_price_spread": ("ts_range", ["price_eur_mwh_price_spread"]),
    "ts_time_above_80pct": ("ts_time_below_20pct", ["soc_percent_time_above_80pct"]),
    "ts_discharge_energy": ("ts_charge_energy", ["power_kw_discharge_energy"]),
}


def _view(parent, cols):
    def run(spark, sf):
        return _QUERIES[parent](spark, sf).select("config_id", *cols)
    run.__doc__ = f"Columns {', '.join(cols)} of {parent}."
    return run


for _name, (_parent, _cols) in _ALIASES.items():
    register(_name, f"SELECT config_id, {', '.join(_cols)} FROM ({_ORACLE[_parent]}) t")(_view(_parent, _cols))


@register("ts_feature_names")
def ts_feature_names(spark, sf):
    """Configured feature names (column and cross-column), sorted, with the number of
    series for which each one has a value."""
    from pyspark.sql import functions as F
    feats = S.extract(Model(spark, sf).series, S.SIMULATION_COLUMN_SPECS, S.DF_FEATURE_NAMES)
    listed = S.list_all_features(S.SIMULATION_COLUMN_SPECS, S.DF_FEATURE_NAMES)
    names = listed["column_features"] + listed["custom_features"]
    kinds = {n: "column" for n in listed["column_features"]} | {n: "custom" for n in listed["custom_features"]}
    counts = feats.agg(*[F.count(F.col(n)).alias(n) for n in names])
    long = counts.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.lit(kinds[n]).alias("kind"), F.col(n).alias("n_series"))
        for n in names])))
    return long.orderBy("kind", "feature")
