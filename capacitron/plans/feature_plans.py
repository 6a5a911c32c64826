"""Feature queries: legacy extractors, targets, matrix, X/y, scoring vector, store
(SURVEY §2.6 fx_*, §2.10 ft_*, §2.5 agg_feature_store_summary, §2.9 store ops, §2.1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import benefits as B
from ..operators import features as FT
from ..operators.series_legacy import extract_legacy
from ..session import scratch_path
from .common import Model, rounded
from .model_sql import BENEFIT_CTES, CLIENTS, EVENTS_SERIES, RUNS, SHIP_SERIES, with_
from .registry import register

ES = with_(EVENTS_SERIES)
_P = ", ".join(f"round(quantile_cont(load_kwh, {p / 100}), 4) AS load_p{p}" for p in (10, 25, 50, 75, 90, 95))

register("fx_load_profile", ES + f"""
SELECT config_id, round(avg(load_kwh), 4) AS load_mean, round(stddev_samp(load_kwh), 4) AS load_std,
  round(min(load_kwh), 4) AS load_min, round(max(load_kwh), 4) AS load_max, round(sum(load_kwh), 4) AS load_sum,
  round(CASE WHEN avg(load_kwh) > 0 THEN max(load_kwh) / avg(load_kwh) ELSE 0 END, 4) AS load_peak_to_mean,
  round(CASE WHEN avg(load_kwh) > 0 THEN stddev_samp(load_kwh) / avg(load_kwh) ELSE 0 END, 4) AS load_cv, {_P}
FROM series GROUP BY config_id""")(lambda spark, sf: rounded(extract_legacy(Model(spark, sf).series, ["load_profile"])))

register("fx_battery", ES + """,
d AS (SELECT *, soc_percent - lag(soc_percent) OVER (PARTITION BY config_id ORDER BY "timestamp") AS ds,
             power_kw - lag(power_kw) OVER (PARTITION BY config_id ORDER BY "timestamp") AS dp FROM series)
SELECT config_id, round(avg(soc_percent), 4) AS soc_mean, round(stddev_samp(soc_percent), 4) AS soc_std,
  round(min(soc_percent), 4) AS soc_min, round(max(soc_percent), 4) AS soc_max,
  round(coalesce(sum(abs(ds)), 0) / 200, 6) AS cycles_equivalent,
  round(avg(CAST(soc_percent < 20 AS DOUBLE)), 4) AS time_below_20pct,
  round(avg(CAST(soc_percent > 80 AS DOUBLE)), 4) AS time_above_80pct,
  round(coalesce(sum(CASE WHEN power_kw > 0 THEN power_kw END), 0), 4) AS charge_energy,
  round(coalesce(sum(CASE WHEN power_kw < 0 THEN -power_kw END), 0), 4) AS discharge_energy,
  CAST(count(*) FILTER (WHERE abs(dp) > 0.1) AS DOUBLE) AS power_reversals
FROM d GROUP BY config_id""")(lambda spark, sf: (lambda d: rounded(d.drop("cycles_equivalent")).join(
    d.select("config_id", F.round("cycles_equivalent", 6).alias("cycles_equivalent")), "config_id"))(
        extract_legacy(Model(spark, sf).series, ["battery"])))


@register("fx_temporal", with_(SHIP_SERIES) + """
SELECT config_id,
  round(CASE WHEN bool_or(hour("timestamp") BETWEEN 9 AND 17) AND bool_or(NOT hour("timestamp") BETWEEN 9 AND 17)
        THEN CASE WHEN sum(load_kwh) > 0 THEN coalesce(sum(load_kwh) FILTER (WHERE hour("timestamp") BETWEEN 9 AND 17), 0) / sum(load_kwh) ELSE 0 END END, 4) AS peak_load_ratio,
  round(CASE WHEN bool_or(hour("timestamp") BETWEEN 9 AND 17) AND bool_or(NOT hour("timestamp") BETWEEN 9 AND 17)
        THEN 0 END, 4) AS peak_vs_offpeak,
  round(CASE WHEN bool_or(isodow("timestamp") >= 6) AND bool_or(isodow("timestamp") < 6)
        THEN CASE WHEN sum(load_kwh) > 0 THEN coalesce(sum(load_kwh) FILTER (WHERE isodow("timestamp") >= 6), 0) / sum(load_kwh) ELSE 0 END END, 4)
    AS weekend_load_ratio,
  round(CASE WHEN count(DISTINCT month("timestamp")) >= 6 AND bool_or(month("timestamp") IN (6, 7, 8))
              AND bool_or(month("timestamp") IN (12, 1, 2))
        THEN CASE WHEN avg(load_kwh) FILTER (WHERE month("timestamp") IN (12, 1, 2)) > 0
                  THEN avg(load_kwh) FILTER (WHERE month("timestamp") IN (6, 7, 8))
                       / avg(load_kwh) FILTER (WHERE month("timestamp") IN (12, 1, 2)) ELSE 0 END END, 4) AS summer_winter_ratio
FROM ship GROUP BY config_id""")
def fx_temporal(spark, sf):
    """Calendar features over the multi-year shipment profile (events cover one month)."""
    return rounded(extract_legacy(Model(spark, sf).ship.select("config_id", "timestamp", "load_kwh"), ["temporal"]))


register("fx_grid", ES + """
SELECT config_id, round(coalesce(sum(grid_import_kwh), 0), 4) AS grid_import_total,
  round(max(grid_import_kwh), 4) AS grid_import_max, round(coalesce(sum(grid_export_kwh), 0), 4) AS grid_export_total,
  round(CASE WHEN coalesce(sum(generation_kwh), 0) > 0 THEN 1 - coalesce(sum(grid_export_kwh), 0) / sum(generation_kwh)
        ELSE 0 END, 4) AS self_consumption_ratio
FROM series GROUP BY config_id""")(lambda spark, sf: rounded(extract_legacy(Model(spark, sf).series, ["grid"])))

_TARGETS_SQL = """
SELECT config_id, round(peak_shaving_benefit, 4) AS target_peak_shaving_benefit,
  round(energy_procurement_optimization, 4) AS target_energy_procurement_optimization,
  round(trading_revenue, 4) AS target_trading_revenue
FROM benefits WHERE peak_shaving_benefit IS NOT NULL OR energy_procurement_optimization IS NOT NULL
   OR trading_revenue IS NOT NULL"""


@register("ft_targets", with_(*BENEFIT_CTES) + _TARGETS_SQL)
def ft_targets(spark, sf):
    """target_<kpi> columns pivoted from the saved benefit KPI rows (fixed value list)."""
    m = Model(spark, sf)
    return rounded(FT.targets(B.benefits_as_kpis(B.benefits(m.configs, m.kpis))))


@register("ft_kpi_inputs", with_(*BENEFIT_CTES) + """
SELECT c.config_id, round(coalesce(c.battery_capacity_kwh, w.k_ic), 4) AS battery_capacity_kwh,
       round(coalesce(c.battery_power_kw, w.k_ic / 2), 4) AS battery_power_kw
FROM configs c LEFT JOIN (SELECT config_id, k_ic FROM wide) w ON w.config_id = c.config_id""")
def ft_kpi_inputs(spark, sf):
    """Direct inputs from configuration metadata first, KPI rows as the fallback."""
    m = Model(spark, sf)
    k = m.kpis
    derived = k.unionByName(k.filter(F.col("kpi_name") == "annual_total_energy_trade_cost_ic")
                            .withColumn("kpi_name", F.lit("half_ic")).withColumn("kpi_value", F.col("kpi_value") / 2))
    return rounded(FT.kpi_inputs(m.configs, derived, {"battery_capacity_kwh": "annual_total_energy_trade_cost_ic",
                                                      "battery_power_kw": "half_ic"}))


_MATRIX_SQL = with_(*BENEFIT_CTES, CLIENTS, RUNS, EVENTS_SERIES) + """,
ts AS (SELECT config_id AS client_id, avg(load_kwh) AS m, max(load_kwh) AS mx, stddev_samp(load_kwh) AS sd,
              quantile_cont(load_kwh, 0.5) AS p50, quantile_cont(load_kwh, 0.9) AS p90,
              CASE WHEN count(generation_kwh) > 0 THEN coalesce(sum(generation_kwh), 0) END AS gs,
              CASE WHEN count(generation_kwh) > 0 THEN CASE WHEN max(generation_kwh) > 0
                   THEN avg(generation_kwh) / max(generation_kwh) ELSE 0 END END AS cf,
              CASE WHEN coalesce(sum(generation_kwh), 0) > 0
                   THEN 1 - coalesce(sum(grid_export_kwh), 0) / sum(generation_kwh) END AS scr,
              CASE WHEN bool_or(isodow("timestamp") >= 6) AND coalesce(sum(load_kwh), 0) > 0
                   THEN coalesce(sum(load_kwh) FILTER (WHERE isodow("timestamp") >= 6), 0) / sum(load_kwh) END AS wr
       FROM series GROUP BY config_id),
mat AS (
  SELECT c.config_id, cl.client_name, r.run_name, c.config_name, c.battery_capacity_kwh, c.battery_power_kw,
         c.battery_efficiency, ts.m AS ts__load_kwh_mean, ts.mx AS ts__load_kwh_max, ts.sd AS ts__load_kwh_std,
         ts.p50 AS ts__load_kwh_p50, ts.p90 AS ts__load_kwh_p90,
         CASE WHEN ts.m > 0 THEN ts.mx / ts.m WHEN ts.m IS NULL THEN NULL ELSE 0 END AS ts__load_kwh_peak_to_mean,
         ts.gs AS ts__generation_kwh_sum, ts.cf AS ts__generation_kwh_capacity_factor,
         ts.scr AS ts__self_consumption_ratio, ts.wr AS ts__temporal__weekend_load_ratio,
         b.peak_shaving_benefit AS target_peak_shaving_benefit,
         b.energy_procurement_optimization AS target_energy_procurement_optimization,
         b.trading_revenue AS target_trading_revenue, b.peak_shaving_benefit AS target
  FROM configs c JOIN runs r ON c.run_id = r.run_id JOIN clients cl ON r.client_id = cl.client_id
  LEFT JOIN ts ON ts.client_id = r.client_id LEFT JOIN benefits b ON b.config_id = c.config_id
  WHERE NOT c.is_baseline)
"""
_MAT_COLS = ("battery_capacity_kwh battery_power_kw battery_efficiency ts__load_kwh_mean ts__load_kwh_max "
             "ts__load_kwh_std ts__load_kwh_p50 ts__load_kwh_p90 ts__load_kwh_peak_to_mean ts__generation_kwh_sum "
             "ts__generation_kwh_capacity_factor ts__self_consumption_ratio ts__temporal__weekend_load_ratio").split()


def _matrix(spark, sf):
    m = Model(spark, sf)
    return FT.matrix(m.configs, m.kpis, m.runs, m.clients, m.series)


def _stored_matrix(spark, sf):
    """The feature matrix as written by the extraction step (feature store snapshot), once for
    each state of the driver tables; model queries train from it."""
    from ..sources import tables as T
    from ..sources.files import exists, memo, touch
    root = scratch_path(spark, "matrix-" + T.tag(spark, sf))
    if not exists(root, "_SUCCESS"):
        _matrix(spark, sf).write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/data")
        touch(root, "_SUCCESS")
    return memo(spark, ("matrix", root), lambda: spark.read.parquet(f"{root}/data"))


register("ft_matrix", _MATRIX_SQL + "SELECT config_id, client_name, run_name, config_name, "
         + ", ".join(f"round({c}, 4) AS {c}" for c in _MAT_COLS + ["target_peak_shaving_benefit",
                                                                  "target_energy_procurement_optimization",
                                                                  "target_trading_revenue", "target"])
         + " FROM mat")(lambda spark, sf: rounded(_matrix(spark, sf)))

register("ft_xy", _MATRIX_SQL + "SELECT config_id, client_name, "
         + ", ".join(f"round({c}, 4) AS {c}" for c in _MAT_COLS) + ", round(target, 4) AS label FROM mat "
         "WHERE target IS NOT NULL")(lambda spark, sf: rounded(FT.xy(_matrix(spark, sf))))

register("ft_vector", _MATRIX_SQL + "SELECT config_id, "
         + ", ".join(f"CASE WHEN {c} IS NULL OR isnan({c}) OR isinf({c}) THEN 0.0 ELSE round({c}, 4) END AS {c}"
                     for c in reversed(_MAT_COLS)) + " FROM mat")(
    lambda spark, sf: rounded(FT.vector(_matrix(spark, sf), list(reversed(_MAT_COLS)))))

register("agg_feature_store_summary", _MATRIX_SQL + """
SELECT count(*) AS n_configs, 13 AS n_features, 10 AS n_timeseries_features, 3 AS n_direct_features, 3 AS n_targets FROM mat""")(
    lambda spark, sf: FT.store_summary(_matrix(spark, sf)))


@register("ft_metadata")
def ft_metadata(spark, sf):
    """Feature list, counts, version and extraction time of the matrix (one row)."""
    return FT.metadata(_matrix(spark, sf), "peak_shaving_benefit")


@register("snk_feature_parquet")
def snk_feature_parquet(spark, sf):
    """Write the matrix as a Parquet snapshot clustered by client, read it back."""
    import uuid
    store = FT.FeatureStore(spark, scratch_path(spark, f"features-{uuid.uuid4().hex[:8]}"))
    store.save(_matrix(spark, sf))
    return store.load()


@register("set_upsert_features")
def set_upsert_features(spark, sf):
    """Store the matrix without series features, then upsert the full rows of runs that
    have them: replaced rows + new columns; re-running the same upsert is a no-op."""
    import uuid
    store = FT.FeatureStore(spark, scratch_path(spark, f"features-{uuid.uuid4().hex[:8]}"))
    mat = _stored_matrix(spark, sf)                            # three passes read it
    base_cols = [c for c in mat.columns if not c.startswith("ts__")]
    store.save(mat.select(*base_cols))
    store.upsert(mat.filter(F.col("ts__load_kwh_mean").isNotNull()))
    return store.load()


@register("set_processed_ids")
def set_processed_ids(spark, sf):
    import uuid
    store = FT.FeatureStore(spark, scratch_path(spark, f"features-{uuid.uuid4().hex[:8]}"))
    store.save(_matrix(spark, sf).select("config_id", "client_name"))
    return store.processed_ids()


@register("set_clear_store")
def set_clear_store(spark, sf):
    import uuid
    store = FT.FeatureStore(spark, scratch_path(spark, f"features-{uuid.uuid4().hex[:8]}"))
    mat = _matrix(spark, sf).select("config_id", "client_name")
    store.save(mat)
    store.clear(mat.schema)
    return store.load()
