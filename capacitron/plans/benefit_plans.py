"""Benefit queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import benefits as B
from ..operators.snapshots import SnapshotTable
from ..session import scratch_path
from .common import Model, rounded
from .model_sql import (BASELINE, BENEFIT_CTES, CLIENTS, CONFIGS, GRP, KPIS, RUNS, WIDE,
                        with_)
from .registry import register


def _bn_all(spark, sf):
    m = Model(spark, sf)
    out = B.benefits(m.configs, m.kpis, m.runs, m.clients)
    return rounded(out.select("config_id", "client_name", "run_name", "config_name",
                              "battery_capacity_kwh", "battery_power_kw", "is_baseline",
                              "baseline_config_id", *B.BenefitBook().names))


register("bn_all", with_(*BENEFIT_CTES, CLIENTS, RUNS) + """
SELECT b.config_id, cl.client_name, r.run_name, b.config_name,
       round(b.battery_capacity_kwh, 4) AS battery_capacity_kwh,
       round(b.battery_power_kw, 4) AS battery_power_kw, b.is_baseline, b.baseline_config_id,
       round(b.peak_shaving_benefit, 4) AS peak_shaving_benefit,
       round(b.energy_procurement_optimization, 4) AS energy_procurement_optimization,
       round(b.trading_revenue, 4) AS trading_revenue
FROM benefits b JOIN runs r ON b.run_id = r.run_id JOIN clients cl ON r.client_id = cl.client_id
""")(_bn_all)


@register("bn_run", with_(GRP, CONFIGS, KPIS, BASELINE, WIDE) + """
SELECT c.config_id, c.run_id, c.is_baseline, b.baseline_config_id,
       round(CASE WHEN c.is_baseline THEN 0.0 ELSE base.k_ic_fee - bat.k_ic_fee END, 4) AS peak_shaving_benefit,
       round(CASE WHEN c.is_baseline THEN 0.0 ELSE base.k_da - bat.k_da END, 4) AS energy_procurement_optimization,
       round(CASE WHEN c.is_baseline THEN 0.0 ELSE (base.k_ia - bat.k_ia) + (base.k_ic - bat.k_ic) END, 4)
         AS trading_revenue
FROM configs c JOIN baseline b ON c.run_id = b.run_id
LEFT JOIN wide bat ON bat.config_id = c.config_id
LEFT JOIN wide base ON base.config_id = b.baseline_config_id
""")
def bn_run(spark, sf):
    """Per-run benefits *including* the flagged baseline (benefit 0 by definition)."""
    m = Model(spark, sf)
    out = B.benefits(m.configs, m.kpis, include_baseline=True)
    return rounded(out.select("config_id", "run_id", "is_baseline", "baseline_config_id",
                              *B.BenefitBook().names))


@register("win_baseline_pick", with_(GRP, CONFIGS, BASELINE) + "SELECT run_id, baseline_config_id FROM baseline")
def win_baseline_pick(spark, sf):
    m = Model(spark, sf)
    return B.pick_baselines(m.configs)


@register("win_baseline_pick_ml", with_(GRP, CONFIGS) + """
SELECT run_id, config_id AS baseline_config_id FROM (
  SELECT run_id, config_id, row_number() OVER (PARTITION BY run_id
         ORDER BY is_baseline DESC, battery_capacity_kwh ASC NULLS FIRST, config_id) AS rn
  FROM configs
  WHERE is_baseline OR battery_capacity_kwh = 0
     OR lower(config_name) IN ('0kwh','0_kwh','no_battery','0_battery','baseline','no battery','0')
     OR starts_with(lower(config_name), '0kwh')) WHERE rn = 1""")
def win_baseline_pick_ml(spark, sf):
    """ML variant: flagged first, then capacity ascending with NULL first; no NULL-capacity
    candidates."""
    from ..functions.scalars import is_baseline_name
    c = Model(spark, sf).configs
    cap = F.col("battery_capacity_kwh")
    cand = c.filter(F.col("is_baseline") | (cap == 0) | is_baseline_name(F.col("config_name")))
    key = F.struct((~F.col("is_baseline")).alias("a"), cap.isNotNull().alias("b"),
                   F.coalesce(cap, F.lit(0.0)).alias("c"), F.col("config_id").alias("d"))
    return (cand.groupBy("run_id").agg(F.min(key).alias("k"))
            .select("run_id", F.col("k.d").alias("baseline_config_id")))


@register("jn_baseline_self", with_(GRP, CONFIGS, KPIS, BASELINE) + """
SELECT k.config_id, k.kpi_name, round(k.kpi_value, 4) AS battery_value,
       round(bk.kpi_value, 4) AS baseline_value, round(bk.kpi_value - k.kpi_value, 4) AS difference
FROM kpis k JOIN configs c ON k.config_id = c.config_id
JOIN baseline b ON c.run_id = b.run_id
JOIN kpis bk ON bk.config_id = b.baseline_config_id AND bk.kpi_name = k.kpi_name""")
def jn_baseline_self(spark, sf):
    """Each configuration's KPI rows against the same KPI of its run's baseline (long form)."""
    m = Model(spark, sf)
    base = B.pick_baselines(m.configs)
    k = m.kpis.join(m.configs.select("config_id", "run_id"), "config_id").join(base, "run_id")
    bk = m.kpis.select(F.col("config_id").alias("baseline_config_id"), "kpi_name",
                       F.col("kpi_value").alias("baseline_value"))
    out = k.join(bk, ["baseline_config_id", "kpi_name"]).select(
        "config_id", "kpi_name", F.col("kpi_value").alias("battery_value"), "baseline_value",
        (F.col("baseline_value") - F.col("kpi_value")).alias("difference"))
    return rounded(out)


@register("bn_simple", with_(*BENEFIT_CTES) + """
SELECT config_id, round(peak_shaving_benefit, 4) AS peak_shaving_benefit,
       round(energy_procurement_optimization, 4) AS energy_procurement_optimization FROM benefits""")
def bn_simple(spark, sf):
    m = Model(spark, sf)
    book = B.BenefitBook()
    book.items = [b for b in book.items if len(b.kpis) == 1]
    return rounded(B.benefits(m.configs, m.kpis, book=book)
                   .select("config_id", *book.names))


@register("bn_composite", with_(*BENEFIT_CTES) + """
SELECT config_id, round(trading_revenue, 4) AS trading_revenue FROM benefits""")
def bn_composite(spark, sf):
    m = Model(spark, sf)
    book = B.BenefitBook()
    book.items = [b for b in book.items if len(b.kpis) > 1]
    return rounded(B.benefits(m.configs, m.kpis, book=book).select("config_id", "trading_revenue"))


@register("bn_custom", with_(*BENEFIT_CTES) + """
SELECT b.config_id, round(base.net_like - bat.net_like, 4) AS peak_shaving_benefit,
       round(bat.k_ia - base.k_ia, 4) AS tax_increase
FROM benefits b
JOIN (SELECT config_id, k_da AS net_like, k_ia FROM wide) bat ON bat.config_id = b.config_id
JOIN (SELECT config_id, k_da AS net_like, k_ia FROM wide) base ON base.config_id = b.baseline_config_id""")
def bn_custom(spark, sf):
    """Registering custom definitions: one replaces a built-in benefit, one is new and
    uses the reversed formula."""
    m = Model(spark, sf)
    book = B.BenefitBook()
    book.items = []
    book.add("peak_shaving_benefit", baseline_kpi="annual_total_energy_trade_cost_da")
    book.add("tax_increase", baseline_kpi="annual_total_energy_trade_cost_ia",
             calculation="battery - baseline")
    out = B.benefits(m.configs, m.kpis, book=book)
    return rounded(out.filter(F.col("peak_shaving_benefit").isNotNull()
                              & F.col("tax_increase").isNotNull())
                   .select("config_id", *book.names))


@register("agg_benefit_summary", with_(*BENEFIT_CTES) + """,
long AS (
  SELECT 'peak_shaving_benefit' AS benefit_name, peak_shaving_benefit AS v FROM benefits
  UNION ALL SELECT 'energy_procurement_optimization', energy_procurement_optimization FROM benefits
  UNION ALL SELECT 'trading_revenue', trading_revenue FROM benefits)
SELECT benefit_name, count(v) AS count, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std,
       round(min(v), 4) AS min, round(max(v), 4) AS max
FROM long GROUP BY benefit_name""")
def agg_benefit_summary(spark, sf):
    m = Model(spark, sf)
    s = B.benefit_summary(B.benefits(m.configs, m.kpis))
    return rounded(s.select("benefit_name", "count", "mean", "std", "min", "max"))


@register("bn_save", with_(*BENEFIT_CTES) + """
SELECT * FROM (
  SELECT config_id, 'peak_shaving_benefit' AS kpi_name, round(peak_shaving_benefit, 4) AS kpi_value,
         'EUR/year' AS kpi_unit FROM benefits
  UNION ALL SELECT config_id, 'energy_procurement_optimization', round(energy_procurement_optimization, 4),
         'EUR/year' FROM benefits
  UNION ALL SELECT config_id, 'trading_revenue', round(trading_revenue, 4), 'EUR/year' FROM benefits)
WHERE kpi_value IS NOT NULL""")
def bn_save(spark, sf):
    """Benefits as KPI rows, merged into a stored KPI table on (config_id, kpi_name) and read back.

    The merge is run twice, as a job that is started again would: the second finds nothing to
    change and writes nothing."""
    m = Model(spark, sf)
    run = uuid.uuid4().hex
    rows = B.benefits_as_kpis(B.benefits(m.configs, m.kpis))
    rows.write.parquet(scratch_path(spark, f"benefit-rows-{run}"))
    rows = spark.read.schema(rows.schema).parquet(scratch_path(spark, f"benefit-rows-{run}"))
    store = SnapshotTable(spark, scratch_path(spark, f"kpi-store-{run}"), ["config_id", "kpi_name"])
    store.merge(m.kpis.select("config_id", "kpi_name", "kpi_value", "kpi_unit"))
    store.merge(rows)
    store.merge(rows)
    return rounded(store.read().where(F.col("kpi_name").isin(B.BenefitBook().names)))


@register("set_union_runs", with_(*BENEFIT_CTES) + """
SELECT run_id, count(*) AS n_configs, round(sum(peak_shaving_benefit), 4) AS total_peak_shaving
FROM benefits GROUP BY run_id""")
def set_union_runs(spark, sf):
    """Per-run benefit frames concatenated; here one set-based plan, summarised per run."""
    m = Model(spark, sf)
    b = B.benefits(m.configs, m.kpis)
    return rounded(b.groupBy("run_id").agg(F.count("*").alias("n_configs"),
                                           F.sum("peak_shaving_benefit").alias("total_peak_shaving")))
