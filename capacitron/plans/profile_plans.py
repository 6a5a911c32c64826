"""Profile queries: PV scaling and merge, weekday totals, average week, waterfall,
profile view, ratio features (SURVEY §2.10, §2.5, §2.7, §2.1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import benefits as B
from ..operators import profile as P
from ..sources import tables as T
from .common import Model, rounded
from .model_sql import BENEFIT_CTES, LOAD_PROFILE, PV_PROFILE, PV_SCALED, SUBMISSIONS, with_
from .registry import register

CONSUMED_SHARE = 0.33
MERGED = with_(LOAD_PROFILE, PV_PROFILE, PV_SCALED)


def _merged(spark, sf):
    load, pv = T.load_profile(spark, sf), T.pv_profile(spark, sf)
    return P.merge_load_pv(load, P.weekday_scale(load, pv, CONSUMED_SHARE))


register("pv_weekday_scale", MERGED + """
SELECT site_id, timestamp_utc, round(pv_scaled_kwh, 4) AS pv_scaled_kwh FROM scaled""")(
    lambda spark, sf: rounded(P.weekday_scale(T.load_profile(spark, sf), T.pv_profile(spark, sf), CONSUMED_SHARE)))

register("pv_merge", MERGED + """
SELECT site_id, timestamp_utc, round(grid_load_kwh, 4) AS grid_load_kwh, round(consumption_kwh, 4) AS consumption_kwh,
       round(pv_load_kwh, 4) AS pv_load_kwh FROM merged""")(lambda spark, sf: rounded(_merged(spark, sf)))

register("jn_load_pv", with_(LOAD_PROFILE, PV_PROFILE) + """
SELECT l.site_id, l.timestamp_utc, round(l.grid_load_kwh, 4) AS grid_load_kwh,
       round(coalesce(p.pv_generation_kwh, 0), 4) AS pv_generation_kwh
FROM lp l LEFT JOIN pv p ON l.site_id = p.site_id AND l.timestamp_utc = p.timestamp_utc""")(
    lambda spark, sf: rounded(T.load_profile(spark, sf).join(T.pv_profile(spark, sf), ["site_id", "timestamp_utc"], "left")
                              .fillna(0.0, ["pv_generation_kwh"])))

register("agg_weekday_totals", with_(LOAD_PROFILE) + """,
per AS (SELECT site_id, isodow(timestamp_utc) - 1 AS weekday, sum(grid_load_kwh) AS total FROM lp GROUP BY 1, 2),
st AS (SELECT site_id, sum(total) AS s FROM per GROUP BY 1),
g AS (SELECT site_id, unnest(range(0, 7)) AS weekday FROM (SELECT DISTINCT site_id FROM lp))
SELECT g.site_id, g.weekday, round(coalesce(per.total, 0), 4) AS total, round(coalesce(per.total / st.s, 0), 4) AS share
FROM g LEFT JOIN per ON g.site_id = per.site_id AND g.weekday = per.weekday LEFT JOIN st ON st.site_id = g.site_id""")(
    lambda spark, sf: rounded(P.weekday_totals(T.load_profile(spark, sf))))

def pv_scale_annual(spark, sf):
    """Scale each site's PV shape (here: its observed profile as W) to the submission's
    annual target (MWh)."""
    from ..operators.inputs import normalise_pv
    shape = T.pv_profile(spark, sf).select("site_id", "timestamp_utc",
                                           (F.col("pv_generation_kwh") * 4000).alias("pv_power_w"))
    tg = normalise_pv(T.submissions(spark, sf)).select(F.col("submission_id").alias("site_id"), "pv_target_mwh")
    return rounded(P.scale_annual(shape, tg).select("site_id", "timestamp_utc", "pv_generation_kwh"))



register("agg_average_week", MERGED + """,
a AS (SELECT site_id, (isodow(timestamp_utc) - 1) * 96 + hour(timestamp_utc) * 4 + CAST(floor(minute(timestamp_utc) / 15) AS INT) AS slot,
             avg(coalesce(consumption_kwh, grid_load_kwh, 0)) AS value, avg(coalesce(pv_load_kwh, 0)) AS pv
      FROM merged GROUP BY 1, 2),
g AS (SELECT site_id, unnest(range(0, 672)) AS slot FROM (SELECT DISTINCT site_id FROM merged))
SELECT g.site_id, g.slot AS global_index,
       ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][CAST(floor(g.slot / 96) AS INT) + 1] || ' '
         || lpad(CAST(CAST(floor((g.slot % 96) / 4) AS INT) AS VARCHAR), 2, '0') || ':'
         || lpad(CAST((g.slot % 4) * 15 AS VARCHAR), 2, '0') AS label,
       round(coalesce(a.value, 0), 4) AS value, round(coalesce(a.pv, 0), 4) AS pv
FROM g LEFT JOIN a ON g.site_id = a.site_id AND g.slot = a.slot""")(
    lambda spark, sf: rounded(P.average_week(_merged(spark, sf))))

register("win_waterfall", with_(*BENEFIT_CTES) + """,
l AS (SELECT config_id, 0 AS step, 'peak_shaving_benefit' AS component, coalesce(peak_shaving_benefit, 0) AS amount FROM benefits
      UNION ALL SELECT config_id, 1, 'energy_procurement_optimization', coalesce(energy_procurement_optimization, 0) FROM benefits
      UNION ALL SELECT config_id, 2, 'trading_revenue', coalesce(trading_revenue, 0) FROM benefits),
r AS (SELECT config_id, step, component, amount,
             sum(amount) OVER (PARTITION BY config_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM l)
SELECT config_id, step, component, round(e - amount, 4) AS bar_start, round(e, 4) AS bar_end FROM r
UNION ALL SELECT config_id, 3, 'total', 0.0, round(sum(amount), 4) FROM l GROUP BY config_id""")(
    lambda spark, sf: (lambda m: rounded(P.waterfall(B.benefits(m.configs, m.kpis))))(Model(spark, sf)))

register("snk_profile_view", MERGED + """
SELECT site_id, strftime(timestamp_utc, '%Y-%m-%dT%H:%M:%SZ') AS timestamp_utc, round_even(grid_load_kwh, 2) AS grid_load_kwh,
       round_even(consumption_kwh, 2) AS consumption_kwh, round_even(pv_load_kwh, 2) AS pv_load_kwh FROM merged""")(
    lambda spark, sf: P.profile_view(_merged(spark, sf)))



def ft_ratio(spark, sf):
    """Battery capacity per kWh of consumption: direct input ÷ Σ consumption per site."""
    d = T.submissions(spark, sf).select(F.col("submission_id").alias("site_id"), "battery_capacity")
    return rounded(P.ratio_feature(d, _merged(spark, sf), "battery_capacity", "consumption_kwh",
                                   "capacity_per_consumption"), 8)


register("ft_ratio", MERGED + """,
""" + SUBMISSIONS + """,
den AS (SELECT site_id, sum(consumption_kwh) AS d FROM merged GROUP BY 1)
SELECT s.submission_id AS site_id, round(CASE WHEN den.d <> 0 THEN s.battery_capacity / den.d END, 8) AS capacity_per_consumption
FROM subs s LEFT JOIN den ON den.site_id = s.submission_id""")(ft_ratio)
register("pv_scale_annual", """WITH """ + PV_PROFILE + """,
""" + SUBMISSIONS + """,
t AS (SELECT submission_id AS site_id, coalesce(pv_peak_power, CASE WHEN coalesce(pv_annual_total, 50) > 10
             THEN coalesce(pv_annual_total, 50) ELSE coalesce(pv_annual_total, 50) / 1000.0 END) AS target FROM subs),
w AS (SELECT site_id, timestamp_utc, pv_generation_kwh * 4000 AS pv_power_w FROM pv),
e AS (SELECT site_id, sum(pv_power_w) / 4 AS wh FROM w GROUP BY 1)
SELECT w.site_id, w.timestamp_utc, round(w.pv_power_w * (t.target * 1e6 / e.wh) / 4e3, 4) AS pv_generation_kwh
FROM w JOIN e ON w.site_id = e.site_id JOIN t ON t.site_id = w.site_id""")(pv_scale_annual)
