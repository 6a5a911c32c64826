"""DuckDB CTEs that rebuild the storage-sizing model from the driver tables.

They mirror :mod:`capacitron.sources.tables` and are used only by the oracle SQL.
"""

GRP = """grp AS (
  SELECT l_orderkey, l_linenumber, sum(l_quantity) AS qty, sum(l_extendedprice) AS price,
         sum(l_extendedprice * (1 - l_discount)) AS net, sum(l_extendedprice * l_tax) AS tax,
         max(l_discount) AS max_disc
  FROM lineitem GROUP BY l_orderkey, l_linenumber)"""

CONFIGS = """configs AS (
  SELECT l_orderkey * 10 + l_linenumber AS config_id, l_orderkey AS run_id,
         CASE WHEN l_linenumber = 1 THEN 'no_battery'
              WHEN l_linenumber = 7 THEN 'battery_' || CAST(l_linenumber AS VARCHAR)
              ELSE CAST(CAST(floor(qty) AS BIGINT) AS VARCHAR) || 'kWh_'
                   || CAST(CAST(floor(qty / 2) AS BIGINT) AS VARCHAR) || 'kW' END AS config_name,
         l_linenumber = 1 AS is_baseline,
         CASE WHEN l_linenumber = 1 THEN 0.0 WHEN l_linenumber = 7 THEN NULL ELSE qty END
           AS battery_capacity_kwh,
         CASE WHEN l_linenumber = 1 THEN 0.0 WHEN l_linenumber = 7 THEN NULL
              ELSE CAST(floor(qty / 2) AS DOUBLE) END AS battery_power_kw,
         1 - max_disc AS battery_efficiency,
         l_linenumber AS ln
  FROM grp)"""

KPIS = """kpis AS (
  SELECT * FROM (
    SELECT (l_orderkey * 10 + l_linenumber) * 10 + 1 AS kpi_id, l_orderkey * 10 + l_linenumber AS config_id,
           'annual_total_grid_fee_cost_ic' AS kpi_name, price AS kpi_value, 'EUR' AS kpi_unit FROM grp
    UNION ALL
    SELECT (l_orderkey * 10 + l_linenumber) * 10 + 2, l_orderkey * 10 + l_linenumber,
           'annual_total_energy_trade_cost_da', net, 'EUR' FROM grp
    UNION ALL
    SELECT (l_orderkey * 10 + l_linenumber) * 10 + 3, l_orderkey * 10 + l_linenumber,
           'annual_total_energy_trade_cost_ia', tax, 'EUR' FROM grp
    UNION ALL
    SELECT (l_orderkey * 10 + l_linenumber) * 10 + 4, l_orderkey * 10 + l_linenumber,
           'annual_total_energy_trade_cost_ic', CASE WHEN l_linenumber <> 7 THEN qty END, 'EUR' FROM grp
  ) WHERE kpi_value IS NOT NULL)"""

CLIENTS = """clients AS (
  SELECT c_custkey AS client_id, c_name AS client_name, c_mktsegment AS description,
         c_nationkey AS group_key FROM customer)"""

RUNS = """runs AS (
  SELECT o_orderkey AS run_id, o_custkey AS client_id, 'Run_' || CAST(o_orderkey AS VARCHAR) AS run_name,
         o_orderdate AS run_date,
         '{"tariff":"' || o_orderpriority || '","solar_capacity_kw":'
           || CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR)
           || ',"status":"' || o_orderstatus || '"}' AS input_parameters,
         o_totalprice AS run_value
  FROM orders)"""

# Baseline per run: flagged first, then capacity 0, then NULL capacity, then the name rule.
BASELINE = """baseline AS (
  SELECT run_id, config_id AS baseline_config_id FROM (
    SELECT run_id, config_id, row_number() OVER (PARTITION BY run_id ORDER BY prio, config_id) AS rn
    FROM (SELECT run_id, config_id,
                 CASE WHEN is_baseline THEN 0 WHEN battery_capacity_kwh = 0 THEN 1
                      WHEN battery_capacity_kwh IS NULL THEN 2
                      WHEN lower(config_name) IN ('0kwh','0_kwh','no_battery','0_battery','baseline','no battery','0')
                           OR starts_with(lower(config_name), '0kwh') THEN 3 END AS prio
          FROM configs) WHERE prio IS NOT NULL) WHERE rn = 1)"""

WIDE = """wide AS (
  SELECT config_id,
         max(CASE WHEN kpi_name = 'annual_total_grid_fee_cost_ic' THEN kpi_value END) AS k_ic_fee,
         max(CASE WHEN kpi_name = 'annual_total_energy_trade_cost_da' THEN kpi_value END) AS k_da,
         max(CASE WHEN kpi_name = 'annual_total_energy_trade_cost_ia' THEN kpi_value END) AS k_ia,
         max(CASE WHEN kpi_name = 'annual_total_energy_trade_cost_ic' THEN kpi_value END) AS k_ic
  FROM kpis GROUP BY config_id)"""

BENEFITS = """benefits AS (
  SELECT c.config_id, c.run_id, c.config_name, c.battery_capacity_kwh, c.battery_power_kw,
         c.is_baseline, b.baseline_config_id,
         base.k_ic_fee - bat.k_ic_fee AS peak_shaving_benefit,
         base.k_da - bat.k_da AS energy_procurement_optimization,
         (base.k_ia - bat.k_ia) + (base.k_ic - bat.k_ic) AS trading_revenue
  FROM configs c JOIN baseline b ON c.run_id = b.run_id
  LEFT JOIN wide bat ON bat.config_id = c.config_id
  LEFT JOIN wide base ON base.config_id = b.baseline_config_id
  WHERE NOT c.is_baseline)"""

EVENTS_SERIES = """series AS (
  SELECT user_id AS config_id, ts AS "timestamp", value AS load_kwh,
         CASE WHEN event_type = 'view' THEN value END AS generation_kwh,
         CASE WHEN event_type IN ('purchase', 'signup') THEN value ELSE -value END AS power_kw,
         least(value, 100.0) AS soc_percent,
         CASE WHEN event_type = 'purchase' THEN 0.0 ELSE value END AS grid_import_kwh,
         CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END AS grid_export_kwh,
         value - 25 AS price_eur_mwh
  FROM events)"""

SHIP_SERIES = """ship AS (
  SELECT l_suppkey AS config_id, l_shipdate AS "timestamp", l_quantity AS load_kwh,
         l_extendedprice AS grid_load_kwh FROM lineitem)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


MODEL = (GRP, CONFIGS, KPIS)
BENEFIT_CTES = (GRP, CONFIGS, KPIS, BASELINE, WIDE, BENEFITS)

SUBMISSIONS = """subs AS (
  SELECT o_orderkey AS submission_id, CAST(floor(o_totalprice / 1000) AS DOUBLE) AS battery_capacity,
         CAST(floor(o_totalprice / 4000) AS DOUBLE) AS battery_power, CAST(365.0 AS DOUBLE) AS list_battery_num_annual_cycles,
         CASE WHEN o_orderstatus <> 'O' THEN round(o_totalprice / 10000, 2) END AS pv_peak_power,
         CASE WHEN o_orderstatus <> 'F' THEN round(o_totalprice / 100000, 3) END AS pv_annual_total,
         CASE WHEN starts_with(o_orderpriority, '1') THEN CAST(80.0 AS DOUBLE) WHEN starts_with(o_orderpriority, '2') THEN 150.0
              WHEN starts_with(o_orderpriority, '3') THEN -0.2 ELSE 0.33 END AS pv_consumed_percentage,
         CASE WHEN NOT starts_with(o_orderpriority, '5')
              THEN CAST(substring(o_orderpriority, 1, 1) AS DOUBLE) * 3.5 END AS arbeitspreis,
         CASE WHEN starts_with(o_orderpriority, '4') THEN 0.0
              ELSE 100 + CAST(substring(o_orderpriority, 1, 1) AS DOUBLE) * 10 END AS leistungspreis
  FROM orders)"""

LOAD_PROFILE = """lp AS (
  SELECT user_id AS site_id, time_bucket(INTERVAL 15 MINUTE, ts) AS timestamp_utc, sum(value) AS grid_load_kwh
  FROM events GROUP BY 1, 2)"""

PV_PROFILE = """pv AS (
  SELECT user_id AS site_id, time_bucket(INTERVAL 15 MINUTE, ts) AS timestamp_utc, sum(value) AS pv_generation_kwh
  FROM events WHERE event_type = 'view' GROUP BY 1, 2)"""

# weekday scaling with a consumed share of 0.33 (the sample submission's value)
PV_SCALED = """wl AS (SELECT site_id, isodow(timestamp_utc) - 1 AS wd, sum(grid_load_kwh) AS s FROM lp GROUP BY 1, 2),
wt AS (SELECT site_id, sum(s) AS total FROM wl GROUP BY 1),
pvs AS (SELECT site_id, timestamp_utc, isodow(timestamp_utc) - 1 AS wd, pv_generation_kwh * 0.33 AS self_kwh FROM pv),
pw AS (SELECT site_id, wd, sum(self_kwh) AS s FROM pvs GROUP BY 1, 2),
pt AS (SELECT site_id, sum(self_kwh) AS total FROM pvs GROUP BY 1),
fac AS (SELECT pw.site_id, pw.wd,
               CASE WHEN pw.s > 0 THEN pt.total * coalesce(wl.s / wt.total, 0) / pw.s ELSE 0 END AS factor
        FROM pw JOIN pt ON pw.site_id = pt.site_id
        LEFT JOIN wl ON wl.site_id = pw.site_id AND wl.wd = pw.wd
        LEFT JOIN wt ON wt.site_id = pw.site_id),
scaled AS (SELECT p.site_id, p.timestamp_utc, p.self_kwh * f.factor AS pv_scaled_kwh
           FROM pvs p JOIN fac f ON p.site_id = f.site_id AND p.wd = f.wd),
merged AS (SELECT l.site_id, l.timestamp_utc, l.grid_load_kwh,
                  l.grid_load_kwh + coalesce(s.pv_scaled_kwh, 0) AS consumption_kwh,
                  coalesce(s.pv_scaled_kwh, 0) AS pv_load_kwh
           FROM lp l LEFT JOIN scaled s ON l.site_id = s.site_id AND l.timestamp_utc = s.timestamp_utc)"""
