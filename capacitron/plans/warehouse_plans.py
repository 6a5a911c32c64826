"""Warehouse queries: joins, aggregates, filters, set operations, top-k, windows
(SURVEY §2.3, 2.4, 2.5, 2.7, 2.8, 2.9)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import benefits as B
from ..operators import warehouse as W
from ..operators.lookup import prefix_lookup
from ..operators.segments import differences
from ..operators.snapshots import SnapshotTable
from ..session import scratch_path
from .common import Model, rounded
from .model_sql import CLIENTS, CONFIGS, GRP, KPIS, RUNS, with_
from .registry import register

FULL = with_(GRP, CONFIGS, KPIS, CLIENTS, RUNS)


@register("jn_runs_clients", with_(CLIENTS, RUNS) + """
SELECT r.run_id, c.client_name, r.run_name, r.run_date FROM runs r JOIN clients c ON r.client_id = c.client_id""")
def jn_runs_clients(spark, sf):
    m = Model(spark, sf)
    return (m.runs.join(m.clients, "client_id")
            .select("run_id", "client_name", "run_name", "run_date")
            .orderBy(F.col("client_name").asc_nulls_last(), F.col("run_date").desc_nulls_last()))


@register("ord_hierarchy", FULL + """
SELECT c.config_id, cl.client_name, r.run_name, c.config_name, round(c.battery_capacity_kwh, 4) AS battery_capacity_kwh
FROM configs c JOIN runs r ON c.run_id = r.run_id JOIN clients cl ON r.client_id = cl.client_id""")
def ord_hierarchy(spark, sf):
    """Configurations ordered by client, run, capacity (NULLs last, as in DuckDB)."""
    m = Model(spark, sf)
    f = W.configs_full(m.configs, m.runs, m.clients)
    return rounded(f.select("config_id", "client_name", "run_name", "config_name", "battery_capacity_kwh")
                   .orderBy(F.col("client_name").asc_nulls_last(), F.col("run_name").asc_nulls_last(),
                            F.col("battery_capacity_kwh").asc_nulls_last()))


@register("jn_configs_full", FULL + """
SELECT c.config_id, cl.client_name, r.run_name, c.config_name, c.is_baseline,
       round(c.battery_capacity_kwh, 4) AS battery_capacity_kwh, round(c.battery_power_kw, 4) AS battery_power_kw
FROM configs c JOIN runs r ON c.run_id = r.run_id JOIN clients cl ON r.client_id = cl.client_id""")
def jn_configs_full(spark, sf):
    m = Model(spark, sf)
    return rounded(W.configs_full(m.configs, m.runs, m.clients).select(
        "config_id", "client_name", "run_name", "config_name", "is_baseline", "battery_capacity_kwh",
        "battery_power_kw"))


@register("jn_kpis_full", FULL + """
SELECT k.kpi_id, cl.client_name, r.run_name, c.config_name, k.kpi_name, round(k.kpi_value, 4) AS kpi_value, k.kpi_unit
FROM kpis k JOIN configs c ON k.config_id = c.config_id JOIN runs r ON c.run_id = r.run_id
JOIN clients cl ON r.client_id = cl.client_id""")
def jn_kpis_full(spark, sf):
    m = Model(spark, sf)
    return rounded(W.kpis_full(m.kpis, m.configs, m.runs, m.clients).select(
        "kpi_id", "client_name", "run_name", "config_name", "kpi_name", "kpi_value", "kpi_unit"))


@register("flt_hierarchy", FULL + """
SELECT k.kpi_id, cl.client_name, r.run_name, c.config_name, round(k.kpi_value, 4) AS kpi_value
FROM kpis k JOIN configs c ON k.config_id = c.config_id JOIN runs r ON c.run_id = r.run_id
JOIN clients cl ON r.client_id = cl.client_id
WHERE k.kpi_name = 'annual_total_energy_trade_cost_da' AND c.config_name = 'no_battery'""")
def flt_hierarchy(spark, sf):
    """Optional equality filters (client / run / config / kpi), ANDed; unset ones skipped."""
    m = Model(spark, sf)
    f = W.kpis_full(m.kpis, m.configs, m.runs, m.clients)
    f = W.filter_eq(f, client_name=None, run_name=None, config_name="no_battery",
                    kpi_name="annual_total_energy_trade_cost_da")
    return rounded(f.select("kpi_id", "client_name", "run_name", "config_name", "kpi_value"))


@register("jn_compare_configs", FULL + """
SELECT r.run_name, c.config_name, round(c.battery_capacity_kwh, 4) AS battery_capacity_kwh,
       round(c.battery_power_kw, 4) AS battery_power_kw, k.kpi_name, round(k.kpi_value, 4) AS kpi_value
FROM kpis k JOIN configs c ON k.config_id = c.config_id JOIN runs r ON c.run_id = r.run_id
WHERE k.kpi_name = 'annual_total_grid_fee_cost_ic'""")
def jn_compare_configs(spark, sf):
    """Configurations of each run side by side for one KPI, ordered by kpi, capacity."""
    m = Model(spark, sf)
    k = m.kpis.filter(F.col("kpi_name") == "annual_total_grid_fee_cost_ic")
    j = (k.join(m.configs, "config_id").join(m.runs.select("run_id", "run_name"), "run_id")
         .select("run_name", "config_name", "battery_capacity_kwh", "battery_power_kw", "kpi_name",
                 "kpi_value")
         .orderBy("run_name", "kpi_name", F.col("battery_capacity_kwh").asc_nulls_last()))
    return rounded(j)


@register("jn_target_left", FULL + """
SELECT c.config_id, cl.client_name, r.run_name, c.config_name, round(c.battery_capacity_kwh, 4) AS battery_capacity_kwh,
       round(k.kpi_value, 4) AS target
FROM configs c JOIN runs r ON c.run_id = r.run_id JOIN clients cl ON r.client_id = cl.client_id
LEFT JOIN kpis k ON k.config_id = c.config_id AND k.kpi_name = 'annual_total_energy_trade_cost_ic'
WHERE NOT c.is_baseline""")
def jn_target_left(spark, sf):
    """Every non-baseline configuration with its target KPI or NULL (KPI filter before the
    left join, i.e. inside ON)."""
    m = Model(spark, sf)
    tgt = (m.kpis.filter(F.col("kpi_name") == "annual_total_energy_trade_cost_ic")
           .select("config_id", F.col("kpi_value").alias("target")))
    cfg = W.configs_full(m.configs.filter(~F.col("is_baseline")), m.runs, m.clients)
    return rounded(cfg.join(tgt, "config_id", "left").select(
        "config_id", "client_name", "run_name", "config_name", "battery_capacity_kwh", "target"))


@register("jn_hierarchy_left", FULL + """
SELECT cl.client_name, r.run_name, c.config_id
FROM clients cl LEFT JOIN runs r ON r.client_id = cl.client_id LEFT JOIN configs c ON c.run_id = r.run_id""")
def jn_hierarchy_left(spark, sf):
    m = Model(spark, sf)
    return (m.clients.select("client_id", "client_name")
            .join(m.runs.select("run_id", "client_id", "run_name"), "client_id", "left")
            .join(m.configs.select("config_id", "run_id"), "run_id", "left")
            .select("client_name", "run_name", "config_id"))


@register("agg_hierarchy_counts", FULL + """
SELECT cl.client_name, r.run_name, count(c.config_id) AS n_configs
FROM clients cl LEFT JOIN runs r ON r.client_id = cl.client_id LEFT JOIN configs c ON c.run_id = r.run_id
GROUP BY cl.client_id, cl.client_name, r.run_id, r.run_name""")
def agg_hierarchy_counts(spark, sf):
    """Configurations per client and run, zeros kept (runs pre-aggregated before the joins)."""
    m = Model(spark, sf)
    return W.hierarchy_counts(m.clients, m.runs, m.configs)


@register("jn_key_lookup", FULL + """
SELECT q.client_name, q.run_name, r.run_id, cl.client_id
FROM (SELECT DISTINCT c_name AS client_name, 'Run_' || CAST(o_orderkey AS VARCHAR) AS run_name
      FROM orders JOIN customer ON o_custkey = c_custkey) q
JOIN clients cl ON cl.client_name = q.client_name
JOIN runs r ON r.run_name = q.run_name AND r.client_id = cl.client_id""")
def jn_key_lookup(spark, sf):
    """Batch name -> id resolution: one equi-join instead of a query per name."""
    m = Model(spark, sf)
    o, c = m.read("orders"), m.read("customer")
    q = (o.join(c, o.o_custkey == c.c_custkey)
         .select(F.col("c_name").alias("client_name"),
                 F.concat(F.lit("Run_"), F.col("o_orderkey").cast("string")).alias("run_name")).distinct())
    cl = m.clients.select("client_id", "client_name")
    return (q.join(cl, "client_name")
            .join(m.runs.select("run_id", "run_name", "client_id"), ["run_name", "client_id"])
            .select("client_name", "run_name", "run_id", "client_id"))


@register("jn_skip_processed", with_(GRP, CONFIGS) + """
SELECT c.config_id FROM configs c
WHERE NOT c.is_baseline AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = c.run_id AND o.o_orderstatus = 'F')""")
def jn_skip_processed(spark, sf):
    """Configurations still to process: anti join against the processed-id set (here the
    configurations of finished orders)."""
    m = Model(spark, sf)
    done = (m.read("orders").filter(F.col("o_orderstatus") == "F")
            .select(F.col("o_orderkey").alias("run_id")))
    return (m.configs.filter(~F.col("is_baseline")).join(done, "run_id", "left_anti")
            .select("config_id"))


@register("agg_config_count", with_(GRP, CONFIGS) + """
SELECT count(*) AS n_total,
       count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = c.run_id
                                          AND o.o_orderstatus = 'F')) AS n_to_process
FROM configs c WHERE NOT c.is_baseline""")
def agg_config_count(spark, sf):
    m = Model(spark, sf)
    done = (m.read("orders").filter(F.col("o_orderstatus") == "F")
            .select(F.col("o_orderkey").alias("run_id"), F.lit(True).alias("done")))
    c = m.configs.filter(~F.col("is_baseline")).join(done, "run_id", "left")
    return c.agg(F.count("*").alias("n_total"),
                 F.count_if(F.col("done").isNull()).alias("n_to_process"))


@register("jn_file_pairs", with_(GRP, CONFIGS) + """,
files AS (
  SELECT run_id, config_name, 'kpi' AS kind, 'run_' || CAST(run_id AS VARCHAR) || '/Output/kpi_summary_' || config_name || '.csv' AS path FROM configs
  UNION ALL
  SELECT run_id, config_name, 'timeseries', 'run_' || CAST(run_id AS VARCHAR) || '/Output/flex_timeseries_' || config_name || '.csv'
  FROM configs WHERE ln <> 5)
SELECT run_id, config_name, max(CASE WHEN kind = 'kpi' THEN path END) AS kpi_file,
       max(CASE WHEN kind = 'timeseries' THEN path END) AS timeseries_file
FROM files GROUP BY run_id, config_name""")
def jn_file_pairs(spark, sf):
    """Pair KPI and series files per configuration (either may be missing) with a
    conditional aggregate — deterministic, no full outer join."""
    c = Model(spark, sf).configs
    files = (c.select("run_id", "config_name", F.lit("kpi").alias("kind"), F.col("kpi_file_path").alias("path"))
             .unionByName(c.filter(F.col("timeseries_file_path").isNotNull())
                          .select("run_id", "config_name", F.lit("timeseries").alias("kind"),
                                  F.col("timeseries_file_path").alias("path"))))
    return files.groupBy("run_id", "config_name").agg(
        F.max(F.when(F.col("kind") == "kpi", F.col("path"))).alias("kpi_file"),
        F.max(F.when(F.col("kind") == "timeseries", F.col("path"))).alias("timeseries_file"))


@register("jn_prefix_lookup", """
WITH q AS (SELECT DISTINCT substring(p_brand, 1, 7) AS prefix FROM part),
hits AS (SELECT q.prefix, p.p_partkey, p.p_brand, p.p_name,
                row_number() OVER (PARTITION BY q.prefix ORDER BY p.p_partkey) AS rn
         FROM q JOIN part p ON starts_with(p.p_brand, q.prefix))
SELECT prefix, p_brand, p_name FROM hits WHERE rn = 1""")
def jn_prefix_lookup(spark, sf):
    """First register row (by key order) whose code starts with each query prefix."""
    p = Model(spark, sf).read("part")
    q = p.select(F.substring("p_brand", 1, 7).alias("prefix"))
    return prefix_lookup(q, "prefix", p, "p_brand", "p_partkey", ["p_brand", "p_name"])


@register("agg_table_counts", FULL + """
SELECT 'clients' AS table_name, count(*) AS n_rows FROM clients
UNION ALL SELECT 'runs', count(*) FROM runs
UNION ALL SELECT 'battery_configs', count(*) FROM configs
UNION ALL SELECT 'kpi_summary', count(*) FROM kpis""")
def agg_table_counts(spark, sf):
    m = Model(spark, sf)
    parts = [m.clients.agg(F.count("*").alias("n_rows")).select(F.lit("clients").alias("table_name"), "n_rows"),
             m.runs.agg(F.count("*").alias("n_rows")).select(F.lit("runs").alias("table_name"), "n_rows"),
             m.configs.agg(F.count("*").alias("n_rows")).select(F.lit("battery_configs").alias("table_name"), "n_rows"),
             m.kpis.agg(F.count("*").alias("n_rows")).select(F.lit("kpi_summary").alias("table_name"), "n_rows")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("agg_kpi_catalogue", with_(GRP, KPIS) + """
SELECT kpi_name, count(DISTINCT config_id) AS n_configs, round(avg(kpi_value), 4) AS avg_value,
       round(min(kpi_value), 4) AS min_value, round(max(kpi_value), 4) AS max_value
FROM kpis GROUP BY kpi_name""")
def agg_kpi_catalogue(spark, sf):
    return rounded(W.kpi_catalogue(Model(spark, sf).kpis))


@register("agg_distinct_names", with_(GRP, KPIS, CLIENTS) + """
SELECT DISTINCT 'kpi' AS kind, kpi_name AS name FROM kpis
UNION SELECT DISTINCT 'client', client_name FROM clients""")
def agg_distinct_names(spark, sf):
    m = Model(spark, sf)
    k = m.kpis.select(F.lit("kpi").alias("kind"), F.col("kpi_name").alias("name")).distinct()
    c = m.clients.select(F.lit("client").alias("kind"), F.col("client_name").alias("name")).distinct()
    return k.unionByName(c).orderBy("kind", "name")


@register("agg_file_types", with_(GRP, CONFIGS) + """,
files AS (SELECT 'run_' || CAST(run_id AS VARCHAR) || '/Output/kpi_summary_' || config_name || '.csv' AS path FROM configs
          UNION ALL SELECT 'run_' || CAST(run_id AS VARCHAR) || '/Output/flex_timeseries_' || config_name || '.csv'
          FROM configs WHERE ln <> 5)
SELECT CASE WHEN position('_' IN regexp_extract(path, '/Output/([a-z]+)_', 1)) > 0 THEN ''
            ELSE regexp_extract(path, '/Output/([a-z]+)_', 1) END || '.' || regexp_extract(path, '\\.([^.]+)$', 1) AS file_type,
       count(*) AS n_files
FROM files GROUP BY 1 ORDER BY n_files DESC, file_type LIMIT 10""")
def agg_file_types(spark, sf):
    """Files per kind/extension, top 10 (a limit that is the feature)."""
    c = Model(spark, sf).configs
    paths = (c.select(F.col("kpi_file_path").alias("path"))
             .unionByName(c.filter(F.col("timeseries_file_path").isNotNull())
                          .select(F.col("timeseries_file_path").alias("path"))))
    stem = F.regexp_extract("path", r"/Output/([a-z]+)_", 1)
    ft = F.concat(stem, F.lit("."), F.regexp_extract("path", r"\.([^.]+)$", 1))
    return (paths.groupBy(ft.alias("file_type")).agg(F.count("*").alias("n_files"))
            .orderBy(F.col("n_files").desc(), "file_type").limit(10))


@register("flt_exclude_baseline", with_(GRP, CONFIGS) + """
SELECT config_id, config_name FROM configs WHERE NOT is_baseline""")
def flt_exclude_baseline(spark, sf):
    return Model(spark, sf).configs.filter(~F.col("is_baseline")).select("config_id", "config_name")


@register("flt_known_target", with_(GRP, KPIS) + """
SELECT kpi_name AS target, count(kpi_value) AS n_known FROM kpis GROUP BY kpi_name HAVING count(kpi_value) >= 5""")
def flt_known_target(spark, sf):
    """Targets with at least 5 known values are trainable (fewer than 10 raises at fit time)."""
    k = Model(spark, sf).kpis
    return (k.groupBy(F.col("kpi_name").alias("target")).agg(F.count("kpi_value").alias("n_known"))
            .filter(F.col("n_known") >= 5))


@register("flt_valid_series", """
SELECT user_id AS config_id, count(*) AS n_rows, count(*) >= 100 AS is_valid FROM events GROUP BY user_id""")
def flt_valid_series(spark, sf):
    """Series validity: at least 100 rows and a time column (checked on the schema)."""
    s = Model(spark, sf).series
    has_time = any(("time" in c.lower() or "date" in c.lower()) for c in s.columns)
    return (s.groupBy("config_id").agg(F.count("*").alias("n_rows"))
            .withColumn("is_valid", (F.col("n_rows") >= 100) & F.lit(has_time)))


@register("flt_valid_kpi_file", with_(GRP, KPIS) + """
SELECT config_id, count(*) AS n_rows, count(*) > 0 AS is_valid FROM kpis GROUP BY config_id""")
# (the two-column requirement holds for the stored KPI layout, checked on the schema)
def flt_valid_kpi_file(spark, sf):
    """KPI sheet validity: non-empty and at least 2 columns."""
    k = Model(spark, sf).kpis.select("config_id", "kpi_name", "kpi_value")
    n_cols = len(k.columns) - 1
    return (k.groupBy("config_id").agg(F.count("*").alias("n_rows"))
            .withColumn("is_valid", (F.col("n_rows") > 0) & F.lit(n_cols >= 2)))


@register("set_upsert_kpi", with_(GRP, KPIS) + """
SELECT config_id, kpi_name, round(kpi_value, 6) AS kpi_value FROM kpis
WHERE kpi_name <> 'annual_total_energy_trade_cost_ia'
UNION ALL
SELECT config_id, kpi_name, round(kpi_value * 1.19, 6) FROM kpis WHERE kpi_name = 'annual_total_energy_trade_cost_ia'""")
def set_upsert_kpi(spark, sf):
    """INSERT ... ON CONFLICT (config_id, kpi_name) DO UPDATE as a merge into a stored table, read
    back after it was made whole again."""
    k = Model(spark, sf).kpis.select("config_id", "kpi_name", "kpi_value")
    new = (k.filter(F.col("kpi_name") == "annual_total_energy_trade_cost_ia")
           .withColumn("kpi_value", F.col("kpi_value") * 1.19))
    store = SnapshotTable(spark, scratch_path(spark, f"kpi-store-{uuid.uuid4().hex}"), ["config_id", "kpi_name"])
    store.merge(k)
    store.merge(new)
    store.compact()
    return rounded(store.read(), 6)


@register("set_insert_ignore", """
SELECT c_custkey AS client_id, c_name AS client_name FROM customer""")
def set_insert_ignore(spark, sf):
    """Insert clients named in the orders feed unless their key already exists."""
    m = Model(spark, sf)
    store = m.clients.filter(F.col("description") != "BUILDING").select("client_id", "client_name")
    feed = (m.read("orders").join(m.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .select(F.col("c_custkey").alias("client_id"), F.col("c_name").alias("client_name")))
    ext = m.clients.filter(F.col("description") == "BUILDING").select("client_id", "client_name")
    return W.insert_ignore(store, feed.unionByName(ext), ["client_id"])


@register("set_kpi_coverage", with_(GRP, KPIS) + """,
req AS (SELECT * FROM (VALUES ('annual_total_grid_fee_cost_ic'), ('annual_total_energy_trade_cost_da'),
        ('annual_total_energy_trade_cost_ia'), ('annual_total_energy_trade_cost_ic'),
        ('peak_shaving_benefit'), ('energy_procurement_optimization'), ('trading_revenue')) t(name)),
av AS (SELECT DISTINCT kpi_name AS name FROM kpis)
SELECT name, 'available' AS status FROM (SELECT name FROM req INTERSECT SELECT name FROM av)
UNION ALL SELECT name, 'missing' FROM (SELECT name FROM req EXCEPT SELECT name FROM av)
UNION ALL SELECT name, 'unused_in_db' FROM (SELECT name FROM av EXCEPT SELECT name FROM req)""")
def set_kpi_coverage(spark, sf):
    """Required (benefit inputs + targets) vs available KPI names."""
    m = Model(spark, sf)
    book = B.BenefitBook()
    req = spark.createDataFrame([(n,) for n in book.kpis + book.names], "kpi_name string")
    return W.key_coverage(req, m.kpis, "kpi_name")


@register("win_latest_or_first", with_(CLIENTS, RUNS) + """
SELECT client_id, run_id AS latest_run_id FROM (
  SELECT client_id, run_id, row_number() OVER (PARTITION BY client_id ORDER BY run_date DESC, run_id DESC) AS rn
  FROM runs) WHERE rn = 1""")
def win_latest_or_first(spark, sf):
    """First row by priority per group — the latest run per client — as ``max_by``
    (partial aggregation) instead of a window over each client's rows."""
    r = Model(spark, sf).runs
    return (r.groupBy("client_id")
            .agg(F.max_by("run_id", F.struct("run_date", "run_id")).alias("latest_run_id")))


@register("win_last_write_wins", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity, 4) AS l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                               ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS rn
  FROM lineitem) WHERE rn = 1""")
def win_last_write_wins(spark, sf):
    """Duplicate (l_orderkey, l_linenumber) keys: keep the last write by sequence."""
    li = Model(spark, sf).read("lineitem")
    seq = F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity")
    d = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                  seq.alias("seq"))
    return rounded(W.last_write_wins(d, ["l_orderkey", "l_linenumber"], "seq").drop("seq"))


@register("win_diff", """
SELECT user_id AS config_id, ts AS "timestamp",
       round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts), 4) AS load_diff FROM events""")
def win_diff(spark, sf):
    """Row differences; a long series is cut into time segments that overlap by a row."""
    s = Model(spark, sf).series.select("config_id", "timestamp", "load_kwh")
    return rounded(differences(s, "load_kwh", "load_diff").drop("load_kwh"))
