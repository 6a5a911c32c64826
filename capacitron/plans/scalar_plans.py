"""Scalar-function queries over names, JSON and
submissions that Spark derives from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nulls as N
from ..functions import scalars as S
from ..operators import inputs as I
from ..sources import tables as T
from .common import Model, rounded
from .model_sql import CLIENTS, CONFIGS, EVENTS_SERIES, GRP, RUNS, SUBMISSIONS, with_
from .registry import register

_FILES_SQL = with_(GRP, CONFIGS, RUNS) + """,
files AS (
  SELECT c.config_id, 'kpi_summary_' || strftime(r.run_date, '%Y%m%d_%H%M%S') || '_' || c.config_name || '.xlsx' AS file_name
  FROM configs c JOIN runs r ON c.run_id = r.run_id
  UNION ALL SELECT config_id, 'flex_timeseries_outputs_' || config_name || '.csv' FROM configs
  UNION ALL SELECT config_id, 'flex_timeseries_' || config_name || '.CSV' FROM configs
  UNION ALL SELECT config_id, config_name || '_notes.txt' FROM configs)
"""


def _files(m: Model):
    c, r = m.configs, m.runs.select("run_id", "run_date")
    stamped = c.join(r, "run_id").select(
        "config_id", F.concat(F.lit("kpi_summary_"), F.date_format("run_date", "yyyyMMdd_HHmmss"),
                              F.lit("_"), F.col("config_name"), F.lit(".xlsx")).alias("file_name"))
    parts = [stamped,
             c.select("config_id", F.concat(F.lit("flex_timeseries_outputs_"), "config_name", F.lit(".csv")).alias("file_name")),
             c.select("config_id", F.concat(F.lit("flex_timeseries_"), "config_name", F.lit(".CSV")).alias("file_name")),
             c.select("config_id", F.concat("config_name", F.lit("_notes.txt")).alias("file_name"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


register("sc_config_name", _FILES_SQL + r"""
SELECT config_id, file_name,
  CASE WHEN regexp_extract(regexp_replace(file_name, '\.[^.]*$', ''), '_\d{8}_\d{6}_(.+)$', 1) <> ''
       THEN regexp_extract(regexp_replace(file_name, '\.[^.]*$', ''), '_\d{8}_\d{6}_(.+)$', 1)
       WHEN starts_with(regexp_replace(file_name, '\.[^.]*$', ''), 'kpi_summary_')
       THEN substring(regexp_replace(file_name, '\.[^.]*$', ''), 13)
       WHEN starts_with(regexp_replace(file_name, '\.[^.]*$', ''), 'flex_timeseries_outputs_')
       THEN substring(regexp_replace(file_name, '\.[^.]*$', ''), 25)
       WHEN starts_with(regexp_replace(file_name, '\.[^.]*$', ''), 'flex_timeseries_')
       THEN substring(regexp_replace(file_name, '\.[^.]*$', ''), 17)
       ELSE regexp_replace(file_name, '\.[^.]*$', '') END AS config_name
FROM files""")(lambda spark, sf: _files(Model(spark, sf)).select(
    "config_id", "file_name", S.config_name_from_file("file_name").alias("config_name")))

register("sc_output_kind", _FILES_SQL + r"""
SELECT config_id, file_name,
  CASE WHEN contains(lower(file_name), 'kpi') AND regexp_extract(file_name, '\.([^.]+)$', 1) IN ('csv','xlsx','xls') THEN 'kpi'
       WHEN contains(lower(file_name), 'timeseries') AND regexp_extract(file_name, '\.([^.]+)$', 1) = 'csv' THEN 'timeseries'
       WHEN regexp_extract(file_name, '\.([^.]+)$', 1) IN ('csv','xlsx','xls') THEN 'other' END AS kind
FROM files""")(lambda spark, sf: _files(Model(spark, sf)).select(
    "config_id", "file_name", S.output_kind("file_name").alias("kind")))

register("sc_battery_specs", with_(GRP, CONFIGS) + r"""
SELECT config_id, config_name,
  CAST(nullif(regexp_extract(config_name, '(?i)(\d+(?:\.\d+)?)\s*kWh', 1), '') AS DOUBLE) AS capacity_kwh,
  CAST(nullif(regexp_extract(config_name, '(?i)(\d+(?:\.\d+)?)\s*kW(?:[^h]|$)', 1), '') AS DOUBLE) AS power_kw
FROM configs""")(lambda spark, sf: Model(spark, sf).configs.select(
    "config_id", "config_name", S.capacity_kwh("config_name").alias("capacity_kwh"),
    S.power_kw("config_name").alias("power_kw")))


def _names(m: Model):
    c = m.configs
    ln = (F.col("config_id") % 10)
    return (c.select("config_id", F.col("config_name").alias("name"))
            .unionByName(c.select("config_id", F.concat((ln - 1).cast("string"), F.lit("kWh")).alias("name")))
            .unionByName(c.select("config_id", F.concat((ln - 1).cast("string"), F.lit("0kWh")).alias("name")))
            .unionByName(c.select("config_id", F.upper(F.col("config_name")).alias("name"))))


register("sc_is_baseline", with_(GRP, CONFIGS) + """,
names AS (SELECT config_id, config_name AS name FROM configs
          UNION ALL SELECT config_id, CAST(config_id % 10 - 1 AS VARCHAR) || 'kWh' FROM configs
          UNION ALL SELECT config_id, CAST(config_id % 10 - 1 AS VARCHAR) || '0kWh' FROM configs
          UNION ALL SELECT config_id, upper(config_name) FROM configs)
SELECT config_id, name, lower(name) IN ('0kwh','0_kwh','no_battery','0_battery','baseline','no battery','0')
                        OR starts_with(lower(name), '0kwh') AS is_baseline
FROM names""")(lambda spark, sf: _names(Model(spark, sf)).select(
    "config_id", "name", S.is_baseline_name("name").alias("is_baseline")))

register("sc_sanitize_name", """
SELECT p_partkey, regexp_replace(p_name || ' #' || p_brand || '/' || p_type, '[^\\w\\-]', '_', 'g') AS safe_name
FROM part""")(lambda spark, sf: Model(spark, sf).read("part").select(
    "p_partkey", S.sanitize_name(F.concat_ws("", "p_name", F.lit(" #"), "p_brand", F.lit("/"), "p_type"))
    .alias("safe_name")))

_FOLDER = ("CASE c_mktsegment WHEN 'AUTOMOBILE' THEN c_name || ' (F)' WHEN 'BUILDING' THEN c_name || ' (Flex)' "
           "WHEN 'MACHINERY' THEN '  ' || c_name || ' - Batterie' WHEN 'HOUSEHOLD' THEN c_name || ' (F) (Flex)' "
           "ELSE c_name END")


def _folders(m: Model):
    c = m.read("customer")
    seg, n = F.col("c_mktsegment"), F.col("c_name")
    f = (F.when(seg == "AUTOMOBILE", F.concat(n, F.lit(" (F)")))
         .when(seg == "BUILDING", F.concat(n, F.lit(" (Flex)")))
         .when(seg == "MACHINERY", F.concat(F.lit("  "), n, F.lit(" - Batterie")))
         .when(seg == "HOUSEHOLD", F.concat(n, F.lit(" (F) (Flex)")))
         .otherwise(n))
    return c.select("c_custkey", f.alias("folder"))


register("sc_clean_client", f"""
WITH f AS (SELECT c_custkey, {_FOLDER} AS folder FROM customer),
a AS (SELECT c_custkey, folder, CASE WHEN ends_with(folder, ' (F)') THEN left(folder, length(folder) - 4) ELSE folder END AS s1 FROM f),
b AS (SELECT *, CASE WHEN ends_with(s1, ' (Flex)') THEN left(s1, length(s1) - 7) ELSE s1 END AS s2 FROM a),
c AS (SELECT *, CASE WHEN ends_with(s2, ' - Batterie') THEN left(s2, length(s2) - 11) ELSE s2 END AS s3 FROM b)
SELECT c_custkey, folder, trim(s3) AS client_name FROM c""")(lambda spark, sf: _folders(Model(spark, sf)).select(
    "c_custkey", "folder", S.clean_client("folder").alias("client_name")))

_SKIP_SQL = (f"""
WITH f AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '00_' || c_name WHEN c_acctbal > 9000 THEN '.' || c_name
                                  WHEN c_mktsegment = 'FURNITURE' THEN c_name || ' Archive' ELSE {_FOLDER} END AS folder
           FROM customer)
SELECT c_custkey, folder FROM f
WHERE NOT (starts_with(folder, '.') OR contains(folder, '00_') OR contains(folder, '01_Template')
  OR contains(folder, '02_Template') OR contains(folder, '03_') OR contains(folder, '04_') OR contains(folder, '05_')
  OR contains(folder, '06_') OR contains(folder, '07_') OR contains(folder, 'Archive') OR contains(folder, 'Cheatsheet')
  OR contains(folder, '.zip') OR contains(folder, '.xlsx') OR contains(folder, '.gsheet') OR contains(folder, '.gdoc')
  OR contains(folder, '.gslides') OR contains(folder, '.py') OR contains(folder, '.txt'))""")




def flt_skip_patterns(spark, sf):
    m = Model(spark, sf)
    c = m.read("customer")
    base = _folders(m).withColumnRenamed("folder", "f0")
    f = (c.join(base, "c_custkey").select(
        "c_custkey",
        F.when(F.col("c_acctbal") < 0, F.concat(F.lit("00_"), "c_name"))
         .when(F.col("c_acctbal") > 9000, F.concat(F.lit("."), "c_name"))
         .when(F.col("c_mktsegment") == "FURNITURE", F.concat("c_name", F.lit(" Archive")))
         .otherwise(F.col("f0")).alias("folder")))
    return f.filter(~S.skipped_folder("folder"))


register("flt_skip_patterns", _SKIP_SQL)(flt_skip_patterns)

_KN = ("CASE p_size % 4 WHEN 0 THEN ' Peak  Shaving ' WHEN 1 THEN 'Energy Optimization!' WHEN 2 THEN 'TRADING' "
       "ELSE p_name || ' / ' || p_type END")


@register("sc_clean_kpi_name", f"""
WITH n AS (SELECT p_partkey, {_KN} AS raw FROM part),
c AS (SELECT p_partkey, raw, regexp_replace(regexp_replace(lower(trim(raw)), '\\s+', '_', 'g'), '[^\\w_]', '', 'g') AS s FROM n)
SELECT p_partkey, raw, CASE s WHEN 'peak_shaving' THEN 'peak_shaving_benefit'
                              WHEN 'energy_optimization' THEN 'energy_procurement_optimization'
                              WHEN 'trading' THEN 'trading_revenue' ELSE s END AS kpi_name FROM c""")
def sc_clean_kpi_name(spark, sf):
    p = Model(spark, sf).read("part")
    sz = F.col("p_size") % 4
    raw = (F.when(sz == 0, F.lit(" Peak  Shaving ")).when(sz == 1, F.lit("Energy Optimization!"))
           .when(sz == 2, F.lit("TRADING")).otherwise(F.concat_ws(" / ", "p_name", "p_type")))
    return p.select("p_partkey", raw.alias("raw")).select(
        "p_partkey", "raw", S.clean_kpi_name("raw").alias("kpi_name"))


@register("sc_folder_date", r"""
WITH f AS (SELECT o_orderkey,
  CASE substring(o_orderpriority, 1, 1)
    WHEN '1' THEN 'Run ' || CAST(day(o_orderdate) AS VARCHAR) || '.' || CAST(month(o_orderdate) AS VARCHAR) || '.' || CAST(year(o_orderdate) AS VARCHAR)
    WHEN '2' THEN strftime(o_orderdate, '%Y-%m-%d') || ' rerun'
    WHEN '3' THEN 'v' || strftime(o_orderdate, '%Y%m%d')
    WHEN '4' THEN 'Run 32.13.' || CAST(year(o_orderdate) AS VARCHAR) || ' ' || strftime(o_orderdate, '%Y%m%d')
    ELSE 'Default run' END AS folder FROM orders),
m AS (SELECT o_orderkey, folder,
        regexp_extract(folder, '(\d{1,2})\.(\d{1,2})\.(\d{4})', ['d', 'm', 'y']) AS dmy,
        regexp_extract(folder, '(\d{4})-(\d{2})-(\d{2})', ['y', 'm', 'd']) AS iso,
        regexp_extract(folder, '(\d{8})', 1) AS compact FROM f)
SELECT o_orderkey, folder, coalesce(
  try_cast(printf('%04d-%02d-%02d', try_cast(dmy.y AS INT), try_cast(dmy.m AS INT), try_cast(dmy.d AS INT)) AS DATE),
  try_cast(printf('%04d-%02d-%02d', try_cast(iso.y AS INT), try_cast(iso.m AS INT), try_cast(iso.d AS INT)) AS DATE),
  try_strptime(nullif(compact, ''), '%Y%m%d')::DATE) AS run_date
FROM m""")
def sc_folder_date(spark, sf):
    o = Model(spark, sf).read("orders")
    d = F.col("o_orderdate")
    pr = F.substring("o_orderpriority", 1, 1)
    folder = (F.when(pr == "1", F.concat(F.lit("Run "), F.dayofmonth(d).cast("string"), F.lit("."),
                                         F.month(d).cast("string"), F.lit("."), F.year(d).cast("string")))
              .when(pr == "2", F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" rerun")))
              .when(pr == "3", F.concat(F.lit("v"), F.date_format(d, "yyyyMMdd")))
              .when(pr == "4", F.concat(F.lit("Run 32.13."), F.year(d).cast("string"), F.lit(" "),
                                        F.date_format(d, "yyyyMMdd")))
              .otherwise(F.lit("Default run")))
    return o.select("o_orderkey", folder.alias("folder")).select(
        "o_orderkey", "folder", S.folder_date("folder").alias("run_date"))


_ALIAS_SQL = (with_(GRP, CONFIGS) + """,
p AS (SELECT config_id,
  CASE config_id % 3 WHEN 0 THEN '{"battery_capacity": ' || CAST(battery_capacity_kwh AS VARCHAR) || ', "capacity": 1.0, "rte": '
                                  || CAST(battery_efficiency AS VARCHAR) || '}'
                     WHEN 1 THEN '{"battery_kwh": ' || CAST(battery_capacity_kwh AS VARCHAR) || ', "power_kw": '
                                  || CAST(battery_power_kw AS VARCHAR) || '}'
                     ELSE '{"power": ' || CAST(battery_power_kw AS VARCHAR) || ', "efficiency": '
                          || CAST(battery_efficiency AS VARCHAR) || '}' END AS params FROM configs)
SELECT config_id,
  round(coalesce(try_cast(json_extract_string(params, '$.battery_capacity') AS DOUBLE), try_cast(json_extract_string(params, '$.capacity_kwh') AS DOUBLE),
           try_cast(json_extract_string(params, '$.battery_kwh') AS DOUBLE), try_cast(json_extract_string(params, '$.capacity') AS DOUBLE)), 4) AS battery_capacity_kwh,
  round(coalesce(try_cast(json_extract_string(params, '$.battery_power') AS DOUBLE), try_cast(json_extract_string(params, '$.power_kw') AS DOUBLE),
           try_cast(json_extract_string(params, '$.battery_kw') AS DOUBLE), try_cast(json_extract_string(params, '$.power') AS DOUBLE)), 4) AS battery_power_kw,
  round(coalesce(try_cast(json_extract_string(params, '$.efficiency') AS DOUBLE), try_cast(json_extract_string(params, '$.round_trip_efficiency') AS DOUBLE),
           try_cast(json_extract_string(params, '$.rte') AS DOUBLE)), 4) AS battery_efficiency
FROM p""")


def sc_param_alias(spark, sf):
    c = Model(spark, sf).configs
    cap, pw, eff = (F.col(x).cast("string") for x in ("battery_capacity_kwh", "battery_power_kw", "battery_efficiency"))
    k = F.col("config_id") % 3
    params = (F.when(k == 0, F.concat(F.lit('{"battery_capacity": '), cap, F.lit(', "capacity": 1.0, "rte": '), eff, F.lit("}")))
              .when(k == 1, F.concat(F.lit('{"battery_kwh": '), cap, F.lit(', "power_kw": '), pw, F.lit("}")))
              .otherwise(F.concat(F.lit('{"power": '), pw, F.lit(', "efficiency": '), eff, F.lit("}"))))
    p = c.select("config_id", params.alias("params"))
    return rounded(p.select("config_id",
                            S.json_first("params", S.CAPACITY_ALIASES).alias("battery_capacity_kwh"),
                            S.json_first("params", S.POWER_ALIASES).alias("battery_power_kw"),
                            S.json_first("params", S.EFFICIENCY_ALIASES).alias("battery_efficiency")))


register("sc_param_alias", _ALIAS_SQL)(sc_param_alias)

_RAW = ("CASE p_size % 8 WHEN 0 THEN ' ' || CAST(p_size AS VARCHAR) || ' ' WHEN 1 THEN CAST(p_size AS VARCHAR) || 'e2' "
        "WHEN 2 THEN 'False' WHEN 3 THEN '[''none'']' WHEN 4 THEN '{}' WHEN 5 THEN CAST(p_size AS VARCHAR) || 'd' "
        "WHEN 6 THEN 'nan' ELSE '-' || CAST(p_size AS VARCHAR) || '.25' END")


def _raw_values(p):
    s = F.col("p_size")
    k = s % 8
    ss = s.cast("string")
    return (F.when(k == 0, F.concat(F.lit(" "), ss, F.lit(" "))).when(k == 1, F.concat(ss, F.lit("e2")))
            .when(k == 2, F.lit("False")).when(k == 3, F.lit("['none']")).when(k == 4, F.lit("{}"))
            .when(k == 5, F.concat(ss, F.lit("d"))).when(k == 6, F.lit("nan"))
            .otherwise(F.concat(F.lit("-"), ss, F.lit(".25"))))


register("sc_numeric_coerce", f"""
WITH r AS (SELECT p_partkey, {_RAW} AS raw FROM part)
SELECT p_partkey, raw,
  CASE WHEN regexp_matches(lower(trim(raw)), '^\\s*[+-]?((\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?|nan|inf|infinity)\\s*$')
            AND NOT isnan(try_cast(trim(raw) AS DOUBLE)) THEN try_cast(trim(raw) AS DOUBLE) END AS kpi_value
FROM r""")(lambda spark, sf: (lambda p: p.select("p_partkey", _raw_values(p).alias("raw")).select(
    "p_partkey", "raw", S.numeric_or_null("raw").alias("kpi_value")))(Model(spark, sf).read("part")))

register("sc_safe_float", f"""
WITH r AS (SELECT p_partkey, {_RAW} AS raw FROM part)
SELECT p_partkey, CASE WHEN isnan(try_cast(trim(raw) AS DOUBLE)) THEN NULL ELSE try_cast(trim(raw) AS DOUBLE) END AS value
FROM r""")(
    lambda spark, sf: (lambda p: p.select("p_partkey", S.numeric_or_null(_raw_values(p)).alias("value")))(
        Model(spark, sf).read("part")))

register("sc_nonneg_energy", """
SELECT event_id, CASE WHEN value - 30 < 0 THEN 0.0 ELSE round(value - 30, 4) END AS load_kwh FROM events""")(
    lambda spark, sf: rounded(Model(spark, sf).read("events").select(
        "event_id", S.nonneg(F.col("value") - 30).alias("load_kwh"))))

register("sc_file_paths", with_(GRP, CONFIGS) + """
SELECT config_id, 'run_' || CAST(run_id AS VARCHAR) || '/Output/kpi_summary_' || config_name || '.csv' AS kpi_file_path,
       CASE WHEN ln <> 5 THEN 'run_' || CAST(run_id AS VARCHAR) || '/Output/flex_timeseries_' || config_name || '.csv' END
         AS timeseries_file_path FROM configs""")(
    lambda spark, sf: Model(spark, sf).configs.select("config_id", "kpi_file_path", "timeseries_file_path"))

register("sc_calendar_parts", """
SELECT event_id, hour(ts) AS hour, isodow(ts) - 1 AS weekday, month(ts) AS month,
       (isodow(ts) - 1) * 96 + hour(ts) * 4 + CAST(floor(minute(ts) / 15) AS INT) AS slot FROM events""")(
    lambda spark, sf: Model(spark, sf).read("events").select(
        "event_id", F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday"), F.month("ts").alias("month"),
        S.slot_of("ts").alias("slot")))

register("sc_slot_label", """
WITH s AS (SELECT DISTINCT (isodow(ts) - 1) * 96 + hour(ts) * 4 + CAST(floor(minute(ts) / 15) AS INT) AS slot FROM events)
SELECT slot, ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][CAST(floor(slot / 96) AS INT) + 1] || ' '
       || lpad(CAST(CAST(floor((slot % 96) / 4) AS INT) AS VARCHAR), 2, '0') || ':'
       || lpad(CAST((slot % 4) * 15 AS VARCHAR), 2, '0') AS label FROM s""")(
    lambda spark, sf: Model(spark, sf).read("events").select(S.slot_of("ts").alias("slot")).distinct()
    .select("slot", S.slot_label("slot").alias("label")))

register("sc_json_metric", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events""")(
    lambda spark, sf: Model(spark, sf).read("events").select(
        "event_id", F.get_json_object("props", "$.k").cast("double").alias("k")))

register("sc_null_to_zero", with_(EVENTS_SERIES) + """
SELECT config_id, "timestamp", coalesce(generation_kwh, 0.0) AS generation_kwh FROM series""")(
    lambda spark, sf: Model(spark, sf).series.select("config_id", "timestamp",
                                                     N.finite_or_zero("generation_kwh").alias("generation_kwh")))

register("sc_input_normalise", with_(SUBMISSIONS) + """
SELECT submission_id,
  round(coalesce(pv_peak_power, CASE WHEN coalesce(pv_annual_total, 50) > 10 THEN coalesce(pv_annual_total, 50)
                                     ELSE coalesce(pv_annual_total, 50) / 1000.0 END), 6) AS pv_target_mwh,
  round(least(1.0, greatest(0.0, CASE WHEN pv_consumed_percentage > 1 THEN pv_consumed_percentage / 100
                                      ELSE pv_consumed_percentage END)), 6) AS pv_consumed_share
FROM subs""")(lambda spark, sf: rounded(I.normalise_pv(T.submissions(spark, sf)).select(
    "submission_id", "pv_target_mwh", "pv_consumed_share"), 6))

_UI_SQL = """
  CASE WHEN battery_capacity > 0 THEN round(battery_power / battery_capacity, 3) ELSE 0.0 END AS c_rate,
  CASE WHEN arbeitspreis IS NOT NULL AND arbeitspreis <> 0 THEN arbeitspreis / 100 + 0.03547 ELSE 0.041 END AS work_price,
  CASE WHEN leistungspreis IS NOT NULL AND leistungspreis <> 0 THEN leistungspreis ELSE 138.71 END AS power_price"""

register("sc_c_rate", with_(SUBMISSIONS) + f"""
SELECT submission_id, round(c_rate, 6) AS list_battery_proportion_hourly_max_load,
  round(pv_consumed_percentage / 100, 6) AS pv_consumed_decimal, round(work_price, 6) AS static_grid_fees,
  round(power_price, 6) AS grid_fee_max_load_peak
FROM (SELECT *, {_UI_SQL} FROM subs)""")(lambda spark, sf: rounded(I.ui_payload(T.submissions(spark, sf)).select(
    "submission_id", "list_battery_proportion_hourly_max_load", "pv_consumed_decimal", "static_grid_fees",
    "grid_fee_max_load_peak"), 6))

register("sc_battery_params", with_(SUBMISSIONS) + f"""
SELECT submission_id, round(battery_capacity / 0.92, 6) AS list_battery_max_state, CAST(0.92 AS DOUBLE) AS list_battery_efficiency,
  round(pv_peak_power * 1000, 6) AS pv_annual_total_kwh, round(work_price, 6) AS working_price_eur_per_kwh,
  round(battery_capacity * c_rate, 6) AS battery_power_kw,
  CAST(CAST(floor(battery_capacity) AS BIGINT) AS VARCHAR) || 'kWh' AS config_name
FROM (SELECT *, {_UI_SQL} FROM subs)""")(lambda spark, sf: rounded(I.battery_params(I.ui_payload(
    T.submissions(spark, sf))).select("submission_id", "list_battery_max_state", "list_battery_efficiency",
                                      "pv_annual_total_kwh", "working_price_eur_per_kwh", "battery_power_kw",
                                      "config_name"), 6))

_TJ = ("'{\"spezifischePreise\":[' || CASE WHEN arbeitspreis IS NOT NULL THEN '{\"typ\":\"ARBEITSPREIS_WIRKARBEIT\",\"wert\":\"' "
       "|| CAST(arbeitspreis AS VARCHAR) || '\"},' ELSE '' END || '{\"typ\":\"LEISTUNGSPREIS_WIRKLEISTUNG\",\"wert\":\"' "
       "|| CAST(leistungspreis AS VARCHAR) || '\"}]}'")


@register("sc_tariff_json", with_(SUBMISSIONS) + f"""
SELECT submission_id, coalesce(try_cast(list_filter(p, lambda x: x.typ = 'ARBEITSPREIS_WIRKARBEIT')[1].wert AS DOUBLE), 0.0) AS arbeitspreis,
       coalesce(try_cast(list_filter(p, lambda x: x.typ = 'LEISTUNGSPREIS_WIRKLEISTUNG')[1].wert AS DOUBLE), 0.0) AS leistungspreis
FROM (SELECT submission_id, from_json({_TJ}, '{{"spezifischePreise":[{{"typ":"VARCHAR","wert":"VARCHAR"}}]}}').spezifischePreise AS p
      FROM subs)""")
def sc_tariff_json(spark, sf):
    s = T.submissions(spark, sf)
    ap = F.when(F.col("arbeitspreis").isNotNull(),
                F.concat(F.lit('{"typ":"ARBEITSPREIS_WIRKARBEIT","wert":"'), F.col("arbeitspreis").cast("string"),
                         F.lit('"},'))).otherwise(F.lit(""))
    doc = F.concat(F.lit('{"spezifischePreise":['), ap, F.lit('{"typ":"LEISTUNGSPREIS_WIRKLEISTUNG","wert":"'),
                   F.col("leistungspreis").cast("string"), F.lit('"}]}'))
    return s.select("submission_id", doc.alias("doc")).select("submission_id", *I.tariff_prices("doc"))


register("sc_direct_inputs", with_(SUBMISSIONS) + """
SELECT submission_id, round(battery_capacity / 0.92, 4) AS list_battery_max_state, CAST(0.92 AS DOUBLE) AS list_battery_usability,
  round(battery_capacity, 4) AS list_battery_usable_max_state, CAST(0.92 AS DOUBLE) AS list_battery_efficiency,
  list_battery_num_annual_cycles, round(CASE WHEN battery_capacity > 0 THEN round(battery_power / battery_capacity, 3) ELSE 0.0 END, 4)
    AS list_battery_proportion_hourly_max_load,
  round(pv_peak_power * 1000, 4) AS pv_annual_total, round(pv_consumed_percentage / 100, 4) AS pv_consumed_percentage
FROM subs""")(lambda spark, sf: rounded((lambda d: d.select(
    "submission_id", "list_battery_max_state", "list_battery_usability", "list_battery_usable_max_state",
    "list_battery_efficiency", "list_battery_num_annual_cycles", "list_battery_proportion_hourly_max_load",
    F.col("pv_annual_total_kwh").alias("pv_annual_total"),
    F.col("pv_consumed_decimal").alias("pv_consumed_percentage")))(
    I.battery_params(I.ui_payload(T.submissions(spark, sf))))))
