"""Plan-shape assertions, file-tree ingest, sinks and the incremental
streaming job on small inputs."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL

import __spark_entry__ as E
from capacitron.operators import series as SER
from capacitron.sources import tables as T
from capacitron.sources import tree as TR
from capacitron.sources.files import write_text_files
from capacitron.streaming import incremental as INC

Q = E.queries()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["bn_all", "ts_percentiles", "ft_matrix", "pv_merge", "agg_average_week",
                                  "jn_prefix_lookup", "ml_cv_summary"])
def test_no_python_udf_in_hot_queries(spark, name):
    p = plan_of(Q[name](spark, SF_SMALL))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_benefits_plan_uses_hash_aggregates_only(spark):
    p = plan_of(Q["bn_all"](spark, SF_SMALL))
    assert "SortAggregate" not in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_series_features_single_exchange(spark):
    """In-aggregate mode: the lag window and the feature aggregate share one exchange."""
    s = T.series_events(spark, SF_SMALL)
    df = SER.extract(s, SER.SIMULATION_COLUMN_SPECS, SER.DF_FEATURE_NAMES, percentiles="in_aggregate",
                     diffs="window")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert p.count("Exchange hashpartitioning") == 1, p


def test_series_percentiles_never_buffer_a_heavy_group(spark, monkeypatch):
    """Heavy keys: no percentile buffer in the plan that takes them; the aggregate with one is
    behind an anti join that leaves them out."""
    s = T.series_events(spark, SF_SMALL)
    args = (SER.SIMULATION_COLUMN_SPECS, SER.DF_FEATURE_NAMES, "config_id", None, "", False)
    heavy = SER._extract(s, *args, "distributed", "distributed")._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in heavy and "percentile_approx(" in heavy
    monkeypatch.setattr(SER, "HEAVY", 20)
    both = SER.extract(s, SER.SIMULATION_COLUMN_SPECS, SER.DF_FEATURE_NAMES)
    logical = both._jdf.queryExecution().optimizedPlan().toString()
    light = logical.split("percentile(load_kwh", 1)[1]
    assert "LeftAnti" in light


def test_scan_prunes_columns_and_pushes_filters(spark):
    p = plan_of(Q["jn_compare_configs"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(kpi_name), EqualTo(kpi_name,annual_total_grid_fee_cost_ic)" in p
    assert "ReadSchema: struct<config_id:bigint,kpi_name:string,kpi_value:double>" in p


def test_prefix_lookup_is_an_equi_join(spark):
    p = plan_of(Q["jn_prefix_lookup"](spark, SF_SMALL))
    assert "NestedLoop" not in p and "Cartesian" not in p


@pytest.fixture(scope="module")
def small_tree(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tree"))
    rows = []

    def add(path, lines):
        rows.extend((path, i, l) for i, l in enumerate(lines))
    add("Acme GmbH/Run 1 5.9.2025/Input/parameters.json", ['{"battery_capacity": 100, "rte": 0.9}'])
    add("Acme GmbH/Run 1 5.9.2025/Output/kpi_summary_20250905_114337_0kWh.csv",
        ["kpi_name,kpi_value,kpi_unit", "annual_total_grid_fee_cost_ic,1000,EUR", "flag,False,", "x,5d,"])
    add("Acme GmbH/Run 1 5.9.2025/Output/kpi_summary_100kWh_50kW.csv",
        ["Name,Value", "annual_total_grid_fee_cost_ic,800", "annual_total_grid_fee_cost_ic,750"])
    add("Acme GmbH/Run 1 5.9.2025/Output/flex_timeseries_outputs_100kWh_50kW.csv",
        ["timestamp,load_kwh,generation_kwh,soc_percent,power_kw,grid_import_kwh,grid_export_kwh",
         "2024-01-01 00:00:00,1.5,0,50,2,1,0", "2024-01-01 00:15:00,2.5,,60,-1,2,0"])
    add("Beta (F)/02_Flex Offer Files/Run A/Output/kpi_summary_no_battery.csv", ["kpi_name,kpi_value", "k,1"])
    add("Beta (F)/02_Flex Offer Files/Run B/Input/load_config_1.yml",
        ["grid_parameters:", "  static_grid_fees: [0.1, 0.2]", "microgrid:", "  pv:", "    - annual_kwh: 5"])
    add("00_Template (F)/02_Flex Offer Files/Run C/Output/kpi_summary_x.csv", ["kpi_name,kpi_value", "k,1"])
    add(".hidden/Run/Output/kpi_summary_y.csv", ["kpi_name,kpi_value", "k,1"])
    write_text_files(spark.createDataFrame(rows, "path string, seq long, line string"), root)
    return root


def test_tree_walkers(spark, small_tree):
    flat = {(r.client_name, r.config_name, r.kind) for r in TR.result_tree(spark, small_tree).collect()}
    assert flat == {("Acme GmbH", "0kWh", "kpi"), ("Acme GmbH", "100kWh_50kW", "kpi"),
                    ("Acme GmbH", "100kWh_50kW", "timeseries")}
    nested = {(r.client_name, r.run_name) for r in TR.nested_tree(spark, small_tree).collect()}
    assert nested == {("Beta", "Run A")}          # skip pattern + run without outputs dropped
    counts = {r.run_name: (r.n_kpi, r.n_timeseries) for r in TR.case_counts(spark, small_tree).collect()}
    assert counts["Run 1 5.9.2025"] == (2, 1)


def test_kpi_sheets_header_variants_and_last_write(spark, small_tree):
    got = {(r.config_name, r.kpi_name): r.kpi_value for r in TR.kpi_sheets(spark, small_tree).collect()}
    assert got[("0kWh", "annual_total_grid_fee_cost_ic")] == 1000.0
    assert got[("100kWh_50kW", "annual_total_grid_fee_cost_ic")] == 750.0   # last row wins
    assert ("0kWh", "flag") not in got and ("0kWh", "x") not in got


def test_series_and_params(spark, small_tree):
    ts = TR.timeseries(spark, small_tree).collect()
    assert len(ts) == 2 and ts[0].config_name == "100kWh_50kW"
    docs = {r.run_name: r.source_file for r in TR.params_documents(spark, small_tree).collect()}
    assert docs == {"Run 1 5.9.2025": "parameters.json", "Run B": "load_config_1.yml"}
    flat = {(r.run_name, r.key_path): r.value for r in TR.flatten_documents(TR.params_documents(spark, small_tree)).collect()}
    assert flat[("Run B", "grid_parameters.static_grid_fees[1]")] == "0.2"
    assert flat[("Run 1 5.9.2025", "rte")] == "0.9"


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_nested_clients_keep_their_own_runs(spark, tmp_path, scheme):
    root, rows = f"{tmp_path}/tree", []
    for client, v in (("Beta (F)", 1), ("Gamma (F)", 2)):
        base = f"{client}/02_Flex Offer Files/Run 1"
        rows += [(f"{base}/Input/parameters.json", 0, f'{{"v": {v}}}'),
                 (f"{base}/Output/kpi_summary_a.csv", 0, "kpi_name,kpi_value"), (f"{base}/Output/kpi_summary_a.csv", 1, f"k,{v}"),
                 (f"{base}/Output/flex_timeseries_outputs_a.csv", 0, TR.SERIES_HEADER),
                 (f"{base}/Output/flex_timeseries_outputs_a.csv", 1, f"2024-01-01 00:00:00,{v},0,0,0,0,0")]
    rows.append(("Acme/Run 1/Input/parameters.json", 0, '{"v": 3}'))
    write_text_files(spark.createDataFrame(rows, "path string, seq long, line string"), root)
    root = scheme + root
    docs = TR.params_documents(spark, root)
    assert sorted((r.client_name, r.run_name) for r in docs.collect()) == [
        ("Acme", "Run 1"), ("Beta (F)", "Run 1"), ("Gamma (F)", "Run 1")]
    assert sorted((r.client_name, r.value) for r in TR.flatten_documents(docs).collect()) == [
        ("Acme", "3"), ("Beta (F)", "1"), ("Gamma (F)", "2")]
    both = [("Beta (F)", "Run 1", 1.0), ("Gamma (F)", "Run 1", 2.0)]
    assert sorted((r.client_name, r.run_name, r.kpi_value) for r in TR.kpi_sheets(spark, root).collect()) == both
    assert sorted((r.client_name, r.run_name, r.load_kwh) for r in TR.timeseries(spark, root).collect()) == both


def test_incremental_feature_stream_is_restart_safe(spark, tmp_path):
    s = T.series_events(spark, SF_SMALL)
    landing, store, ckpt = str(tmp_path / "land"), str(tmp_path / "store"), str(tmp_path / "ckpt")
    INC.write_landing(s, landing, "config_id", 3)
    n1 = INC.run_feature_stream(spark, landing, s.schema, store, ckpt)
    first = sorted(tuple(r) for r in INC.BatchedStore(spark, store).load().collect())
    INC.run_feature_stream(spark, landing, s.schema, store, ckpt)
    again = sorted(tuple(r) for r in INC.BatchedStore(spark, store).load().collect())
    assert first == again and n1 >= 1
    direct = SER.extract(s, SER.SIMULATION_COLUMN_SPECS, SER.DF_FEATURE_NAMES)
    assert len(first) == direct.count()


def test_csv_and_json_sinks_round_trip(spark):
    for name in ("snk_csv_export", "snk_json_records"):
        assert Q[name](spark, SF_SMALL).count() > 0
