"""Hand-made edge cases for the NULL/NaN/ANSI decisions and the
reading-defect decisions (§1.5)."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from capacitron.functions import nulls as N
from capacitron.functions import scalars as S
from capacitron.operators import benefits as B
from capacitron.operators import series as SER


def one(df):
    return df.collect()[0]


def test_n1_nan_folded_before_aggregation(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "v double")
    r = one(df.select(F.avg(N.nan_to_null("v")).alias("m")))
    assert r.m == 2.0


def test_n2_std_ddof1_and_single_value_null(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 4.0), (2, 5.0)], "k int, v double")
    out = {r.k: r for r in SER.extract(df.withColumn("timestamp", F.current_timestamp()),
                                       {"v": {"stats": ["std", "var"]}}, key="k").collect()}
    s = pd.Series([1.0, 2.0, 4.0])
    assert out[1].v_std == pytest.approx(s.std())
    assert out[1].v_var == pytest.approx(s.var())
    assert out[2].v_std is None


@pytest.mark.parametrize("vals", [[1.0, 2.0, 4.0, 8.0, 3.0], [5.0, 1.0, 1.0, 2.0, 9.0, 0.5, 3.3]])
def test_n3_bias_corrected_moments_match_pandas(spark, vals):
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    r = one(df.select(N.skew_unbiased("v").alias("s"), N.kurt_unbiased("v").alias("k")))
    s = pd.Series(vals)
    assert r.s == pytest.approx(s.skew(), rel=1e-10)
    assert r.k == pytest.approx(s.kurtosis(), rel=1e-10)


def test_n4_constant_series_gives_zero_and_short_gives_null(spark):
    df = spark.createDataFrame([(10.0,)] * 5, "v double")
    r = one(df.select(N.skew_unbiased("v").alias("s"), N.kurt_unbiased("v").alias("k")))
    assert (r.s, r.k) == (0.0, 0.0)
    df2 = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    r2 = one(df2.select(N.skew_unbiased("v").alias("s"), N.kurt_unbiased("v").alias("k")))
    assert r2.s is None and r2.k is None


def test_n5_linear_percentiles_match_numpy(spark):
    vals = [3.0, 1.0, 7.0, 2.0, 9.0, 4.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    r = one(SER.extract(df.withColumn("k", F.lit(1)).withColumn("timestamp", F.current_timestamp()),
                        {"v": {"percentiles": [10, 25, 75, 95], "custom": ["iqr"]}}, key="k"))
    for p in (10, 25, 75, 95):
        assert r[f"v_p{p}"] == pytest.approx(np.percentile(vals, p))
    assert r.v_iqr == pytest.approx(np.percentile(vals, 75) - np.percentile(vals, 25))


def test_n6_division_by_zero_is_null_not_error(spark):
    df = spark.createDataFrame([(1.0, 0.0)], "a double, b double")
    assert one(df.select(N.safe_div("a", "b").alias("r"))).r is None


def test_n7_constant_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, y double")
    assert one(df.select(N.guarded_corr("x", "y").alias("c"))).c is None
    df2 = spark.createDataFrame([(1.0, 2.0), (2.0, 4.1), (3.0, 5.9), (None, 1.0)], "x double, y double")
    c = one(df2.select(N.guarded_corr("x", "y").alias("c"))).c
    assert c == pytest.approx(pd.Series([1.0, 2, 3]).corr(pd.Series([2.0, 4.1, 5.9])))


def test_n8_monday_is_zero(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00",)], "t string").select(F.to_timestamp("t").alias("t"))
    assert one(df.select(F.weekday("t").alias("w"))).w == 0


def test_n10_diff_skips_nulls_in_time_order(spark):
    rows = [(1, "2024-01-01 00:00:00", 10.0), (1, "2024-01-01 00:15:00", None),
            (1, "2024-01-01 00:30:00", 30.0), (1, "2024-01-01 00:45:00", 20.0)]
    df = spark.createDataFrame(rows, "config_id int, t string, soc double").select(
        "config_id", F.to_timestamp("t").alias("timestamp"), "soc")
    r = one(SER.extract(df, {"soc": {"custom": ["cycles_equivalent", "reversals"]}}))
    s = pd.Series([10.0, 30.0, 20.0])
    assert r.soc_cycles_equivalent == pytest.approx(s.diff().abs().sum() / 200)
    assert r.soc_reversals == float((s.diff().abs() > 0.1).sum())


def test_n11_numeric_guard_rejects_java_suffixes(spark):
    vals = [" 5 ", "1e3", "5d", "False", "['none']", "{}", "nan", "", "-2.5", "7f"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r.x for r in df.select(S.numeric_or_null("v").alias("x")).collect()]
    assert got == [5.0, 1000.0, None, None, None, None, None, None, -2.5, None]


def test_n12_unicode_word_characters_kept(spark):
    df = spark.createDataFrame([("Müller GmbH & Co",)], "n string")
    assert one(df.select(S.sanitize_name("n").alias("s"))).s == "Müller_GmbH___Co"


def test_d3_100kwh_is_not_a_baseline(spark):
    df = spark.createDataFrame([("100kWh",), ("0kWh",), ("No Battery",), ("0kwh_test",), ("battery_1",)], "n string")
    got = [r.b for r in df.select(S.is_baseline_name("n").alias("b")).collect()]
    assert got == [False, True, True, True, False]


def test_config_name_and_specs(spark):
    names = ["kpi_summary_20250905_114337_5000kWh.xlsx", "flex_timeseries_outputs_20250905_114337_5000kWh.csv",
             "kpi_summary_no_battery.csv", "flex_timeseries_outputs_battery_1.csv", "100kWh_50kW.csv"]
    df = spark.createDataFrame([(n,) for n in names], "f string").select(S.config_name_from_file("f").alias("c"))
    got = [r.c for r in df.collect()]
    assert got == ["5000kWh", "5000kWh", "no_battery", "battery_1", "100kWh_50kW"]
    specs = spark.createDataFrame([("100kWh_50kW",), ("battery_1",)], "n string").select(
        S.capacity_kwh("n").alias("c"), S.power_kw("n").alias("p")).collect()
    assert (specs[0].c, specs[0].p) == (100.0, 50.0)
    assert (specs[1].c, specs[1].p) == (None, None)


def test_folder_date_invalid_falls_through(spark):
    df = spark.createDataFrame([("Run 5.9.2025",), ("Run 32.13.2020 20200105",), ("2024-02-30 x 20240301",),
                                ("nothing",)], "f string")
    got = [str(r.d) if r.d else None for r in df.select(S.folder_date("f").alias("d")).collect()]
    assert got == ["2025-09-05", "2020-01-05", "2024-03-01", None]


def _configs(spark, rows):
    return spark.createDataFrame(rows, "config_id long, run_id long, config_name string, is_baseline boolean, "
                                       "battery_capacity_kwh double, battery_power_kw double")


def test_baseline_pick_rules(spark):
    cfg = _configs(spark, [
        (11, 1, "0kWh", True, 0.0, 0.0), (12, 1, "0kWh_b", True, 0.0, 0.0), (13, 1, "50kWh", False, 50.0, 10.0),
        (21, 2, "battery_1", False, None, None), (22, 2, "0kWh", False, 0.0, 0.0), (23, 2, "100kWh", False, 100.0, 5.0),
        (31, 3, "battery_1", False, None, None), (32, 3, "100kWh", False, 100.0, 5.0),
        (41, 4, "100kWh", False, 100.0, 5.0)])
    got = {r.run_id: r.baseline_config_id for r in B.pick_baselines(cfg).collect()}
    assert got == {1: 11, 2: 22, 3: 31}          # flagged first; capacity 0 before NULL; no baseline -> absent
    strict = {r.run_id: r.baseline_config_id for r in B.pick_baselines(cfg, strict_reference_order=True).collect()}
    assert strict[2] == 21                        # reference order: NULL capacity first


def test_composite_benefit_null_when_a_component_is_missing(spark):
    cfg = _configs(spark, [(1, 1, "no_battery", True, 0.0, 0.0), (2, 1, "10kWh", False, 10.0, 5.0),
                           (3, 1, "20kWh", False, 20.0, 5.0)])
    k = spark.createDataFrame([
        (1, "annual_total_grid_fee_cost_ic", 100.0), (2, "annual_total_grid_fee_cost_ic", 70.0),
        (1, "annual_total_energy_trade_cost_ia", 10.0), (2, "annual_total_energy_trade_cost_ia", 4.0),
        (1, "annual_total_energy_trade_cost_ic", 5.0), (2, "annual_total_energy_trade_cost_ic", 1.0),
        (3, "annual_total_energy_trade_cost_ia", 3.0)], "config_id long, kpi_name string, kpi_value double")
    out = {r.config_id: r for r in B.benefits(cfg, k).collect()}
    assert set(out) == {2, 3}                     # flagged baseline excluded
    assert out[2].peak_shaving_benefit == 30.0
    assert out[2].trading_revenue == 10.0         # (10-4) + (5-1)
    assert out[3].trading_revenue is None         # ic missing for config 3
    assert out[3].peak_shaving_benefit is None
    assert out[2].energy_procurement_optimization is None
    inc = {r.config_id: r for r in B.benefits(cfg, k, include_baseline=True).collect()}
    assert inc[1].peak_shaving_benefit == 0.0


def test_benefit_summary_ddof1(spark):
    cfg = _configs(spark, [(1, 1, "no_battery", True, 0.0, 0.0), (2, 1, "a", False, 1.0, 1.0),
                           (3, 1, "b", False, 2.0, 1.0), (4, 1, "c", False, 3.0, 1.0)])
    k = spark.createDataFrame([(1, "annual_total_grid_fee_cost_ic", 10.0), (2, "annual_total_grid_fee_cost_ic", 9.0),
                               (3, "annual_total_grid_fee_cost_ic", 7.0), (4, "annual_total_grid_fee_cost_ic", 4.0)],
                              "config_id long, kpi_name string, kpi_value double")
    s = {r.benefit_name: r for r in B.benefit_summary(B.benefits(cfg, k)).collect()}
    vals = pd.Series([1.0, 3.0, 6.0])
    assert s["peak_shaving_benefit"]["count"] == 3
    assert s["peak_shaving_benefit"]["std"] == pytest.approx(vals.std())
    assert s["trading_revenue"]["count"] == 0


def test_custom_benefit_registration():
    book = B.BenefitBook().add("x", baseline_kpi="k1", calculation="battery - baseline")
    assert "x" in book.names and "k1" in book.kpis
    with pytest.raises(ValueError):
        B.BenefitBook().add("y")
