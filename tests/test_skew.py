"""Hot keys: one run / one series holding a large share of all rows gives exactly the
brute-force result (the plans pre-aggregate instead of collecting a group)."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from capacitron.operators import benefits as B
from capacitron.operators import series as SER


def test_benefits_with_a_hot_run(spark):
    rng = np.random.default_rng(11)
    rows, kpis = [], []
    cid = 0
    for run, n in [(1, 3000), (2, 5), (3, 4), (4, 6)]:          # run 1 holds most configurations
        for j in range(n):
            cid += 1
            base = j == 0
            cap = 0.0 if base else float(rng.integers(1, 500))
            rows.append((cid, run, "no_battery" if base else f"{int(cap)}kWh", base, cap, cap / 2))
            for k in B.BenefitBook().kpis:
                if not (k.endswith("_ic") and "trade" in k and j % 7 == 3):
                    kpis.append((cid, k, float(rng.normal(1000, 100))))
    cfg = spark.createDataFrame(rows, "config_id long, run_id long, config_name string, is_baseline boolean, "
                                      "battery_capacity_kwh double, battery_power_kw double")
    kp = spark.createDataFrame(kpis, "config_id long, kpi_name string, kpi_value double")
    got = {r.config_id: r for r in B.benefits(cfg, kp).collect()}
    c = pd.DataFrame(rows, columns=["config_id", "run_id", "name", "is_base", "cap", "pw"])
    k = pd.DataFrame(kpis, columns=["config_id", "kpi", "v"]).pivot(index="config_id", columns="kpi", values="v")
    base = c[c.is_base].set_index("run_id")["config_id"]
    for _, r in c[~c.is_base].iterrows():
        b = base[r.run_id]
        exp_peak = k.loc[b, "annual_total_grid_fee_cost_ic"] - k.loc[r.config_id, "annual_total_grid_fee_cost_ic"]
        ia = k.loc[b, "annual_total_energy_trade_cost_ia"] - k.loc[r.config_id, "annual_total_energy_trade_cost_ia"]
        ic = k.loc[b, "annual_total_energy_trade_cost_ic"] - k.loc[r.config_id, "annual_total_energy_trade_cost_ic"]
        g = got[r.config_id]
        assert g.baseline_config_id == b
        assert g.peak_shaving_benefit == pytest.approx(exp_peak)
        if np.isnan(ia + ic):
            assert g.trading_revenue is None
        else:
            assert g.trading_revenue == pytest.approx(ia + ic)
    assert len(got) == (~c.is_base).sum()


def test_percentiles_and_stats_with_a_hot_series(spark):
    rng = np.random.default_rng(5)
    t0 = datetime(2024, 1, 1)
    hot = rng.normal(50, 20, 20000).round(2)
    rows = [(1, t0 + timedelta(minutes=15 * i), float(v)) for i, v in enumerate(hot)]
    for key in range(2, 12):
        rows += [(key, t0 + timedelta(minutes=15 * i), float(v)) for i, v in enumerate(rng.normal(10, 3, 50).round(2))]
    df = spark.createDataFrame(rows, "config_id int, timestamp timestamp, x double").repartition(8)
    spec = {"x": {"stats": ["mean", "median", "std"], "percentiles": [5, 50, 95], "custom": ["iqr", "cycles_equivalent"]}}
    r = {row.config_id: row for row in SER.extract(df, spec).collect()}
    s = pd.Series(hot)
    assert r[1].x_median == pytest.approx(np.percentile(hot, 50))
    assert r[1].x_p95 == pytest.approx(np.percentile(hot, 95))
    assert r[1].x_iqr == pytest.approx(np.percentile(hot, 75) - np.percentile(hot, 25))
    assert r[1].x_std == pytest.approx(s.std())
    assert r[1].x_cycles_equivalent == pytest.approx(s.diff().abs().sum() / 200)
    assert len(r) == 11


def test_distributed_diffs_equal_pandas_on_a_hot_series(spark):
    rng = np.random.default_rng(9)
    t0 = datetime(2024, 1, 1)
    hot = rng.normal(50, 20, 5000).round(2)
    rows = [(1, t0 + timedelta(minutes=15 * i), float(v) if i % 97 else None) for i, v in enumerate(hot)]
    rows += [(2, t0 + timedelta(minutes=15 * i), float(v)) for i, v in enumerate([1.0, 1.05, 3.0])]
    rows += [(3, t0, 4.0)]
    df = spark.createDataFrame(rows, "config_id int, timestamp timestamp, x double")
    got = {r.config_id: r for r in SER.distributed_diff_stats(df, "x", parts=7).collect()}
    for k in (1, 2, 3):
        s = pd.Series([v for (kk, _, v) in rows if kk == k and v is not None])
        assert got[k].x__abs_diff_sum == pytest.approx(s.diff().abs().sum(), rel=1e-12)
        assert got[k].x__big_diffs == int((s.diff().abs() > 0.1).sum())
