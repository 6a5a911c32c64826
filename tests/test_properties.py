"""Property tests (hypothesis) and pandas parity for the series statistics, PV weekday
scaling, upserts, group split/folds and exact linear fits (SURVEY §5)."""

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from capacitron.operators import ml as ML
from capacitron.operators import profile as P
from capacitron.operators import series as SER
from capacitron.operators import warehouse as W

FAST = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
values = st.lists(st.floats(min_value=-50, max_value=150, allow_nan=False, width=32), min_size=1, max_size=40)


@FAST
@given(vals=values)
def test_series_stats_invariants(spark, vals):
    t0 = datetime(2024, 1, 1)
    rows = [(1, t0 + timedelta(minutes=15 * i), float(v)) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "config_id int, timestamp timestamp, x double")
    spec = {"x": {"stats": ["mean", "std", "min", "max", "sum", "median", "var"], "percentiles": [10, 50, 90],
                  "custom": ["peak_to_mean", "cv", "range", "charge_energy", "discharge_energy", "utilization",
                             "cycles_equivalent", "reversals", "time_below_20pct", "capacity_factor"]}}
    r = SER.extract(df, spec).collect()[0].asDict()
    g = {k[2:]: v for k, v in r.items() if k.startswith("x_")}
    n, tol = len(vals), 1e-6 * (1 + max(abs(float(v)) for v in vals))
    assert g["min"] - tol <= g["p10"] <= g["p50"] + tol and g["p50"] <= g["p90"] + tol and g["p90"] <= g["max"] + tol
    assert g["median"] == pytest.approx(g["p50"], abs=tol)
    assert g["min"] - tol <= g["mean"] <= g["max"] + tol
    assert g["sum"] == pytest.approx(g["mean"] * n, rel=1e-6, abs=n * tol)
    assert g["range"] == pytest.approx(g["max"] - g["min"], abs=tol)
    assert g["charge_energy"] - g["discharge_energy"] == pytest.approx(g["sum"], rel=1e-6, abs=n * tol)
    assert 0 <= g["utilization"] <= 1 and 0 <= g["time_below_20pct"] <= 1 and 0 <= g["reversals"] <= n - 1
    assert 200 * g["cycles_equivalent"] + tol >= abs(float(vals[-1]) - float(vals[0]))
    if n > 1:
        assert g["var"] == pytest.approx(g["std"] ** 2, rel=1e-6, abs=tol)
    else:
        assert g["std"] is None and g["var"] is None and g["reversals"] == 0


def test_statistics_of_a_short_series(spark):
    """Numbers worked out by hand for 2, 6, -4, 30, 6."""
    df = spark.createDataFrame([(1, datetime(2024, 1, 1) + timedelta(minutes=15 * i), float(v)) for i, v in enumerate((2, 6, -4, 30, 6))],
                               "config_id long, timestamp timestamp, x double")
    spec = {"x": {"stats": ["mean", "std", "var", "sum", "median"], "percentiles": [10, 75],
                  "custom": ["peak_to_mean", "cv", "iqr", "charge_energy", "discharge_energy", "utilization",
                             "cycles_equivalent", "reversals", "time_below_20pct", "capacity_factor", "export_ratio"]}}
    r = SER.extract(df, spec).first()
    exp = {"mean": 8.0, "var": 168.0, "std": 12.961481396815721, "sum": 40.0, "median": 6.0, "p10": -1.6, "p75": 6.0,
           "peak_to_mean": 3.75, "cv": 1.6201851746019651, "iqr": 4.0, "charge_energy": 44.0, "discharge_energy": 4.0,
           "utilization": 1.0, "cycles_equivalent": 0.36, "reversals": 4.0, "time_below_20pct": 0.8,
           "capacity_factor": 0.26666666666666666, "export_ratio": 0.8}
    for k, v in exp.items():
        assert r[f"x_{k}"] == pytest.approx(v), k


def test_cv_iqr_identities(spark):
    from conftest import SF_SMALL
    import __spark_entry__ as E
    q = E.queries()
    a = {r.config_id: r for r in q["ts_cv"](spark, SF_SMALL).collect()}
    b = {r.config_id: r for r in q["ts_std"](spark, SF_SMALL).collect()}
    m = {r.config_id: r for r in q["ts_mean"](spark, SF_SMALL).collect()}
    for k in a:
        if m[k].load_kwh_mean and b[k].load_kwh_std is not None:
            assert a[k].load_kwh_cv == pytest.approx(b[k].load_kwh_std / m[k].load_kwh_mean, abs=2e-4)


@FAST
@given(load=st.lists(st.floats(min_value=0, max_value=50, allow_nan=False), min_size=14, max_size=30),
       pv=st.lists(st.floats(min_value=0.1, max_value=20, allow_nan=False), min_size=14, max_size=30),
       share=st.floats(min_value=0, max_value=1))
def test_weekday_scaling_preserves_total_pv(spark, load, pv, share):
    t0 = datetime(2024, 1, 1)       # a Monday; rows every 12 h cover every weekday
    lrows = [(1, t0 + timedelta(hours=12 * i), float(v)) for i, v in enumerate(load)]
    prow = [(1, t0 + timedelta(hours=12 * i), float(v)) for i, v in enumerate(pv)]
    ld = spark.createDataFrame(lrows, "site_id int, timestamp_utc timestamp, grid_load_kwh double")
    p = spark.createDataFrame(prow, "site_id int, timestamp_utc timestamp, pv_generation_kwh double")
    scaled = P.weekday_scale(ld, p, share)
    total = scaled.agg(F.sum("pv_scaled_kwh")).collect()[0][0]
    days = {(t0 + timedelta(hours=12 * i)).weekday() for i in range(len(pv))}
    if len(days) == 7 and sum(load) > 0:
        assert total == pytest.approx(sum(pv) * share, rel=1e-9, abs=1e-9)
    merged = P.merge_load_pv(ld, scaled).agg(F.sum("consumption_kwh"), F.sum("grid_load_kwh"),
                                              F.sum("pv_load_kwh")).collect()[0]
    assert merged[0] == pytest.approx(merged[1] + merged[2])


def test_weekday_totals_has_seven_days_and_shares_sum_to_one(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(1, t0 + timedelta(days=i), 1.0 + i) for i in range(3)]
    df = spark.createDataFrame(rows, "site_id int, timestamp_utc timestamp, grid_load_kwh double")
    out = P.weekday_totals(df).orderBy("weekday").collect()
    assert [r.weekday for r in out] == list(range(7))
    assert sum(r.share for r in out) == pytest.approx(1.0)
    assert out[5].total == 0.0


def test_average_week_has_672_slots(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(1, t0 + timedelta(minutes=15 * i), float(i % 7), 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "site_id int, timestamp_utc timestamp, grid_load_kwh double, pv_load_kwh double")
    out = P.average_week(df)
    assert out.count() == 672
    first = out.filter("global_index = 0").collect()[0]
    assert first.label == "Mon 00:00" and first.value == 0.0


def test_upsert_is_idempotent_and_allows_new_columns(spark):
    store = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "config_id int, k string, v double")
    new = spark.createDataFrame([(2, "b", 5.0, 1.0), (3, "c", 3.0, 1.0)], "config_id int, k string, v double, w double")
    once = W.upsert(store, new, ["config_id", "k"])
    twice = W.upsert(once, new, ["config_id", "k"])
    a = sorted(tuple(r) for r in once.collect())
    b = sorted(tuple(r) for r in twice.collect())
    assert a == b == [(1, "a", 1.0, None), (2, "b", 5.0, 1.0), (3, "c", 3.0, 1.0)]


def test_insert_ignore_keeps_existing(spark):
    store = spark.createDataFrame([(1, "x")], "id int, n string")
    new = spark.createDataFrame([(1, "changed"), (2, "y"), (2, "y")], "id int, n string")
    assert sorted(tuple(r) for r in W.insert_ignore(store, new, ["id"]).collect()) == [(1, "x"), (2, "y")]


def test_last_write_wins(spark):
    df = spark.createDataFrame([(1, 10.0, 1), (1, 20.0, 3), (1, 30.0, 2), (2, 5.0, 1)], "k int, v double, seq int")
    got = sorted(tuple(r) for r in W.last_write_wins(df, ["k"], "seq").collect())
    assert got == [(1, 20.0, 3), (2, 5.0, 1)]


def test_group_split_keeps_clients_whole(spark):
    rows = [(i, f"client{i % 23}", float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "config_id int, client_name string, label double")
    s = ML.group_split(df)
    sides = s.groupBy("client_name").agg(F.countDistinct("is_test").alias("n")).collect()
    assert all(r.n == 1 for r in sides)
    n_test = s.filter("is_test").select("client_name").distinct().count()
    assert n_test == math.ceil(0.2 * 23)
    again = ML.group_split(df)
    assert sorted(tuple(r) for r in s.collect()) == sorted(tuple(r) for r in again.collect())


def test_group_folds_leave_one_client_out_for_few_clients(spark):
    rows = [(i, f"c{i % 4}", 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "config_id int, client_name string, label double")
    f = ML.group_folds(df)
    per = f.groupBy("client_name").agg(F.countDistinct("fold").alias("n"), F.first("fold").alias("fold")).collect()
    assert all(r.n == 1 for r in per) and sorted(r.fold for r in per) == [0, 1, 2, 3]


def test_ols_and_grouped_cv_match_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=200)
    y = 3 * x + 1 + rng.normal(scale=0.5, size=200)
    g = [f"c{i % 10}" for i in range(200)]
    pdf = pd.DataFrame({"config_id": range(200), "client_name": g, "target": "t", "feature": "f", "x": x, "y": y})
    lg = spark.createDataFrame(pdf)
    fit = ML.ols_fit(lg).collect()[0]
    b, a = np.polyfit(x, y, 1)
    assert fit.slope == pytest.approx(b) and fit.intercept == pytest.approx(a)
    fold = F.regexp_extract("client_name", r"(\d+)", 1).cast("int") % 5
    cv = {r.fold: r.r2 for r in ML.grouped_cv_r2(lg, fold).collect()}
    folds = np.array([int(c[1:]) % 5 for c in g])
    for k in range(5):
        tr, te = folds != k, folds == k
        bb, aa = np.polyfit(x[tr], y[tr], 1)
        pred = aa + bb * x[te]
        r2 = 1 - ((y[te] - pred) ** 2).sum() / ((y[te] - y[te].mean()) ** 2).sum()
        assert cv[k] == pytest.approx(r2, rel=1e-9)


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(120, 3)) * [1.0, 5.0, 0.2] + [2.0, -1.0, 0.5]
    y = X @ [1.5, -0.7, 4.0] + 2 + rng.normal(scale=0.3, size=120)
    pdf = pd.DataFrame(X, columns=["a", "b", "c"]).assign(label=y)
    df = spark.createDataFrame(pdf)
    alpha = 1.0
    reg = ML.ridge_reg_param(df, "label", alpha)
    # sklearn-style ridge on standardised X (population std), intercept unpenalised
    mu, sd = X.mean(0), X.std(0)
    Z = (X - mu) / sd
    yc = y - y.mean()
    w = np.linalg.solve(Z.T @ Z + alpha * np.eye(3), Z.T @ yc)
    expected = y.mean() + Z @ w
    pm = ML.fit(df, ["a", "b", "c"], "ridge", regParam=reg)
    got = np.array([r.prediction for r in pm.transform(df).orderBy(F.monotonically_increasing_id()).collect()])
    assert np.allclose(got, expected, rtol=1e-3, atol=1e-3)


@FAST
@given(vals=st.lists(st.integers(min_value=-20, max_value=20), min_size=1, max_size=60),
       other=st.lists(st.floats(min_value=0, max_value=9, allow_nan=False), min_size=1, max_size=10))
def test_distributed_percentiles_equal_numpy(spark, vals, other):
    t0 = datetime(2024, 1, 1)
    rows = [(1, t0 + timedelta(minutes=i), float(v)) for i, v in enumerate(vals)]
    rows += [(2, t0 + timedelta(minutes=i), float(v)) for i, v in enumerate(other)]
    rows += [(3, t0, None)]
    df = spark.createDataFrame(rows, "config_id int, timestamp timestamp, x double")
    ps = [0, 10, 25, 50, 75, 90, 95, 100]
    got = {r.config_id: r for r in SER.distributed_percentiles(df, "x", ps).collect()}
    for k, data in ((1, vals), (2, other)):
        for p in ps:
            assert got[k][f"x_p{p}"] == pytest.approx(np.percentile(np.array(data, dtype=float), p), rel=1e-12, abs=1e-12)
    assert 3 not in got
    full = SER.extract(df, {"x": {"stats": ["mean"], "percentiles": [10, 90]}}, percentiles="distributed")
    inagg = SER.extract(df, {"x": {"stats": ["mean"], "percentiles": [10, 90]}})
    a = sorted(tuple(r) for r in full.select("config_id", "x_mean", "x_p10", "x_p90").collect())
    b = sorted(tuple(r) for r in inagg.select("config_id", "x_mean", "x_p10", "x_p90").collect())
    assert len(a) == len(b)
    for ra, rb in zip(a, b):
        assert ra[0] == rb[0] and all((x is None and y is None) or x == pytest.approx(y) for x, y in zip(ra[1:], rb[1:]))
