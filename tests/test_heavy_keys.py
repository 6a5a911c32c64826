"""Series that hold most rows: percentiles, differences and rolling frames from segments, with
the sizes of the tasks that do the work."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from capacitron.operators import calendar as C
from capacitron.operators import segments as SEG
from capacitron.operators import series as SER
from capacitron.operators.ranking import ranked
from capacitron.operators.series_legacy import extract_legacy

T0 = datetime(2024, 1, 1)


@pytest.fixture
def small_limits(monkeypatch):
    monkeypatch.setattr(SER, "HEAVY", 300)
    monkeypatch.setattr(SEG, "ROWS", 250)


def frame(spark, values: dict, column="x"):
    rows = [(k, T0 + timedelta(minutes=15 * i), None if v is None else float(v)) for k, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, f"config_id int, timestamp timestamp, {column} double").repartition(6)


SKEWED = {
    "outlier": lambda rng: np.r_[rng.random(4000).round(3), 1e9],
    "wide": lambda rng: np.r_[rng.normal(0, 1, 3000), 1e300, -1e300],
    "infinite": lambda rng: np.r_[rng.normal(0, 1, 3000), [np.inf] * 400, [-np.inf] * 200],
    "one value": lambda rng: np.full(4000, 7.5),
    "mostly one value": lambda rng: np.r_[np.zeros(3900), rng.random(100)],
    "exponential": lambda rng: np.exp(rng.normal(0, 8, 4000)),
}


@pytest.mark.parametrize("kind", SKEWED)
def test_percentiles_of_skewed_heavy_series(spark, small_limits, kind):
    rng = np.random.default_rng(3)
    hot, ps = SKEWED[kind](rng), [0, 1, 25, 50, 90, 99, 100]
    df = frame(spark, {1: rng.permutation(hot), 2: [3.0, 1.0], 3: [None, None]})
    got = {r[0]: r[1:] for r in SER.exact_percentiles(df, {"x": ps}).collect()}
    with np.errstate(invalid="ignore"):
        exp = np.percentile(hot, ps, method="linear")
    for p, a, b in zip(ps, got[1], exp):
        if np.isnan(b):                         # numpy interpolates between equal infinities
            assert np.isinf(a)
        else:
            assert a == pytest.approx(b, rel=1e-12), p
    assert got[2] == pytest.approx(np.percentile([1, 3], ps)) and set(got[3]) == {None}


@pytest.mark.parametrize("kind", ["outlier", "wide", "exponential", "infinite"])
def test_segments_hold_equal_counts(spark, small_limits, kind):
    """No segment of a heavy key's values is much larger than its share, however they are spread."""
    hot = SKEWED[kind](np.random.default_rng(4))
    values = np.sort(hot)
    df = frame(spark, {1: hot})
    cuts = df.agg(F.percentile_approx("x", F.array(*[F.lit(k / SER.SEGMENTS) for k in range(1, SER.SEGMENTS)]), 1000)).first()[0]
    sizes = np.bincount(np.searchsorted(cuts, values, "left"))
    ties = max(np.unique(values, return_counts=True)[1])
    assert sizes.max() <= max(2.5 * len(hot) / SER.SEGMENTS, ties + len(hot) / SER.SEGMENTS)


def test_rows_of_a_hot_series_spread_over_segments(spark, small_limits):
    rng = np.random.default_rng(5)
    df = frame(spark, {1: rng.random(5000), 2: rng.random(20)})
    cut = SEG.segmented(df, 95)
    sizes = {(r.config_id, r._seg): r["count"] for r in cut.groupBy("config_id", "_seg").count().collect()}
    assert max(sizes.values()) <= 250 + 95 and len(sizes) >= 20
    assert cut.where("NOT _copy").count() == 5020


def test_differences_equal_pandas(spark, small_limits):
    rng = np.random.default_rng(6)
    values = {1: [v if i % 11 else None for i, v in enumerate(rng.random(2000))], 2: [1.0, None, 4.0], 3: [2.0], 4: rng.random(300)}
    got = {(r.config_id, r.timestamp): r.d for r in SEG.differences(frame(spark, values), "x", "d").collect()}
    assert len(got) == sum(map(len, values.values()))
    for k, vs in values.items():
        for i, d in enumerate(pd.Series(vs, dtype=float).diff()):
            mine = got[k, T0 + timedelta(minutes=15 * i)]
            assert mine is None if np.isnan(d) else mine == pytest.approx(d)


def test_rolling_equals_pandas(spark, small_limits):
    rng = np.random.default_rng(7)
    values = {1: rng.random(1500), 2: rng.random(30)}
    got = {r.config_id: r for r in C.rolling(frame(spark, values, "load_kwh"), windows=[4, 96]).collect()}
    for k, vs in values.items():
        s = pd.Series(vs)
        for w in (4, 96):
            m = s.rolling(w, min_periods=1)
            assert got[k][f"roll{w}_mean_max"] == pytest.approx(m.mean().max())
            assert got[k][f"roll{w}_mean_mean"] == pytest.approx(m.mean().mean())
            assert got[k][f"roll{w}_max_mean"] == pytest.approx(m.max().mean())
            assert got[k][f"roll{w}_std_mean"] == pytest.approx(s.rolling(w, min_periods=2).std().mean())


def test_heavy_and_light_keys_agree(spark, monkeypatch):
    """Every feature of extract and of the older extractors is the same by either way."""
    rng = np.random.default_rng(8)
    cols = ["load_kwh", "soc_percent", "power_kw", "grid_import_kwh", "grid_export_kwh", "generation_kwh", "price_eur_mwh"]
    rows = [(k, T0 + timedelta(hours=7 * i), *[None if rng.random() < .1 else float(v) for v in rng.normal(20, 30, len(cols)).round(2)])
            for k, n in ((1, 1500), (2, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "config_id int, timestamp timestamp, " + ", ".join(f"{c} double" for c in cols)).repartition(5)
    legacy = ("load_profile", "battery", "temporal", "grid")

    def both():
        return ({r.config_id: r.asDict() for r in SER.extract(df, SER.SIMULATION_COLUMN_SPECS, SER.DF_FEATURE_NAMES).collect()},
                {r.config_id: r.asDict() for r in extract_legacy(df, legacy).collect()})
    plain = both()
    monkeypatch.setattr(SER, "HEAVY", 300)
    for a, b in zip(plain, both()):
        assert a.keys() == b.keys()
        for k in a:
            assert list(a[k]) == list(b[k])
            for c, v in a[k].items():
                assert (v is None and b[k][c] is None) or b[k][c] == pytest.approx(v, rel=1e-9, abs=1e-9), c


def test_ranks_without_a_global_window(spark):
    df = spark.createDataFrame([(i % 3, (i * 37) % 101) for i in range(101)], "g int, v int").repartition(7)
    got = ranked(df, ["v"], "r", ["g"]).collect()
    for g in range(3):
        vs = sorted(r.v for r in got if r.g == g)
        assert [r.v for r in sorted((r for r in got if r.g == g), key=lambda r: r.r)] == vs
        assert sorted(r.r for r in got if r.g == g) == list(range(len(vs)))
    whole = ranked(df, [F.desc("v")], "r").collect()
    assert [r.v for r in sorted(whole, key=lambda r: r.r)] == sorted((r.v for r in got), reverse=True)
    plan = ranked(df, ["v"], "r")._jdf.queryExecution().toString()
    assert "Window" not in plan.split("Physical Plan")[0] or "_rank_task" in plan
