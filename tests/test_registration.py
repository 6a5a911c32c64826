"""User statistics and extractors, and keyed tables that are merged into."""

import os
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from capacitron.operators import series as S
from capacitron.operators.snapshots import SnapshotTable

T0 = datetime(2024, 1, 1)


@pytest.fixture
def registered():
    S.register_statistic("rms", lambda c: F.sqrt(F.avg(c * c)))
    S.register_pandas_statistic("last_gap", lambda s: s.iloc[-1] - s.iloc[0])
    S.register_extractor("net_energy", ("load_kwh", "generation_kwh"), lambda a, b: F.sum(a) - F.sum(b))
    yield
    for name in ("rms", "last_gap", "net_energy"):
        S.unregister(name)


def test_user_statistics_are_extracted_and_listed(spark, registered, monkeypatch):
    values = {1: [3.0, None, 4.0], 2: [None, None, None], 3: [5.0, 6.0, 9.0]}
    rows = [(k, T0 + timedelta(minutes=15 * i), v, 1.0) for k, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "config_id int, timestamp timestamp, load_kwh double, generation_kwh double").coalesce(1)
    spec = {"load_kwh": {"stats": ["mean", "rms", "last_gap", "unknown"], "percentiles": [50]}}
    got = {r.config_id: r for r in S.extract(df, spec, ["net_energy"]).collect()}
    assert got[1].load_kwh_rms == pytest.approx(np.sqrt(12.5)) and got[1].load_kwh_p50 == 3.5
    assert got[1].net_energy == 4.0 and got[2].load_kwh_rms is None and got[2].load_kwh_last_gap is None
    assert got[3].load_kwh_last_gap == 4.0
    assert S.extract(df.drop("generation_kwh"), spec, ["net_energy"]).first()["net_energy"] is None
    listed = S.list_all_features(spec, ["net_energy"])
    assert listed["column_features"] == ["load_kwh_last_gap", "load_kwh_mean", "load_kwh_p50", "load_kwh_rms"]
    assert listed["custom_features"] == ["net_energy"] and listed["total"] == 5
    monkeypatch.setattr(S, "HEAVY", 2)
    with pytest.raises(ValueError, match="up to 2 rows"):
        S.extract(df, spec)
    heavy = {r.config_id: r for r in S.extract(df, {"load_kwh": {"stats": ["rms"], "percentiles": [50]}}, ["net_energy"]).collect()}
    assert heavy[1].load_kwh_rms == pytest.approx(np.sqrt(12.5)) and heavy[1].net_energy == 4.0


def test_names_and_types_are_checked(registered):
    for name in ("mean", "rms", "last_gap", "iqr"):
        with pytest.raises(ValueError, match="registered already"):
            S.register_statistic(name, F.avg)
    for name in ("", "Upper", "a b", None, "1x"):
        with pytest.raises(ValueError):
            S.register_statistic(name, F.avg)
    with pytest.raises(TypeError):
        S.register_statistic("number", lambda c: 3)
    with pytest.raises(TypeError):
        S.register_extractor("nothing", (), lambda: F.lit(1))
    with pytest.raises((TypeError, ValueError)):
        S.register_pandas_statistic("text", lambda s: "x")
    with pytest.raises(ValueError, match="belongs to the library"):
        S.unregister("mean")
    S.register_statistic("rms", F.max, replace=True)


def kpis(spark, rows):
    return spark.createDataFrame(rows, "config_id long, kpi_name string, kpi_value double, kpi_unit string")


def test_merge_is_a_no_op_the_second_time(spark, tmp_path):
    t = SnapshotTable(spark, f"{tmp_path}/kpis", ["config_id", "kpi_name"])
    assert t.read() is None and t.version() == 0
    assert t.merge(kpis(spark, [(1, "a", 1.0, "EUR"), (1, "b", None, None), (2, "a", 3.0, None)])) == 1
    new = kpis(spark, [(1, "a", 1.0, "EUR"), (1, "b", 5.0, None), (3, "a", None, "EUR")])
    assert t.merge(new) == 2
    assert t.merge(new) is None and t.version() == 2
    rows = [(1, "a", 1.0, "EUR"), (1, "b", 5.0, None), (2, "a", 3.0, None), (3, "a", None, "EUR")]
    assert sorted(map(tuple, t.read().collect())) == rows
    assert sorted(map(tuple, t.read(1).collect()))[1] == (1, "b", None, None)
    assert spark.read.parquet(f"{tmp_path}/kpis/merge-2").count() == 2     # only what differs
    assert t.compact() == 3 and sorted(map(tuple, t.read().collect())) == rows and t.versions() == [(3, True)]
    # an unfinished version is not read, and its number not used again
    os.makedirs(f"{tmp_path}/kpis/merge-4")
    assert t.version() == 3 and t.merge(kpis(spark, [(9, "a", 1.0, "x")])) == 5
    assert t.read().count() == 5
