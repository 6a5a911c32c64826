"""Negative ids, NaN, hot percentile keys, one split rule, non-empty folds."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from capacitron.operators import benefits as B
from capacitron.operators import ml as ML
from capacitron.operators import series as SE


def test_negative_config_ids(spark):
    cfg = spark.createDataFrame(
        [(-5, 1, "base", 0.0, 0.0, True), (-9, 1, "other", 5.0, 1.0, False), (-(1 << 62), 2, "x", 0.0, 0.0, False),
         (3, 2, "y", 0.0, 0.0, False), (7, 2, "z", 9.0, 1.0, False)],
        "config_id long, run_id long, config_name string, battery_capacity_kwh double, battery_power_kw double, is_baseline boolean")
    got = {r.run_id: r.baseline_config_id for r in B.pick_baselines(cfg).collect()}
    assert got == {1: -5, 2: -(1 << 62)}
    names = B.BenefitBook().kpis
    kpis = spark.createDataFrame([(c, k, float(abs(c) % 100)) for c in (-5, -9) for k in names],
                                 "config_id long, kpi_name string, kpi_value double")
    row = B.benefits(cfg, kpis).where("config_id = -9").first()
    assert row.baseline_config_id == -5
    assert {abs(row[b.name]) for b in B.BenefitBook().items} == {4.0 * len(b.kpis) for b in B.BenefitBook().items}


@pytest.mark.parametrize("values", [[1.0, 2.0, float("nan"), 4.0], [None, float("nan"), 3.0], [2.0, 2.0, 2.0]])
def test_nan_is_folded(spark, values):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1, i), v) for i, v in enumerate(values)],
                               "config_id long, timestamp timestamp, load_kwh double")
    spec = {"load_kwh": {"stats": ["mean", "max", "std", "median"], "percentiles": [50, 90], "custom": ["cycles_equivalent"]}}
    r = SE.extract(df, spec).first()
    s = pd.Series(values, dtype=float).dropna()
    exp = {"mean": s.mean(), "max": s.max(), "std": s.std(), "median": s.median(), "p50": np.percentile(s, 50),
           "p90": np.percentile(s, 90), "cycles_equivalent": s.diff().abs().sum() / 200}
    for k, v in exp.items():
        got = r[f"load_kwh_{k}"]
        assert (got is None and np.isnan(v)) or got == pytest.approx(v), k


def test_percentile_of_a_hot_key_is_split(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(-1).alias("config_id"),
                                    (F.col("id") * 7919 % 20_011).cast("double").alias("v"))
    got = SE.distributed_percentiles(df, "v", [10, 50, 99]).where("config_id = -1").first()
    v = [float(i * 7919 % 20_011) for i in range(20_000) if i % 100]
    assert [got[1], got[2], got[3]] == pytest.approx(list(np.percentile(v, [10, 50, 99])))


@pytest.mark.parametrize("n", [2, 7, 50, 3000])
def test_one_split_rule(spark, n):
    df = spark.range(n * 2).select(F.concat(F.lit("c"), F.col("id") % n).alias("client_name"))
    t = ML.group_split(df).where("is_test").select("client_name").distinct().count()
    assert t == -(-n // 5)


@pytest.mark.parametrize("n", [2, 6, 7, 9, 40])
def test_no_fold_is_empty(spark, n):
    df = spark.range(n * 3).select(F.concat(F.lit("c"), F.col("id") % n).alias("client_name"))
    f = ML.group_folds(df)
    assert f.select("fold").distinct().count() == (n if n <= 5 else 5) and f.count() == n * 3
    assert f.groupBy("client_name").agg(F.countDistinct("fold").alias("k")).where("k > 1").count() == 0


@pytest.mark.parametrize("query", ["ml_train_ridge", "ml_permutation"])
def test_every_target_is_trained(spark, query):
    from capacitron.plans import ml_plans as MP
    got = getattr(MP, query)(spark, "/root/testdata/sf0.001")
    assert {r.target for r in got.select("target").distinct().collect()} == set(MP.MODELS)


def test_stored_tables_follow_their_source(spark, tmp_path):
    """Another state of a table gives another store; the same state the same one."""
    import os
    import shutil

    from capacitron.sources import tables as T
    for t in T.SOURCE_TABLES:
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", tmp_path)
    one = T.tag(spark, str(tmp_path))
    assert T.tag(spark, str(tmp_path)) == one and T.read(spark, str(tmp_path), "customer").count() == 150
    os.utime(f"{tmp_path}/orders.parquet", (1, 1))
    two = T.tag(spark, str(tmp_path))
    shutil.copy("/root/testdata/sf0.01/customer.parquet", tmp_path)
    assert len({one, two, T.tag(spark, str(tmp_path))}) == 3
    assert T.read(spark, str(tmp_path), "customer").count() == 1500


@pytest.mark.parametrize("query", ["ml_train_gbt", "ml_importance", "ml_interval", "dx_model_types"])
def test_every_target_is_trained_with_trees(spark, monkeypatch, query):
    """Small trees: only the targets and columns are looked at."""
    from capacitron.plans import mllib_plans as MP
    real, seen = ML.fit, set()
    small = {"gbt": {"maxIter": 2, "maxDepth": 2}, "random_forest": {"numTrees": 2}}
    monkeypatch.setattr(ML, "fit", lambda d, f, kind, **p: real(d, f, kind, **{**p, **small.get(kind, {})}))
    monkeypatch.setattr(MP, "_train", lambda s, sf, t, m, **p: seen.add(t) or MP._train_uncached(s, sf, t, m, **p))
    got = getattr(MP, query)(spark, "/root/testdata/sf0.001")
    assert {r.target for r in got.select("target").distinct().collect()} == set(MP.TARGETS) == seen
