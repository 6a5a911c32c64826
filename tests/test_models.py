"""Ridge models from moments, additive contributions, the registry, and scoring streams."""

import os
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from capacitron.operators import linear as L
from capacitron.operators import ml as ML
from capacitron.operators.model_store import ModelRegistry, StaleVersion
from capacitron.streaming import incremental as INC

FEATURES, TARGETS = ["a", "b", "c", "d"], ["one", "two"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        a, b, d = rng.normal(1000, 50), rng.normal(0.01, 0.002), float(rng.integers(0, 3))
        y = 3 * a - 4e4 * b + 20 * d + rng.normal(0, 5)
        rows.append((i, f"client {i % 23 if i % 4 else 0}", a, None if i % 9 == 0 else b, 5.0, d, y, None if i % 5 == 0 else 100 - y / 7))
    return rows


@pytest.fixture(scope="module")
def model(spark, data):
    df = spark.createDataFrame(data, "config_id long, client_name string, a double, b double, c double, d double, one double, two double")
    middle = L.medians(df, FEATURES)
    known = L.labelled(df, FEATURES, TARGETS, middle).where("y IS NOT NULL").join(L.sides(df, TARGETS), ["target", "client_name"])
    parts = L.moments(known, len(FEATURES))
    fits, scales = L.fit(parts, TARGETS)
    return df, middle, known, parts, fits, scales


def imputed(pdf, middle):
    return np.column_stack([pdf[f].fillna(m) for f, m in zip(FEATURES, middle)])


def closed_form(x, y, scale, alpha=1.0):
    mean = x.mean(0)
    z = (x - mean) / scale
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    return y.mean(), mean, beta / scale


def test_coefficients_equal_the_closed_form(model):
    df, middle, known, parts, fits, scales = model
    pdf = known.select("config_id", "target", "y", "is_test").toPandas().merge(df.select("config_id", *FEATURES).toPandas(), on="config_id")
    assert middle == [pytest.approx(v) for v in df.toPandas()[FEATURES].median()]
    for f in fits:
        t = pdf[(pdf.target == f.target) & ~pdf.is_test]
        x, y = imputed(t, middle), t.y.to_numpy()
        scale = np.where(x.std(0) > 0, x.std(0), 1)
        base, mean, coef = closed_form(x, y, scale)
        assert scales[f.target] == pytest.approx(scale, rel=1e-8)
        assert f.base == pytest.approx(base, rel=1e-8) and f.n == len(t)
        assert f.coef == pytest.approx(coef, rel=1e-7, abs=1e-12)
        assert np.array(f.mean) + middle == pytest.approx(mean, rel=1e-8)


def test_cross_validation_equals_fits_on_the_rows(model):
    df, middle, known, parts, fits, scales = model
    pdf = known.select("config_id", "target", "y", "fold").toPandas().merge(df.select("config_id", *FEATURES).toPandas(), on="config_id")
    got = {(t, f): (n, r2) for t, f, n, r2 in L.cross_validated(parts, scales)}
    for (t, f), rows in pdf.groupby(["target", "fold"]):
        rest = pdf[(pdf.target == t) & (pdf.fold != f)]
        base, mean, coef = closed_form(imputed(rest, middle), rest.y.to_numpy(), scales[t])
        p = base + (imputed(rows, middle) - mean) @ coef
        r2 = 1 - ((rows.y - p) ** 2).sum() / ((rows.y - rows.y.mean()) ** 2).sum()
        assert got[t, f] == (len(rows), pytest.approx(r2, rel=1e-7))


def test_contributions_add_up_to_the_prediction(model):
    df, middle, known, parts, fits, scales = model
    test = known.where("is_test")
    c = L.contributions(test, fits, FEATURES, middle)
    total = c.groupBy("config_id", "target").agg((F.first("base_value") + F.sum("contribution")).alias("s"))
    j = total.join(L.predictions(test, fits).select("config_id", "target", "prediction"), ["config_id", "target"]).collect()
    assert j and all(abs(r.s - r.prediction) < 1e-6 for r in j)
    assert c.where("x IS NULL").count() == 0
    directions = {r.direction for r in ML.contribution_stats(c).collect()}
    assert directions == {"positive", "negative"}


def test_clients_stay_together_and_folds_are_balanced(model):
    df, middle, known, parts, fits, scales = model
    per = known.groupBy("target", "client_name").agg(F.count_distinct("is_test").alias("s"), F.count_distinct("fold").alias("f"), F.count("*").alias("n"))
    assert per.where("s > 1 OR f > 1").count() == 0
    for t in TARGETS:
        clients = [r.n for r in per.where(F.col("target") == t).collect()]
        held = known.where((F.col("target") == t) & F.col("is_test")).select("client_name").distinct().count()
        assert held == int(np.ceil(0.2 * len(clients)))
        folds = [r["count"] for r in known.where(F.col("target") == t).groupBy("fold").count().collect()]
        assert len(folds) == 5 and max(folds) - min(folds) <= max(clients)


def test_too_few_samples(spark, model):
    df, middle = model[0].limit(8), model[1]
    known = L.labelled(df, FEATURES, ["one"], middle).withColumn("is_test", F.lit(False)).withColumn("fold", F.lit(0))
    with pytest.raises(ValueError, match="Not enough samples for one: 8"):
        L.fit(L.moments(known, len(FEATURES)), ["one"])


def test_permutation(model):
    df, middle, known, parts, fits, scales = model
    test = known.where("is_test")
    got = {(r.target, r.feature): r for r in L.permutation_importance(test, fits, FEATURES).collect()}
    assert len(got) == 8
    one = {f: got["one", f].delta_rmse for f in FEATURES}
    assert one["a"] > one["d"] > 1 and abs(one["c"]) < 1e-9            # c is constant
    pm = ML.fit(df.withColumn("label", F.col("one")).where("label IS NOT NULL"), ["a", "d"], "ridge", regParam=0.0)
    by_pipeline = {r.feature: r for r in ML.permutation_importance(pm, df.withColumn("label", F.col("one")), ["a", "d"]).collect()}
    assert by_pipeline["a"].delta_rmse > by_pipeline["d"].delta_rmse > 0 and by_pipeline["a"].base_rmse == by_pipeline["d"].base_rmse


def test_registry_versions(spark, model, tmp_path):
    df, middle, known, parts, fits, scales = model
    reg = ModelRegistry(spark, f"{tmp_path}/models")
    assert reg.names() == [] and not reg.is_trained("one") and reg.table().count() == 0
    with pytest.raises(ValueError, match="Model not found: one"):
        reg.load("one")
    stored = L.as_dict(fits[0], FEATURES, middle)
    assert reg.register("target_one", stored, {"r2": 0.5, "none": None}, {"a": 1.0}, FEATURES, {"alpha": 1.0}, 300) == 1
    pm = ML.fit(df.withColumn("label", F.col("one")).where("label IS NOT NULL"), ["a", "d"], "ridge", regParam=0.0)
    assert reg.register("one", pm, {"r2": 0.7}, {"a": 2.0}, ["a", "d"], n_samples=400, expected=1) == 2
    with pytest.raises(StaleVersion):
        reg.register("one", stored, {}, {}, FEATURES, expected=1)
    assert reg.versions("one") == [1, 2] and reg.info("one")["metrics"] == {"r2": 0.7}
    old, info = reg.load("one", 1)                              # the older version still loads
    assert old == stored and info["hyperparameters"] == '{"alpha": 1.0}' and info["n_features"] == 4
    new, info = reg.load("one")
    assert info["model_type"] == "LinearRegressionModel" and new.transform(df.limit(3)).count() == 3
    reg.register("two", stored, {}, {}, FEATURES)
    assert reg.all_trained(TARGETS) and {(r.name, r.version) for r in reg.table(history=True).collect()} == {("one", 1), ("one", 2), ("two", 1)}
    reg.clear("one")
    assert reg.names() == ["two"] and not reg.all_trained(TARGETS)
    assert os.path.isdir(f"{tmp_path}/models/one/v1/info")      # running jobs keep their files
    assert reg.register("one", stored, {}, {}, FEATURES) == 4 and reg.versions("one") == [4]
    # a claimed number that was never published is passed over, and no reader sees it
    open(f"{tmp_path}/models/one/v5.claim", "w").close()
    assert reg.versions("one") == [4] and reg.register("one", stored, {}, {}, FEATURES) == 6
    reg.clear()
    assert reg.names() == []


def test_submissions_are_scored_with_their_own_profiles(spark, tmp_path):
    """Equal batteries and different profiles: different predictions; a replayed batch adds
    nothing; a model published in between is used from the next batch on."""
    t0 = datetime(2024, 1, 1)
    load = spark.createDataFrame([(s, t0 + timedelta(minutes=15 * i), float(s * 10 + i % 96)) for s in (1, 2) for i in range(960)],
                                 "site_id long, timestamp_utc timestamp, grid_load_kwh double")
    pv = spark.createDataFrame([(1, t0, 1.0)], "site_id long, timestamp_utc timestamp, pv_generation_kwh double")
    names = ["battery_capacity_kwh", "ts__load_kwh_mean", "ts__load_kwh_p90", "ts__generation_kwh_sum"]
    reg = ModelRegistry(spark, f"{tmp_path}/models")

    def publish(slope):
        reg.register("peak", {"base": 10.0, "features": names, "coef": [1.0, slope, 0.5, 0.0], "mean": [0.0] * 4, "median": [0.0] * 4}, {}, {}, names)
    publish(2.0)
    subs = spark.createDataFrame([(k, 100.0, 25.0, None, None, 0.5) for k in (1, 2, 3)],
                                 "submission_id long, battery_capacity double, battery_power double, pv_peak_power double, "
                                 "pv_annual_total double, pv_consumed_percentage double")
    landing, out = f"{tmp_path}/landing", f"{tmp_path}/out"
    INC.write_landing(subs, landing, "submission_id", 1)
    score = INC.submission_scorer(load, pv, reg, ["peak"])
    INC.run_scoring_stream(spark, landing, subs.schema, out, f"{tmp_path}/ckpt", score)
    first = {r.submission_id: r for r in spark.read.parquet(out).collect()}
    series = {s: pd.Series([s * 10 + i % 96 for i in range(960)]) for s in (1, 2)}
    for s, v in series.items():
        assert first[s].pred_peak == pytest.approx(10 + 100 + 2 * v.mean() + 0.5 * np.percentile(v, 90))
    assert first[1].pred_peak != first[2].pred_peak
    assert first[3].pred_peak is None and not first[3].has_profile
    INC.score_batch(out, subs, first[1]["_batch"], score)       # the batch is replayed
    again = spark.read.parquet(out).collect()
    assert sorted(r.run_key for r in again) == sorted(r.run_key for r in first.values())
    publish(3.0)
    subs.where("submission_id = 1").write.mode("append").parquet(landing)
    INC.run_scoring_stream(spark, landing, subs.schema, out, f"{tmp_path}/ckpt", score)
    rows = {(r.submission_id, r.model_versions) for r in spark.read.parquet(out).collect()}
    assert rows == {(1, "peak v1"), (2, "peak v1"), (3, "peak v1"), (1, "peak v2")}
