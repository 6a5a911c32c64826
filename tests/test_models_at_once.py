"""Models of the targets are trained side by side, on a training set prepared once."""

import threading

from pyspark.sql import functions as F

from conftest import SF_SMALL

from capacitron.operators import ml as ML
from capacitron.plans import mllib_plans as MP


def test_targets_are_trained_side_by_side(spark, monkeypatch):
    meet = threading.Barrier(len(MP.TARGETS), timeout=60)     # breaks if they come one after the other

    def train(spark, sf, target, model, **params):
        meet.wait()
        d = spark.range(4).select((F.col("id") == 0).alias("is_test"))
        return None, [], d, {"n": 1, "r2": 0.5, "mae": 1.0, "rmse": 2.0}
    monkeypatch.setattr(MP, "_train", train)
    got = MP.ml_train_gbt(spark, SF_SMALL).collect()
    assert [r.target for r in got] == MP.TARGETS and {r.n_train for r in got} == {3}


def test_training_set_is_prepared_once(spark, monkeypatch):
    made = []
    split = ML.group_split
    monkeypatch.setattr(ML, "group_split", lambda *a, **k: made.append(1) or split(*a, **k))
    monkeypatch.setattr(MP, "memo", lambda spark, key, build, seen={}: seen[key] if key in seen else seen.setdefault(key, build()))
    t = MP.TARGETS[0]
    d, feats, front = MP._split(spark, SF_SMALL, t)
    pm, *_ = MP._train(spark, SF_SMALL, t, "gbt", maxIter=2)
    assert len(made) == 1
    # the shared stages change nothing: the whole pipeline gives the same trees
    whole = ML.fit(d.filter(~F.col("is_test")), feats, "gbt", maxIter=2)
    assert whole.stages[-1].toDebugString.split("\n")[1:] == pm.stages[-1].toDebugString.split("\n")[1:]


def test_matrix_brings_configurations_together_once(spark):
    """The configurations are read for their benefits and for the baselines, not a third time."""
    from capacitron.plans.feature_plans import _matrix
    plan = _matrix(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [" in line and "battery_efficiency" in line for line in plan.split("\n")) == 2


def test_matrix_keeps_configurations_of_runs_without_a_baseline(spark):
    from capacitron.operators import features as FT
    configs = spark.createDataFrame([(11, 1, "no_battery", True, 0.0, 0.0, 0.9), (12, 1, "5kWh", False, 5.0, 2.0, 0.8), (22, 2, "7kWh", False, 7.0, 3.0, 0.7)],
                                    "config_id long, run_id long, config_name string, is_baseline boolean, battery_capacity_kwh double, battery_power_kw double, battery_efficiency double")
    kpis = spark.createDataFrame([(c, "annual_total_grid_fee_cost_ic", v) for c, v in ((11, 10.0), (12, 4.0), (22, 3.0))], "config_id long, kpi_name string, kpi_value double")
    runs = spark.createDataFrame([(1, 7, "a"), (2, 7, "b")], "run_id long, client_id long, run_name string")
    clients = spark.createDataFrame([(7, "c")], "client_id long, client_name string")
    series = spark.createDataFrame([(7, "2024-01-01 00:00:00", 1.0, 2.0, 0.5)], "config_id long, timestamp string, load_kwh double, generation_kwh double, grid_export_kwh double") \
        .withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    got = FT.matrix(configs, kpis, runs, clients, series).orderBy("config_id").select("config_id", "battery_efficiency", "target").collect()
    assert [tuple(r) for r in got] == [(12, 0.8, 6.0), (22, 0.7, None)]


def test_model_rows_are_stored_with_their_sides(spark):
    """Fits and queries read these rows many times; none of them joins the matrix with its clients again."""
    from capacitron.plans.ml_plans import _models
    assert "Join" not in _models(spark, SF_SMALL).known._jdf.queryExecution().optimizedPlan().toString()
