"""Tables that grow with the data are joined sorted: small files must not make them go to the driver."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL

from capacitron.operators import linear as L
from capacitron.operators import ml as ML
from capacitron.plans import feature_plans, ml_plans
from capacitron.sources import tables as T
from capacitron.streaming import incremental as INC


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def _sorted(df, joins):
    plan = _plan(df)
    return plan.count("SortMergeJoin") >= joins and "BroadcastHashJoin" not in plan


def test_matrix(spark):
    assert _sorted(feature_plans._matrix(spark, SF_SMALL), 6)


def test_upsert(spark, tmpdir_path):
    from capacitron.operators.features import FeatureStore
    store = FeatureStore(spark, tmpdir_path)
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "config_id long, client_name string, x double")
    store.save(rows)
    saved = []
    store.save = saved.append
    store.upsert(rows.where("config_id = 2").withColumn("x", F.lit(5.0)))
    assert _sorted(saved[0], 1)
    assert sorted(map(tuple, saved[0].collect())) == [(1, "a", 1.0), (2, "b", 5.0)]


def test_sides_and_rows_of_models(spark, monkeypatch):
    joins = []
    for module in (ML, L, ml_plans):
        monkeypatch.setattr(module, "grown", lambda *a, f=module.grown, **b: joins.append(f(*a, **b)) or joins[-1])
    ml_plans._Models(spark, SF_SMALL)
    # below the join itself there are some with a row per task or target
    assert len(joins) == 3 and all(re.search(r"\w+Join", _plan(df)).group() == "SortMergeJoin" for df in joins)


def test_permutation(spark):
    fits = [L.Fit("a", 10, 1.0, [0.0, 0.0], [1.0, -1.0])]
    rows = spark.createDataFrame([(i, "a", 1.0 * i, 1.0 * i, 2.0 - i) for i in range(9)], "config_id long, target string, y double, _u0 double, _u1 double")
    plan = _plan(L.permutation_importance(rows, fits, ["x0", "x1"]))
    assert "SortMergeJoin" in plan


@pytest.mark.parametrize("share", [0, 1])
def test_scored_batch(spark, share):
    class Registry:
        def load(self, name):
            return {"features": [], "coef": [], "mean": [], "median": [], "base": 1.0}, {"name": name, "version": 1}
    score = INC.submission_scorer(T.load_profile(spark, SF_SMALL), T.pv_profile(spark, SF_SMALL), Registry(), ["m"])
    batch = T.submissions(spark, SF_SMALL).where(F.col("submission_id") >= share)
    assert _sorted(score(batch), 5)
