"""Contributions ranked and read within their row; a grid search prepares each training set once."""

import random

import pytest

from conftest import SF_SMALL

import __spark_entry__ as E
from capacitron.operators import linear as L
from capacitron.operators import ml as ML

Q = E.queries()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["top_contributions", "ml_dependence", "ml_explain_row"])
def test_contributions_of_a_row_meet_without_a_shuffle(spark, name):
    plan = _plan(Q[name](spark, SF_SMALL))
    # the one join gives a configuration its client's side; no window, aggregate or self join after it
    assert "Window" not in plan and "Aggregate" not in plan and plan.count("Join ") == 1


def test_largest_contributions_with_ties(spark):
    fits = [L.Fit("a", 10, 1.0, [0.0, 0.0, 0.0], [1.0, -1.0, 0.5]), L.Fit("b", 10, 2.0, [1.0, 0.0, 0.0], [1.0, 0.0, 3.0])]
    rows = spark.createDataFrame([(1, "c", "a", 0.0, 2.0, 2.0, 1.0), (1, "c", "b", 0.0, 1.0, 5.0, -1.0)],
                                 "config_id long, client_name string, target string, y double, _u0 double, _u1 double, _u2 double")
    wide = L.contributions(rows, fits, ["x2", "x1", "x0"], [10.0, 0.0, 0.0], wide=True)
    got = [(r.target, r.rank, r.feature, r.x, r.contribution, r.direction) for r in ML.top_contributions(wide, 2).orderBy("target", "rank").collect()]
    assert got == [("a", 1, "x1", 2.0, -2.0, "decreases"), ("a", 2, "x2", 12.0, 2.0, "increases"),
                   ("b", 1, "x0", -1.0, -3.0, "decreases"), ("b", 2, "x1", 5.0, 0.0, "decreases")]
    long = {(r.target, r.feature): (r.x, r.contribution, r.base_value) for r in L.contributions(rows, fits, ["x2", "x1", "x0"], [10.0, 0.0, 0.0]).collect()}
    assert long == {(r.target, s.feature): (s.x, s.contribution, r.base_value) for r in wide.collect() for s in r.contribs}


def test_sides_by_client_keep_rows(spark):
    sides = spark.createDataFrame([("a", "c1", True, 0), ("b", "c1", False, 1), ("a", "c2", False, 2)], "target string, client_name string, is_test boolean, fold int")
    got = {r.client_name: {t: tuple(s) for t, s in r._sides.items()} for r in L.by_client(sides).collect()}
    assert got == {"c1": {"a": (True, 0), "b": (False, 1)}, "c2": {"a": (False, 2)}}


def test_grid_search_prepares_each_training_set_once(spark, monkeypatch):
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import Imputer
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    rnd = random.Random(3)
    data = spark.createDataFrame([(None if i % 7 == 0 else rnd.random(), rnd.random() * 9, rnd.random() + i % 5, i % 3) for i in range(300)],
                                 "a double, b double, label double, fold int")
    fits = []
    plain_fit = Imputer._fit
    monkeypatch.setattr(Imputer, "_fit", lambda self, d: fits.append(1) or plain_fit(self, d))
    scores, prepared = [], []
    for shared in (False, True):
        pipe = ML.pipeline(["a", "b"], "ridge")
        lr = pipe.getStages()[-1]
        grid = ParamGridBuilder().addGrid(lr.regParam, [0.01, 0.5, 20.0, 90.0]).build()
        cv = CrossValidator(estimator=ML.shared_pipeline(pipe) if shared else pipe, estimatorParamMaps=grid, foldCol="fold", numFolds=3,
                            evaluator=RegressionEvaluator(labelCol="label", metricName="r2"), parallelism=4 if shared else 1)
        before = len(fits)
        scores.append(cv.fit(data).avgMetrics)
        prepared.append(len(fits) - before)
    assert scores[1] == pytest.approx(scores[0], abs=1e-12) and len(set(scores[0])) == 4
    assert prepared == [3 * 4 + 1, 3 + 1]
