"""The stored warehouse tables and what is built on them at size."""

import glob

from conftest import SF_SMALL

from capacitron.operators import warehouse as W
from capacitron.plans.registry import load_all
from capacitron.session import checkpoint_dir
from capacitron.sources import store


def test_stored_tables_shuffle_the_aggregate_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "model_root", lambda spark, sf: str(tmp_path / "model"))
    spark.sparkContext.setJobGroup("stored-model", "")
    try:
        root = store.materialize_model(spark, SF_SMALL)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    track = spark.sparkContext.statusTracker()
    wrote = [j for j in track.getJobIdsForGroup("stored-model")]
    assert sum(len(track.getJobInfo(j).stageIds) > 1 for j in wrote) <= 1
    assert len(wrote) <= 12
    groups, configs, kpis = (spark.read.parquet(f"{root}/{t}").count() for t in ("_config_groups", "battery_configs", "kpi_summary"))
    assert groups == configs and 3 * configs <= kpis <= 4 * configs


def test_catalogue_tasks_follow_the_rows(spark, monkeypatch):
    rows = [(f"k{i % 3}", i // 4, float(i)) for i in range(400)] + [("k0", None, 1.0), ("k1", 1, None), ("k9", 7, None)]
    kpis = spark.createDataFrame(rows, "kpi_name string, config_id long, kpi_value double")
    monkeypatch.setattr(W, "CATALOGUE_ROWS", 50, raising=False)
    got = W.kpi_catalogue(kpis)
    kpis.createOrReplaceTempView("catalogue_rows")
    want = spark.sql("SELECT kpi_name, count(DISTINCT config_id) n_configs, avg(kpi_value) avg_value, min(kpi_value) min_value, "
                     "max(kpi_value) max_value FROM catalogue_rows GROUP BY kpi_name")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # 403 rows in tasks of 50: the groups of (KPI, configuration) are dealt out by configuration
    assert "hashpartitioning(config_id" in got._jdf.queryExecution().toString() and "REPARTITION_BY_NUM" in got._jdf.queryExecution().toString()


def test_json_records_are_compressed(spark):
    q, _ = load_all()
    before = set(glob.glob(f"{checkpoint_dir(spark)}/json-*"))
    got = q["snk_json_records"](spark, SF_SMALL)
    new, = set(glob.glob(f"{checkpoint_dir(spark)}/json-*")) - before
    assert glob.glob(f"{new}/*.json.gz") and not glob.glob(f"{new}/*.json")
    assert got.count() == q["ft_matrix"](spark, SF_SMALL).count()


def test_merges_go_through_new_rows_once(spark, tmp_path):
    from capacitron.operators.snapshots import SnapshotTable
    table, seen = SnapshotTable(spark, str(tmp_path / "table"), ["k"]), spark.sparkContext.accumulator(0)

    def rows(shift):
        def counted(it):
            for pdf in it:
                seen.add(len(pdf))
                yield pdf
        return spark.range(1000).selectExpr("id AS k", f"id + {shift} AS v").mapInPandas(counted, "k long, v long")
    table.merge(rows(0))
    seen.value = 0
    assert table.merge(rows(1)) == 2 and seen.value == 1000
    assert table.merge(rows(1)) is None and seen.value == 2000
    assert table.versions() == [(1, False), (2, False)]
    assert table.read().where("v = k + 1").count() == 1000
