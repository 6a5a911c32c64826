"""Trees packed into one table read like folders of files; built trees do not grow by small files."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from test_headers import DEEP, KPI, OUT, SERIES

from capacitron.sources import files as FI
from capacitron.sources import tree as TR

MORE = {
    "Beta (F)/02_Flex Offer Files/Run B/Input/load_config_1.yml": ["grid:", "  fees: [0.1, 0.2]", "pv:", "  - annual_kwh: 5"],
    "Beta (F)/02_Flex Offer Files/Run B/Output/kpi_summary_b.csv": ["name,value", "k,1"],
    "_tmp/Run/Output/kpi_summary_t.csv": ["name,value", "k,1"],
    "Größe 1+1/Run 2/Output/kpi_summary_ä.csv": ["name,value,ünit", "k,1,€", "l,2,€"],
    OUT + "flex_timeseries_long.csv": ["load_kwh,timestamp"] + [f"{i},2024-01-01 00:{i // 60:02}:{i % 60:02}" for i in range(600)],
}
READERS = [TR.classified, TR.result_tree, TR.nested_tree, TR.tree_profile, TR.case_counts, TR.import_preview, TR.kpi_sheets,
           TR.kpi_csv_direct, TR.timeseries, TR.params_documents, TR.quarantine, TR.import_stats]


@pytest.mark.parametrize("chars", [40, 1 << 20])
def test_packed_trees_read_like_folders(spark, tmp_path, chars):
    rows = [(p, k, line) for p, lines in {**SERIES, **KPI, **DEEP, **MORE}.items() for k, line in enumerate(lines)]
    rows = spark.createDataFrame(rows, "path string, seq long, line string")
    plain, packed = str(tmp_path / "plain"), str(tmp_path / "packed")
    FI.write_text_files(rows, plain)
    FI.write_packed_files(rows, packed, chars)
    for reader in READERS:
        got = []
        for root in (plain, packed):
            df = reader(spark, root)
            df = df.drop("modification_time", "file_types") if reader is not TR.tree_profile else df
            got.append(sorted(str(tuple(r)).replace(root, "") for r in df.collect()))
        assert got[0], reader.__name__
        assert set(got[0]) ^ set(got[1]) == set() and got[0] == got[1], reader.__name__


def test_built_trees_hold_few_files(spark, tmp_path):
    root = TR.materialize_tree(spark, SF_SMALL, str(tmp_path / "tree"))
    n = TR.result_tree(spark, root).count()
    assert n > 1000 and sum(len(f) for _, _, f in os.walk(root)) < 100
    sizes = FI.list_files(spark, root).agg(F.min("length"), F.count_distinct("path"), F.count("*")).first()
    assert sizes[0] > 0 and sizes[1] == sizes[2] > n


def test_built_sheets_hold_every_kpi_at_large_keys(spark, tmp_path):
    """Order keys beyond 2^31 / 100, and configurations of a run that share a name and so a sheet."""
    from capacitron.sources import tables as T
    more = 300_000_000
    for name in T.SOURCE_TABLES:
        df = spark.read.parquet(f"{SF_SMALL}/{name}.parquet")
        for c in {"l_orderkey", "o_orderkey"} & set(df.columns):
            df = df.withColumn(c, F.col(c) + F.lit(more).cast("long"))
        if name == "lineitem":
            df = df.withColumn("l_quantity", F.when(F.col("l_linenumber").isin(2, 3), 20.0).otherwise(F.col("l_quantity")))
        df.write.parquet(f"{tmp_path}/sf/{name}.parquet")
    sf = f"{tmp_path}/sf"
    root = TR.materialize_tree(spark, sf, f"{tmp_path}/tree")
    configs = T.battery_configs(spark, sf).join(T.runs(spark, sf).select("run_id", "run_name"), "run_id")
    # a sheet's last value of a KPI: that of the configuration with the largest id, one more for the first KPI of line 2
    value = F.col("kpi_value") + F.when((F.col("config_id") % 10 == 2) & (F.col("kpi_id") % 10 == 1), 1).otherwise(0)
    place = F.when((F.col("config_id") % 10 == 2) & (F.col("kpi_id") % 10 == 1), F.lit(1 << 62)).otherwise(F.col("kpi_id"))
    want = T.kpi_summary(spark, sf).join(configs.select("config_id", "run_name", "config_name"), "config_id") \
        .groupBy("run_name", "config_name", "kpi_name").agg(F.max_by(value, place).alias("kpi_value"))
    got = TR.kpi_sheets(spark, root).select(F.regexp_extract("run_name", "^Run_[0-9]+", 0).alias("run_name"), "config_name", "kpi_name", "kpi_value")
    assert want.count() > 10_000 and got.count() == want.count()
    assert got.join(want, ["run_name", "config_name", "kpi_name", "kpi_value"]).count() == want.count()


def test_readers_of_one_kind_pass_over_the_others(spark, tmp_path):
    """Files are named in a column of their own, whose statistics the scan of one kind can use, and
    what a header decides is found per file, not per line."""
    root = TR.materialize_tree(spark, SF_SMALL, str(tmp_path / "tree"))
    plan = TR.timeseries(spark, root)._jdf.queryExecution().toString()
    assert "StringStartsWith(name,flex_timeseries)" in plan
    direct = TR.kpi_csv_direct(spark, root)._jdf.queryExecution().optimizedPlan().toString()
    assert direct.count("sequence(0") == 2                     # own lines, and those of further pieces


@pytest.mark.parametrize("glob", ["kpi_summary*.csv", "*.{json,yml,yaml}", "kpi_?.csv", "a*b*.csv", "kpi.csv"])
def test_name_globs(spark, glob):
    names = ["kpi_summary.csv", "kpi_summary_a.csv", "xkpi_summary.csv", "kpi_a.csv", "kpi.csv", "akpi.csv", "a.json", ".yml", "b.yaml", "ab.csv", "axxby.csv", "kpi_summary.cs"]
    import fnmatch
    each = [glob.replace("{json,yml,yaml}", e) for e in ("json", "yml", "yaml")]
    got = {r.name for r in spark.createDataFrame([(n,) for n in names], "name string").where(FI._named_like(glob)).collect()}
    assert got == {n for n in names if any(fnmatch.fnmatchcase(n, e) for e in each)}
