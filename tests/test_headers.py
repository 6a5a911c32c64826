"""Ingest by each file's own header: permuted, extra and missing columns, odd times, any depth."""

import datetime as dt

import pytest

from capacitron.sources import headers as H
from capacitron.sources import tree as TR
from capacitron.sources import uploads as U
from capacitron.sources.files import write_text_files


def tree(spark, root, files):
    rows = [(path, k, line) for path, lines in files.items() for k, line in enumerate(lines)]
    write_text_files(spark.createDataFrame(rows, "path string, seq long, line string"), str(root))
    return str(root)


OUT = "Acme/Run 1/Output/"
SERIES = {
    OUT + "flex_timeseries_a.csv": ["timestamp,generation_kwh,load_kwh", "2024-01-01 00:00:00,9.0,1.5"],
    OUT + "flex_timeseries_b.csv": ["soc_percent,timestamp,load_kwh", "50,2024-01-01T00:15:00Z,2.5", "51,when,3"],
    OUT + "flex_timeseries_c.csv": ["﻿Load_kWh, TimeStamp ,note", '"7,5",2024-01-01 01:00:00+01:00,"say ""x"", y"', "1e1,01.02.2024 03:30,"],
    OUT + "flex_timeseries_d.csv": ["load_kwh,power_kw", "1,2"],
    OUT + "flex_timeseries_e.csv": ["", "  ", "date,load_kwh,load_kwh", "2024-03-01,4,5", "2024-03-02"],
    OUT + "flex_timeseries_f.csv": [""],
}


def test_series_columns_by_name(spark, tmp_path):
    got = {(r.config_name, str(r.timestamp)): r for r in TR.timeseries(spark, tree(spark, tmp_path, SERIES)).collect()}
    assert len(got) == 6
    a = got["a", "2024-01-01 00:00:00"]
    assert (a.load_kwh, a.generation_kwh, a.soc_percent, a.extra) == (1.5, 9.0, None, None)
    b = got["b", "2024-01-01 00:15:00"]
    assert (b.load_kwh, b.generation_kwh, b.soc_percent) == (2.5, None, 50.0)
    c = got["c", "2024-01-01 00:00:00"]
    assert (c.load_kwh, c.extra) == (None, '{"note":"say \\"x\\", y"}')
    assert got["c", "2024-02-01 03:30:00"].load_kwh == 10.0
    assert got["e", "2024-03-01 00:00:00"].load_kwh == 4.0 and got["e", "2024-03-02 00:00:00"].load_kwh is None


def test_one_pass_over_lines_in_blocks(spark, tmp_path):
    """A file of many blocks: the header applies to all of them, rows keep their order."""
    n = 30_000
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    lines = ["load_kwh,timestamp"] + [f"{i},{dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)}" for i in range(n)]
    root = tree(spark, tmp_path, {OUT + "flex_timeseries_x.csv": lines, OUT + "flex_timeseries_y.csv": lines[:2]})
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
        text = H.lines(spark, root)
        assert text.select("block").distinct().count() > 10
        got = TR.timeseries(spark, root).selectExpr(
            "count(*)", "sum(load_kwh)", "count_if(unix_timestamp(timestamp) - 1704067200 = load_kwh * 60)").first()
        assert tuple(got) == (n + 1, n * (n - 1) / 2, n + 1)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


KPI = {
    OUT + "kpi_summary_a.csv": ["kpi_unit,kpi_value,kpi_name", "EUR,5,cost", "EUR,6,cost", ",x,other", "EUR,1,"],
    OUT + "kpi_summary_b.csv": ["id,Name,note,Value", "1,cost,n,7"],
    OUT + "kpi_summary_c.csv": ["what,how much", "cost,8"],
    OUT + "kpi_summary_d.csv": ["value,what", "9,cost"],
    OUT + "kpi_summary_e.csv": ["single", "1"],
    OUT + "kpi_summary_f.csv": ["unit,kpi,value,extra", "EUR,cost,10,z", "EUR,share,nan,z"],
}


def test_kpi_columns_by_name(spark, tmp_path):
    root = tree(spark, tmp_path, KPI)
    got = {(r.config_name, r.kpi_name): (r.kpi_value, r.kpi_unit) for r in TR.kpi_sheets(spark, root).collect()}
    assert got == {("a", "cost"): (6.0, "EUR"), ("b", "cost"): (7.0, None), ("c", "cost"): (8.0, None),
                   ("d", "cost"): (9.0, None), ("f", "cost"): (10.0, "EUR")}
    raw = TR.kpi_csv_direct(spark, root).collect()
    assert len(raw) == 10 and {r.extra for r in raw} == {None, '{"id":"1","note":"n"}', '{"extra":"z"}'}


DEEP = {
    "Client A/kpi_summary_out.csv": ["name,value", "k,1"],
    "Client A/Output/kpi_summary_three.csv": ["name,value", "k,1"],
    "Client A/x/y/z/Run 9/Output/kpi_summary_seven.csv": ["name,value", "k,1", "k,2", "bad,?"],
    "Client A/x/y/z/Run 9/Output/flex_timeseries_seven.csv": ["time,load_kwh", "2024-01-01,1", "?,1"],
    "Client A/x/y/w/Run 9/Output/kpi_summary_seven.csv": ["name", "k"],
    "Client A/Run 1/Input/parameters.json": ["{}"],
    "Client A/Run 1/Output/notes.txt": ["x"],
    "Client A/Run 1/Output/kpi_summary.xlsx": ["x"],
    "Client A/Run 1/Output/kpi_summary_empty.csv": [""],
    "Client A/.git/Run/Output/kpi_summary_h.csv": ["name,value", "k,1"],
    "top.csv": ["name,value"],
}


def test_any_depth_and_counted_quarantine(spark, tmp_path):
    """Spark lists no name that begins with a dot; everything else is found."""
    root = tree(spark, tmp_path, DEEP)
    m = {r.metric: r.value for r in TR.import_stats(spark, root).collect()}
    assert m["files_found"] == len(DEEP) - 1 == m["files_imported"] + m["files_skipped"]
    assert m["kpi_rows_found"] == m["kpi_rows_imported"] + m["kpi_rows_skipped"] == 4
    assert m["series_rows_found"] == m["series_rows_imported"] + m["series_rows_skipped"] == 2
    assert {k[len("skipped "):]: v for k, v in m.items() if k.startswith("skipped ")} == {
        "file: outside a run folder": 2, "file: no KPI sheet or series": 1, "file: not a readable sheet": 1,
        "file: empty": 1, "file: fewer than two columns": 1, "row: value not numeric": 1, "row: replaced by a later row": 1,
        "row: time not readable": 1}
    runs = sorted((r.client_name, r.run_name, r.n_kpi, r.n_timeseries) for r in TR.case_counts(spark, root).collect())
    assert runs == [("Client A", "Client A", 1, 0), ("Client A", "Run 1", 2, 0), ("Client A", "Run 9", 1, 0), ("Client A", "Run 9", 1, 1)]
    p = TR.tree_profile(spark, root).collect()
    assert [(r.client_name, r.n_runs, r.n_configs, r.n_outside_runs, r.has_input, r.file_types) for r in p] == [
        ("Client A", 4, 5, 1, True, '{".csv":6,".json":1,".txt":1,".xlsx":1}')]


LOADS = {
    "a.csv": ["value kwh,id,timestamp", "1.5,7,2024-01-01T00:00:00", "-2,7,2024-01-01 00:15:00", "n/a,7,1.1.24"],
    "b.csv": ["timestamp_utc,value,timestamp", "2024-01-01 00:00:00+01:00,3,x"],
    "c.csv": ["time,kwh", "2024-01-01 00:00:00,3"],
    "d.csv": ["value kwh,value", "1,2"],
    "e.csv": [""],
}


def test_load_files_by_name(spark, tmp_path):
    root = tree(spark, tmp_path, LOADS)
    got = sorted(((r.file.rsplit("/", 1)[1], str(r.timestamp_utc), r.grid_load_kwh) for r in U.load_files(spark, root).collect()))
    assert got == [("a.csv", "2024-01-01 00:00:00", 1.5), ("a.csv", "2024-01-01 00:15:00", 0.0), ("a.csv", "None", None),
                   ("b.csv", "2023-12-31 23:00:00", 3.0)]
    bad = {r.file.rsplit("/", 1)[1]: (r.missing, r.found) for r in U.invalid_files(spark, root, "load").collect()}
    assert bad == {"c.csv": ("timestamp, value kwh", "time, kwh"), "d.csv": ("timestamp", "value kwh, value"),
                   "e.csv": ("timestamp, value kwh", "")}


def test_preprocessed_columns_and_alias(spark, tmp_path):
    root = tree(spark, tmp_path, {"a.csv": ["pv_load_kwh,consumption_load_kwh,grid_load_kwh,timestamp_utc", "1,2,3,2024-01-01"],
                                  "b.csv": ["timestamp_utc,consumption_kwh", "2024-01-01,1"]})
    got = [tuple(r)[1:] for r in U.preprocessed_files(spark, root).collect()]
    assert got == [(dt.datetime(2024, 1, 1), 3.0, 1.0, 2.0)]
    bad = [(r.kind, r.missing) for r in U.invalid_files(spark, root, "preprocessed").collect()]
    assert bad == [("preprocessed", "grid_load_kwh, pv_load_kwh")]


@pytest.mark.parametrize("what", ["timeseries", "kpi_sheets", "kpi_csv_direct", "import_stats", "case_counts"])
def test_empty_tree(spark, tmp_path, what):
    assert getattr(TR, what)(spark, str(tmp_path)).count() >= 0
