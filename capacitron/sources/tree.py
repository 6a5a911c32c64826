"""Result-folder trees: build one from the model tables, and ingest any tree.

Layout (reference): ``Client/Run/Input/{parameters.json|load_config*.yml}`` and
``Client/Run/Output/{kpi_summary*.csv, flex_timeseries*.csv}``; nested variant
``Client (F)/02_Flex Offer Files/Run/...`` (SURVEY §2.1 src_*).

``materialize_tree`` writes such a tree under the shared scratch folder from the
driver tables (one KPI sheet per configuration, one series file per configuration of a
client with load data, with its share of the client's readings, and a parameters document
per run), once for each state of those tables; its files, several per configuration, are packed
into one table (``files.write_packed_files``).  The walkers only list paths (``binaryFile`` with
content pruned, or the table's paths) and parse components with regular expressions; sheets and
series are read as lines, with the path naming the configuration.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.ranking import ranked
from ..session import scratch_path
from . import headers as H
from . import tables as T
from .files import PACK_FILES, decoded_path, exists, list_files, packed_files, relative_path, touch, write_packed_files

NESTED_FOLDER = "02_Flex Offer Files"
SERIES_HEADER = "timestamp,load_kwh,generation_kwh,soc_percent,power_kw,grid_import_kwh,grid_export_kwh"
_FIRST, _LAST = -(1 << 63), (1 << 63) - 1      # places before and after every other line of a file
PARAM_FILES = ["parameters.json", "config.json", "params.json"]   # priority order, then YAML


def tree_root(spark, sf_dir: str) -> str:
    return scratch_path(spark, f"result-tree-{T.tag(spark, sf_dir)}")


def _fmt(c):
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def materialize_tree(spark, sf_dir: str, root: str | None = None) -> str:
    """Write the tree (idempotent: skipped when its ``_SUCCESS`` marker exists)."""
    root = root or tree_root(spark, sf_dir)
    if exists(root, "_SUCCESS"):
        return root
    runs = T.runs(spark, sf_dir, F.col("o_orderpriority"))
    cust = T.read(spark, sf_dir, "customer")
    seg, name = F.col("c_mktsegment"), F.col("c_name")
    nested = seg == "AUTOMOBILE"
    client_dir = (F.when(F.col("c_acctbal") < 0, F.concat(F.lit("00_"), name))
                  .when(nested, F.concat(name, F.lit(" (F)"), F.lit("/" + NESTED_FOLDER)))
                  .when(seg == "MACHINERY", F.concat(name, F.lit(" - Batterie")))
                  .otherwise(name))
    d = F.col("run_date")
    run_dir = F.concat(F.col("run_name"), F.lit(" "), F.dayofmonth(d).cast("string"), F.lit("."),
                       F.month(d).cast("string"), F.lit("."), F.year(d).cast("string"))
    rc = (runs.join(cust, F.col("client_id") == F.col("c_custkey"))
          .select("run_id", "client_id", F.concat(client_dir, F.lit("/"), run_dir).alias("run_path"),
                  "input_parameters", "run_value", "o_orderpriority"))
    stamped = (F.col("run_id") % 2) == 0
    numbers = [f"kpi_{k}" for k in range(1, 5)]
    cfg = T.battery_configs(spark, sf_dir, None, *[v.alias(c) for v, c in zip(T.kpi_numbers(), numbers)]).select(
        "config_id", "run_id", "config_name", "is_baseline", *numbers)
    c = cfg.join(rc.select("run_id", "client_id", "run_path", F.col("o_orderpriority").startswith("3").alias("vb")), "run_id")
    fname = F.concat(F.lit("kpi_summary_"),
                     F.when(stamped, F.concat(F.date_format(F.lit("2024-01-05 10:15:00").cast("timestamp"),
                                                            "yyyyMMdd_HHmmss"), F.lit("_"))).otherwise(F.lit("")),
                     F.col("config_name"), F.lit(".csv"))
    # configurations of a run that share a name share a sheet
    c = c.withColumn("sharing", F.count(F.lit(1)).over(Window.partitionBy("run_id", "config_name")))
    # three kinds of files are made from these rows: written once
    path = scratch_path(spark, f"tree-configs-{uuid.uuid4().hex}")
    c.write.option("maxRecordsPerFile", PACK_FILES).parquet(path)
    c = spark.read.parquet(path).withColumn("kpi_path", F.concat("run_path", F.lit("/Output/"), fname))
    kpis = T.kpi_structs([F.col(x) for x in numbers])

    # a sheet: header, a line per KPI that has a value, for some a KPI again and a line without a number
    def kpi_line(k, more=0):
        val = (k["kpi_value"] + more if more else k["kpi_value"]).cast("string")
        return F.when(F.col("vb"), F.concat_ws(",", k["kpi_name"], val)).otherwise(F.concat_ws(",", k["kpi_name"], val, k["kpi_unit"]))
    header = F.when(F.col("vb"), F.lit("Name,Value")).otherwise(F.lit("kpi_name,kpi_value,kpi_unit"))
    junk = F.when(F.col("vb"), F.lit("status,False")).otherwise(F.lit("status,['none'],"))
    known = F.filter(F.array(*kpis), lambda k: k["kpi_value"].isNotNull())
    again = F.filter(known, lambda k: (F.col("config_id") % 10 == 2) & (k["k"] == 1))
    parts = [(F.array(header), lambda i: F.lit(_FIRST)),
             (F.transform(known, lambda k: kpi_line(k)), lambda i: F.col("config_id") * 10 + F.get(known, i)["k"]),
             (F.transform(again, lambda k: kpi_line(k, 1)), lambda i: F.lit(_LAST - 1)),
             (F.filter(F.array(junk), lambda x: F.col("is_baseline")), lambda i: F.lit(_LAST))]
    # the same lines put together column by column for the sheets of one configuration, nearly all
    def if_given(text, given):
        return F.when(given, F.concat(text, F.lit("\n"))).otherwise(F.lit(""))
    own = F.concat(header, F.lit("\n"), *[if_given(kpi_line(k), F.col(x).isNotNull()) for k, x in zip(kpis, numbers)],
                   if_given(kpi_line(kpis[0], 1), (F.col("config_id") % 10 == 2) & F.col(numbers[0]).isNotNull()), if_given(junk, F.col("is_baseline")))
    sheets = c.where("sharing = 1 AND kpi_path IS NOT NULL").select(F.col("kpi_path").alias("path"), own.alias("content"))

    def placed(lines, at):
        return F.transform(lines, lambda x, i: F.struct(at(i).alias("seq"), x.alias("line")))
    shared = c.where("sharing > 1").select(F.col("kpi_path").alias("path"), F.inline(F.concat(*[placed(lines, at) for lines, at in parts])))
    # series files: the readings of a client are dealt out among its configurations
    ser = T.series_events(spark, sf_dir).withColumnRenamed("config_id", "client_id")
    sc = c.select("client_id", "config_id", F.concat("run_path", F.lit("/Output/flex_timeseries_outputs_"),
                                                     F.col("config_name"), F.lit(".csv")).alias("path"))
    sc = ranked(sc.join(ser.select("client_id").distinct(), "client_id"), ["config_id"], "place", ["client_id"])
    sh = sc.select("path", F.lit(_FIRST).alias("seq"), F.lit(SERIES_HEADER).alias("line"))
    dealt = ser.join(sc.groupBy("client_id").agg(F.count("*").alias("n_configs")), "client_id") \
        .withColumn("place", F.pmod(F.xxhash64("timestamp"), F.col("n_configs")))
    sl = dealt.join(sc.select("client_id", "place", "path"), ["client_id", "place"]).select(
        "path", (F.unix_micros(F.col("timestamp").cast("timestamp")) - 1704067200000000).alias("seq"),
        F.concat_ws(",", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), _fmt("load_kwh"), _fmt("generation_kwh"),
                    _fmt("soc_percent"), _fmt("power_kw"), _fmt("grid_import_kwh"), _fmt("grid_export_kwh")).alias("line"))
    # run parameters: JSON for most runs, a YAML run configuration for HIGH priority runs
    yaml_run = F.col("o_orderpriority").startswith("2")
    pj = rc.filter(~yaml_run).select(F.concat("run_path", F.lit("/Input/parameters.json")).alias("path"), F.array("input_parameters").alias("lines"))
    ylines = [
        "microgrid:", "  battery:", "    - model: generic", "      init_state: {init}",
        "  pv:", "    - annual_kwh: {pv}", "      pv_is_generic: true",
        "grid_parameters:", "  max_abs_grid_load_pos: {cap}", "  static_grid_fees: [0.11, 0.22]",
        "  peak_window_months: [[1, 2, 12], []]",
        "  peak_window_times: [[[\"7:45\", \"9:00\"], [\"16:45\", \"20:00\"]], []]",
        "time_parameters:", "  start_date: '2024-01-01 00:00:00+00:00'",
    ]
    texts = []
    for tpl in ylines:
        line = F.lit(tpl)
        if "{init}" in tpl:
            line = F.concat(F.lit(tpl.split("{init}")[0]), (F.col("run_id") % 10 / 10).cast("string"))
        elif "{pv}" in tpl:
            line = F.concat(F.lit(tpl.split("{pv}")[0]), F.floor(F.col("run_value") * 10).cast("string"))
        elif "{cap}" in tpl:
            line = F.concat(F.lit(tpl.split("{cap}")[0]), F.floor(F.col("run_value") / 100).cast("string"))
        texts.append(line)
    py = rc.filter(yaml_run).select(F.concat("run_path", F.lit("/Input/load_config_"), F.col("run_id").cast("string"), F.lit(".yml")).alias("path"),
                                    F.array(*texts).alias("lines"))
    params = pj.unionByName(py).where("path IS NOT NULL").select(
        "path", F.concat(F.array_join("lines", "\n", ""), F.lit("\n")).alias("content"))
    write_packed_files(shared.unionByName(sh).unionByName(sl), root, whole=sheets.unionByName(params))
    touch(root, "_SUCCESS")
    return root


# ---------------------------------------------------------------------------
# Walkers
# ---------------------------------------------------------------------------
def _layout(files: DataFrame) -> DataFrame:
    """Every listed file with its client (first folder), run and section, at any depth.

    A file belongs to a run when its folder is ``Input`` or ``Output``; the run is the folder
    above (the client itself in ``Client/Output/file``).  ``layout`` is ``flat``
    (``Client/Run/X/file``), ``nested`` (``Client/02_.../Run/X/file``) or ``other``; ``skipped``
    says why a file is no part of a run (null if it is)."""
    p = F.col("parts")
    n = F.size(p)
    section = F.when(n >= 3, F.get(p, n - 2))
    in_run = F.coalesce(section.isin("Input", "Output"), F.lit(False))
    hidden = F.exists(p, lambda s: s.startswith("."))
    run = F.when(in_run, F.get(p, F.greatest(n - 3, F.lit(0))))
    return files.select(
        "path", "name", "modification_time", "length",
        F.when((n == 5) & (p[1] == NESTED_FOLDER), F.lit("nested")).when(n == 4, F.lit("flat")).otherwise(F.lit("other")).alias("layout"),
        F.when(n >= 2, p[0]).alias("client_folder"), run.alias("run_folder"),
        F.when(in_run, F.array_join(F.slice(p, F.lit(1), F.greatest(n - 2, F.lit(1))), "/")).alias("run_path"),
        F.when(in_run, section).alias("section"),
        F.when(hidden, F.lit("hidden")).when(~in_run, F.lit("outside a run folder")).alias("skipped"))


def _client_run(path, root: str) -> tuple:
    """Client folder and run folder of a file by the rule of :func:`_layout`."""
    p = F.split(relative_path(path, root), "/")
    n = F.size(p)
    return (F.when(n >= 2, F.get(p, F.lit(0))).alias("client_name"),
            F.when(n >= 3, F.get(p, F.greatest(n - 3, F.lit(0)))).alias("run_name"))


def classified(spark, root: str) -> DataFrame:
    """All files of a tree, at any depth, with client / run / section / kind / config name; those
    that are not imported with the reason (``skipped``)."""
    f = _layout(list_files(spark, root))
    kind = F.when(F.col("section") == "Output", S.output_kind("name")).when(F.col("section") == "Input", F.lit("input"))
    f = f.select("*", kind.alias("kind"), S.config_name_from_file("name").alias("config_name"),
                 S.clean_client("client_folder").alias("client_name"))
    odd = F.when((F.col("section") == "Output") & ~F.coalesce(F.col("kind").isin("kpi", "timeseries"), F.lit(False)),
                 F.lit("no KPI sheet or series"))
    return f.withColumn("skipped", F.coalesce("skipped", odd))


def scan(spark, root: str) -> DataFrame:
    """The files of runs: :func:`classified` without those outside a run folder or hidden."""
    return classified(spark, root).where("run_path IS NOT NULL AND NOT coalesce(skipped, '') = 'hidden'")


def result_tree(spark, root: str) -> DataFrame:
    """src_result_tree: (client, run, config, kind, path) of flat-layout output files."""
    s = scan(spark, root)
    return s.filter((F.col("layout") == "flat") & F.col("kind").isin("kpi", "timeseries")).select(
        "client_name", F.col("run_folder").alias("run_name"), "config_name", "kind", "path")


def nested_tree(spark, root: str) -> DataFrame:
    """src_nested_tree: nested layout, skip patterns applied, runs with output files only."""
    s = scan(spark, root).filter((F.col("layout") == "nested") & ~S.skipped_folder(F.col("client_folder")))
    out = s.filter(F.col("kind").isin("kpi", "timeseries"))
    runs_ok = out.select("client_folder", "run_folder").distinct()
    return (out.join(runs_ok, ["client_folder", "run_folder"], "left_semi")
            .select("client_name", F.col("run_folder").alias("run_name"), "config_name", "kind", "path"))


def tree_profile(spark, root: str) -> DataFrame:
    """src_tree_profile: per client runs, configs, file counts by kind, has-input flag, and the
    number of files of every extension at any depth (those outside run folders included)."""
    s = classified(spark, root).where("client_name IS NOT NULL AND NOT coalesce(skipped, '') = 'hidden'")
    out = F.col("kind").isin("kpi", "timeseries")
    # a row per configuration (one per run for all that is none), then per run, then per client
    configs = s.groupBy("client_name", "run_path", F.when(out, F.col("config_name")).alias("_config")).agg(
        F.count_if(F.col("kind") == "kpi").alias("_kpi"), F.count_if(F.col("kind") == "timeseries").alias("_series"),
        F.count_if(F.col("run_path").isNull()).alias("_outside"), F.max((F.col("section") == "Input").cast("int")).alias("_input"))
    runs = configs.groupBy("client_name", "run_path").agg(
        F.count("_config").alias("_configs"), *[F.sum(c).alias(c) for c in ("_kpi", "_series", "_outside")], F.max("_input").alias("_input"))
    per = runs.groupBy("client_name").agg(
        F.count("run_path").alias("n_runs"), F.sum("_configs").alias("n_configs"), F.sum("_kpi").alias("n_kpi_files"),
        F.sum("_series").alias("n_timeseries_files"), F.sum("_outside").alias("n_outside_runs"),
        F.coalesce(F.max("_input"), F.lit(0)).cast("boolean").alias("has_input"))
    last = F.substring_index("name", ".", -1)
    extension = F.when(F.col("name").contains(".") & (last != ""), F.lower(F.concat(F.lit("."), last))).otherwise(F.lit(""))
    types = s.groupBy("client_name", extension.alias("ext")).agg(F.count("*").alias("n")).groupBy("client_name").agg(
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("ext", "n"))))).alias("file_types"))
    return per.join(types, "client_name")


def case_counts(spark, root: str) -> DataFrame:
    """src_case_counts: KPI and series files per client and run at any depth, runs with ≥ 1 only."""
    s = scan(spark, root)
    return (s.groupBy("client_name", "run_path", F.col("run_folder").alias("run_name"))
            .agg(F.count_if(F.col("kind") == "kpi").alias("n_kpi"),
                 F.count_if(F.col("kind") == "timeseries").alias("n_timeseries"))
            .filter((F.col("n_kpi") + F.col("n_timeseries")) >= 1).drop("run_path"))


def import_preview(spark, root: str, max_clients: int = 10) -> DataFrame:
    """src_import_preview: a row per run of the first N clients (by name), with the client's
    totals.  Runs are rows, so no list of a client's runs is ever collected."""
    cc = case_counts(spark, root)
    per = cc.groupBy("client_name").agg(F.count("*").alias("n_runs"),
                                        F.sum("n_kpi").alias("n_kpi_files"),
                                        F.sum("n_timeseries").alias("n_timeseries_files"))
    first = per.orderBy("client_name").limit(max_clients)
    return cc.select("client_name", "run_name").join(first, "client_name")


# --- KPI sheets and series, columns by each file's header -----------------------------------
_UNIT = H.first_where(lambda n: n.contains("unit"))
_VALUE = H.first_where(lambda n: n.contains("value"), _UNIT)
_ANY = H.first_where(lambda n: F.lit(True), _UNIT, _VALUE)
_NAME = H.first_where(lambda n: n.contains("name"), _UNIT, _VALUE)
_KPI = H.first_where(lambda n: n.contains("kpi"), _UNIT, _VALUE)


def _kpi_name(names):
    return F.coalesce(_NAME(names), _KPI(names), _ANY(names))


def _kpi_value(names):
    # without a value column the first one that is neither name nor unit
    other = H.first_where(lambda n: F.lit(True), _UNIT, _kpi_name)
    return F.coalesce(_VALUE(names), other(names))


#: Columns of KPI sheets: by what their names contain, else by the first free place.
KPI_COLUMNS = {"kpi_name": _kpi_name, "kpi_value": _kpi_value, "kpi_unit": _UNIT}
_TIMES = ("timestamp", "timestamp_utc", "datetime", "time", "date")
_SERIES = SERIES_HEADER.split(",")[1:]
#: Columns of series files: the time by its usual names or what contains one, values by name.
SERIES_COLUMNS = {"timestamp": lambda names: F.coalesce(
    H.named(*_TIMES)(names), H.first_where(lambda n: n.contains("time") | n.contains("date"))(names))} | {
    c: H.named(c) for c in _SERIES}


def _kpi_rows(spark, root: str) -> tuple[DataFrame, DataFrame]:
    """``(headers, rows)`` of all KPI sheets, rows with the reason why they are skipped."""
    head, rows = H.sheets(spark, root, "kpi_summary*.csv", KPI_COLUMNS, "size(names) >= 2")
    name = F.trim("kpi_name")
    number = S.numeric_or_null("kpi_value")
    rows = rows.select("path", "block", "line", name.alias("kpi_name"), number.alias("kpi_value"), F.trim("kpi_unit").alias("kpi_unit"),
                       F.when(name.isNull() | (name == "") | (F.lower(name) == "nan"), F.lit("no name"))
                       .when(number.isNull(), F.lit("value not numeric")).alias("skipped"))
    return head, rows


def _parsed_once(spark, root: str) -> dict:
    """The rows of sheets and series as :func:`_kpi_rows` and :func:`_series_rows` give them, written to
    the shared folder for an import that goes through them several times."""
    out = {}
    for kind, (head, rows) in (("kpi", _kpi_rows(spark, root)), ("timeseries", _series_rows(spark, root))):
        path = scratch_path(spark, f"parsed-{uuid.uuid4().hex}")
        rows.write.parquet(path)
        out[kind] = head, spark.read.schema(rows.schema).parquet(path)
    return out


def _key():
    """Sorted and joined ahead of a path: paths of a tree begin alike, so comparing them alone is slow."""
    return F.xxhash64("path").alias("_key")


def kpi_sheets(spark, root: str, rows: DataFrame | None = None) -> DataFrame:
    """src_kpi_sheets: every KPI sheet of the tree as long rows.

    Name, value and unit are found by each sheet's header, in any order and among other
    columns; names are trimmed, values coerced (N11), and the last row of a duplicate KPI in
    a file wins.  Rows and sheets left out are counted by :func:`quarantine`."""
    rows = (_kpi_rows(spark, root)[1] if rows is None else rows).where("skipped IS NULL")
    last = F.max_by(F.struct("kpi_value", "kpi_unit"), F.struct("block", "line"))
    return (rows.groupBy(_key(), "path", "kpi_name").agg(last.alias("v"))
            .select("path", *_client_run("path", root), S.config_name_from_file(F.element_at(F.split("path", "/"), -1)).alias("config_name"),
                    "kpi_name", F.col("v.kpi_value").alias("kpi_value"), F.col("v.kpi_unit").alias("kpi_unit")))


def kpi_csv_direct(spark, root: str) -> DataFrame:
    """src_kpi_csv_direct: all rows of all sheets as they stand: the three known columns as text,
    every further column in ``extra`` (JSON), headers applied and not repeated as rows."""
    return H.sheets(spark, root, "kpi_summary*.csv", KPI_COLUMNS, rest="extra")[1].drop("block", "line")


def _series_rows(spark, root: str) -> tuple[DataFrame, DataFrame]:
    head, rows = H.sheets(spark, root, "flex_timeseries*.csv", SERIES_COLUMNS, "timestamp IS NOT NULL", rest="extra")
    return head, rows.withColumn("timestamp", H.read_time("timestamp"))


def timeseries(spark, root: str) -> DataFrame:
    """src_timeseries_csv: all series files, configuration from the path, columns by name.

    A column that a file lacks is null, columns beyond the known ones are kept in ``extra``
    (JSON).  Files without a time column and rows without a readable time are counted by
    :func:`quarantine`."""
    rows = _series_rows(spark, root)[1].where("timestamp IS NOT NULL")
    return rows.select(*_client_run("path", root),
                       S.config_name_from_file(F.element_at(F.split("path", "/"), -1)).alias("config_name"),
                       "timestamp", *[S.numeric_or_null(c).alias(c) for c in _SERIES], "extra")


def quarantine(spark, root: str, parsed: dict | None = None) -> DataFrame:
    """``scope, path, reason, n``: every file that is not imported, and the rows of imported files
    that are not, counted by reason.  Written once (:func:`stored_quarantine`), it is the
    record of an import."""
    files = classified(spark, root)
    bad = files.where("skipped IS NOT NULL").select(F.lit("file").alias("scope"), "path", F.col("skipped").alias("reason"), F.lit(1).cast("long").alias("n"))
    run = files.where("skipped IS NULL")
    khead, krows = parsed["kpi"] if parsed else _kpi_rows(spark, root)
    shead, srows = parsed["timeseries"] if parsed else _series_rows(spark, root)
    parts = [bad]
    for kind, glob, head, wrong, why in (
            ("kpi", "kpi_summary", khead, "size(names) < 2", "fewer than two columns"),
            ("timeseries", "flex_timeseries", shead, "timestamp IS NULL", "no time column")):
        some = run.where(F.col("kind") == kind).select(_key(), "path", "name")
        read = F.lower("name").startswith(glob) & F.lower("name").endswith(".csv")
        checked = some.join(head.select(_key(), "path", F.expr(wrong).alias("_wrong")), ["_key", "path"], "left")
        reason = F.when(~read, F.lit("not a readable sheet")).when(F.col("_wrong").isNull(), F.lit("empty")).when(F.col("_wrong"), F.lit(why))
        parts.append(checked.select(F.lit("file").alias("scope"), "path", reason.alias("reason"), F.lit(1).cast("long").alias("n")).where("reason IS NOT NULL"))
    # every line is of a listed file, so those of runs are the ones of no skipped file
    no_run = files.where("skipped IS NOT NULL").select("path")
    krow = krows.where("skipped IS NOT NULL").groupBy("path", F.col("skipped").alias("reason")).agg(F.count("*").alias("n"))
    twice = krows.where("skipped IS NULL").groupBy("path", "kpi_name").agg((F.count("*") - 1).alias("n")).where("n > 0") \
        .groupBy("path").agg(F.sum("n").alias("n")).select("path", F.lit("replaced by a later row").alias("reason"), "n")
    srow = srows.where("timestamp IS NULL").groupBy("path").agg(F.count("*").alias("n")).select("path", F.lit("time not readable").alias("reason"), "n")
    for rows in (krow, twice, srow):
        parts.append(rows.join(no_run, "path", "left_anti").select(F.lit("row").alias("scope"), "path", "reason", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stored_quarantine(spark, root: str, parsed: dict | None = None) -> DataFrame:
    """The quarantine of a tree as a table in the shared folder."""
    path = scratch_path(spark, f"quarantine-{uuid.uuid4().hex}")
    quarantine(spark, root, parsed).write.parquet(path)
    return spark.read.schema("scope string, path string, reason string, n long").parquet(path)


def params_documents(spark, root: str) -> DataFrame:
    """src_params_json: per run the first of parameters.json, config.json, params.json,
    else the first YAML file — ``wholetext`` read, priority via ``min_by``."""
    glob = "*.{json,yml,yaml}"
    if (pieces := packed_files(spark, root, glob)) is not None:
        long = pieces.where("block > 0 OR NOT last").groupBy("path").agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "content"))), lambda p: p["content"]), "").alias("value"))
        df = pieces.where("block = 0 AND last").select("path", F.col("content").alias("value")).unionByName(long) \
            .withColumn("name", F.element_at(F.split("path", "/"), -1))
    else:
        # note: DataFrameReader.text() passes wholetext explicitly, so it must be an argument
        raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
        df = raw.select("value", decoded_path("_metadata.file_path").alias("path"),
                        F.col("_metadata.file_name").alias("name"))
    parts = F.split("path", "/")
    df = df.filter(F.element_at(parts, -2) == "Input")
    prio = F.lit(None).cast("int")
    for i, n in enumerate(PARAM_FILES):
        prio = F.when(F.col("name") == n, F.lit(i)).otherwise(prio)
    prio = F.coalesce(prio, F.when(F.col("name").rlike(r"\.ya?ml$"), F.lit(len(PARAM_FILES))))
    cand = df.select(*_client_run("path", root), "name", "value", prio.alias("prio")).filter(
        F.col("prio").isNotNull())
    best = F.min_by(F.struct("name", "value"), F.struct("prio", "name"))
    return (cand.groupBy("client_name", "run_name").agg(best.alias("b"))
            .select("client_name", "run_name", F.col("b.name").alias("source_file"), F.col("b.value").alias("document")))


def flatten_documents(docs: DataFrame) -> DataFrame:
    """src_config_flatten: nested YAML/JSON run documents -> (run, key path, value) rows.

    Parsing is per document inside ``mapInPandas`` (a small per-row helper); the rows are
    partitioned and shuffled by Spark like any other data."""
    import pandas as pd

    def walk(obj, prefix, out):
        if isinstance(obj, dict):
            for k, v in obj.items():
                walk(v, f"{prefix}.{k}" if prefix else str(k), out)
        elif isinstance(obj, list):
            for i, v in enumerate(obj):
                walk(v, f"{prefix}[{i}]", out)
        else:
            out.append((prefix, None if obj is None else str(obj)))

    def parse(it):
        import json

        import yaml
        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)     # the same documents, read in C where built
        for pdf in it:
            rows = []
            for client, run, doc in zip(pdf["client_name"], pdf["run_name"], pdf["document"]):
                try:
                    obj = yaml.load(doc, Loader=loader)  # JSON is a subset of YAML
                except Exception:                       # unreadable document -> no rows
                    try:
                        obj = json.loads(doc)
                    except Exception:
                        continue
                out = []
                walk(obj, "", out)
                rows += [(client, run, k, v) for k, v in out]
            yield pd.DataFrame(rows, columns=["client_name", "run_name", "key_path", "value"])

    return docs.select("client_name", "run_name", "document").mapInPandas(
        parse, "client_name string, run_name string, key_path string, value string")


def import_stats(spark, root: str) -> DataFrame:
    """src_import_stats: found, imported and skipped files, rows, runs and configurations, and the
    number of skipped ones by reason (``metric, value``).  Found = imported + skipped, for files
    as for rows."""
    files = classified(spark, root)
    parsed = _parsed_once(spark, root)
    bad = stored_quarantine(spark, root, parsed)

    def long(df):
        return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value"))
                                            for c in df.columns])))
    left_out = bad.where("scope = 'file'").select("path")
    good = files.join(left_out, "path", "left_anti")
    run, out = F.col("run_path"), F.col("kind").isin("kpi", "timeseries")
    found = files.agg(F.count("*").alias("files_found"), F.count_distinct("client_name").alias("clients_found"),
                      F.count_distinct(run).alias("runs_found"))
    imported = good.agg(
        F.count("*").alias("files_imported"), F.count_distinct(F.when(out, F.col("client_name"))).alias("clients_imported"),
        F.count_distinct(F.when(out, run)).alias("runs_imported"),
        F.count_distinct(F.when(out, F.concat_ws("/", run, "config_name"))).alias("configs_imported"))
    skipped = bad.agg(F.coalesce(F.sum(F.when(F.col("scope") == "file", F.col("n"))), F.lit(0)).alias("files_skipped"))
    rows = [long(found), long(imported), long(skipped)]
    for what, lines_, ok in (("kpi", parsed["kpi"][1], kpi_sheets(spark, root, parsed["kpi"][1])),
                             ("series", parsed["timeseries"][1], None)):
        lines_ = lines_.join(left_out, "path", "left_anti")
        kept = ok.join(left_out, "path", "left_anti").agg(F.count("*").alias(f"{what}_rows_imported")) if ok is not None \
            else lines_.agg(F.count("timestamp").alias(f"{what}_rows_imported"))
        rows += [long(lines_.agg(F.count("*").alias(f"{what}_rows_found"))), long(kept)]
    why = bad.join(files.select("path", F.when(F.col("kind") == "kpi", "kpi").otherwise("series").alias("_k")), "path")
    rows.append(why.where("scope = 'row'").groupBy(F.concat("_k", F.lit("_rows_skipped")).alias("metric")).agg(F.sum("n").alias("value")))
    rows.append(bad.groupBy(F.concat(F.lit("skipped "), "scope", F.lit(": "), "reason").alias("metric")).agg(F.sum("n").alias("value")))
    all_ = rows[0]
    for r in rows[1:]:
        all_ = all_.unionByName(r)
    return all_
