"""Source, sink and incremental queries.

They read a result-folder tree / upload folder that Spark writes from the driver tables
into the shared scratch folder (once per scale factor), so their work grows with the
tables.  No SQL oracle: checked by row counts and unit tests."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from ..operators import benefits as B
from ..session import scratch_path
from ..sources import tables as T
from ..sources import tree as TR
from ..sources import uploads as U
from ..streaming import incremental as INC
from .common import Model, rounded
from .model_sql import CLIENTS, with_
from .registry import register


def _tree(spark, sf):
    return TR.materialize_tree(spark, sf)


def _up(spark, sf):
    return U.materialize_uploads(spark, sf)


register("src_result_tree")(lambda spark, sf: TR.result_tree(spark, _tree(spark, sf)))
register("src_nested_tree")(lambda spark, sf: TR.nested_tree(spark, _tree(spark, sf)))
register("src_tree_profile")(lambda spark, sf: TR.tree_profile(spark, _tree(spark, sf)))
register("src_case_counts")(lambda spark, sf: TR.case_counts(spark, _tree(spark, sf)))
register("src_import_preview")(lambda spark, sf: TR.import_preview(spark, _tree(spark, sf)))
register("src_import_stats")(lambda spark, sf: TR.import_stats(spark, _tree(spark, sf)))
register("src_kpi_sheets")(lambda spark, sf: TR.kpi_sheets(spark, _tree(spark, sf)))
register("src_kpi_csv_direct")(lambda spark, sf: TR.kpi_csv_direct(spark, _tree(spark, sf)))
register("src_timeseries_csv")(lambda spark, sf: TR.timeseries(spark, _tree(spark, sf)))
register("src_params_json")(lambda spark, sf: TR.params_documents(spark, _tree(spark, sf)))
register("src_config_flatten")(lambda spark, sf: TR.flatten_documents(TR.params_documents(spark, _tree(spark, sf))))
register("src_load_file")(lambda spark, sf: U.load_files(spark, _up(spark, sf) + "/load"))
register("flt_required_columns")(lambda spark, sf: U.invalid_files(spark, _up(spark, sf) + "/load", "load").unionByName(
    U.invalid_files(spark, _up(spark, sf) + "/preprocessed", "preprocessed")))
register("src_register_csv")(lambda spark, sf: U.register(spark, _up(spark, sf) + "/register/netzbetreiber"))
register("src_latest_file")(lambda spark, sf: U.latest_file(spark, _up(spark, sf) + "/preprocessed"))

register("src_table_scan", with_(CLIENTS) + "SELECT client_id, client_name, description FROM clients")(
    lambda spark, sf: Model(spark, sf).clients.select("client_id", "client_name", "description"))


@register("snk_csv_export")
def snk_csv_export(spark, sf):
    """Benefits exported as CSV with a header, read back with an explicit schema."""
    m = Model(spark, sf)
    ben = rounded(B.benefits(m.configs, m.kpis))
    path = scratch_path(spark, f"export-{uuid.uuid4().hex[:8]}")
    ben.write.mode("overwrite").option("header", "true").csv(path)
    return spark.read.option("header", "true").schema(ben.schema).csv(path)


@register("snk_json_records")
def snk_json_records(spark, sf):
    """Feature rows as JSON records: NaN -> null, nulls written (ignoreNullFields=false).  The text
    repeats every field name in every record, so its files are compressed."""
    from .feature_plans import _matrix
    mat = _matrix(spark, sf)
    cols = [F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in mat.dtypes]
    path = scratch_path(spark, f"json-{uuid.uuid4().hex[:8]}")
    mat.select(*cols).write.mode("overwrite").option("ignoreNullFields", "false").option("compression", "gzip").json(path)
    return spark.read.schema(mat.schema).json(path)


def _tag(sf):
    return hashlib.sha1(sf.encode()).hexdigest()[:10]


@register("inc_features")
def inc_features(spark, sf):
    """Series land as files holding whole configurations; an availableNow stream turns
    each new file batch into features in the batched store.  Re-running is a no-op: the
    checkpoint already holds every landed file."""
    run = uuid.uuid4().hex[:8]
    landing = scratch_path(spark, f"landing-{_tag(sf)}-{run}")
    series = T.series_events(spark, sf)
    INC.write_landing(series, landing, "config_id")
    store = scratch_path(spark, f"inc-store-{run}")
    ckpt = scratch_path(spark, f"inc-ckpt-{run}")
    INC.run_feature_stream(spark, landing, series.schema, store, ckpt)
    INC.run_feature_stream(spark, landing, series.schema, store, ckpt)   # restart: nothing new
    return INC.BatchedStore(spark, store).load()


@register("inc_score_submission")
def inc_score_submission(spark, sf):
    """Landed submissions are scored by an availableNow stream with the registered models of all
    targets, on the features of each submission's own profiles; every run is logged."""
    from .ml_plans import MODELS, trained_registry
    run = uuid.uuid4().hex[:8]
    registry = trained_registry(spark, sf)
    profiles = {}
    for name, df in (("load", T.load_profile(spark, sf)), ("pv", T.pv_profile(spark, sf))):
        path = scratch_path(spark, f"profiles-{run}/{name}")           # once, before the stream starts
        df.repartitionByRange("site_id").sortWithinPartitions("site_id", "timestamp_utc").write.parquet(path)
        profiles[name] = spark.read.schema(df.schema).parquet(path)
    subs = T.submissions(spark, sf)
    landing = scratch_path(spark, f"subs-{_tag(sf)}-{run}")
    INC.write_landing(subs, landing, "submission_id")
    out, ckpt = scratch_path(spark, f"scores-{run}"), scratch_path(spark, f"scores-ckpt-{run}")
    INC.run_scoring_stream(spark, landing, subs.schema, out, ckpt, INC.submission_scorer(profiles["load"], profiles["pv"], registry, MODELS))
    return spark.read.parquet(out)
