"""Warehouse operators: hierarchy joins, keyed upserts, set operations.

The reference appends WHERE text and issues one INSERT per row; here filters are
Column predicates (pushed into the Parquet scan by Catalyst) and upserts are
anti-join + union plans that are idempotent per batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import grown


def filter_eq(df: DataFrame, **eq) -> DataFrame:
    """flt_hierarchy: optional equality filters, ANDed; ``None`` means no filter."""
    for c, v in eq.items():
        if v is not None:
            df = df.filter(F.col(c) == F.lit(v))
    return df


def configs_full(configs: DataFrame, runs: DataFrame, clients: DataFrame, keep=()) -> DataFrame:
    """jn_configs_full: configs ⋈ runs ⋈ clients, with further columns of the runs where asked for.

    A run meets its client first: the configurations, which are many more, move by run only."""
    named = grown(runs.select("run_id", "client_id", "run_name", *keep), clients.select("client_id", "client_name"), "client_id")
    return grown(configs, named, "run_id")


def kpis_full(kpis: DataFrame, configs: DataFrame, runs: DataFrame, clients: DataFrame) -> DataFrame:
    """jn_kpis_full: KPI fact ⋈ configs ⋈ runs ⋈ clients."""
    return grown(kpis, configs_full(configs.select("config_id", "run_id", "config_name",
                                                   "battery_capacity_kwh"), runs, clients),
                 "config_id")


def upsert(store: DataFrame, new: DataFrame, keys) -> DataFrame:
    """set_upsert_*: rows of ``new`` replace rows of ``store`` with the same key.

    New columns are allowed (missing ones become NULL).  Duplicate keys inside ``new``
    keep the last row by input order is not defined in Spark, so callers provide
    unique keys (see :func:`last_write_wins`).
    """
    keys = list(keys)
    kept = store.join(new.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def insert_ignore(store: DataFrame, new: DataFrame, keys) -> DataFrame:
    """set_insert_ignore: insert rows whose natural key is not in the store yet."""
    keys = list(keys)
    fresh = new.dropDuplicates(keys).join(store.select(*keys), keys, "left_anti")
    return store.unionByName(fresh, allowMissingColumns=True)


def last_write_wins(df: DataFrame, keys, seq_col: str) -> DataFrame:
    """win_last_write_wins: on duplicate keys keep the row with the highest sequence.

    Implemented as ``max_by`` aggregate (partial aggregation, skew-safe) rather than a
    window that would need every row of a hot key in one task.
    """
    keys = list(keys)
    others = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in others])
    return (df.groupBy(*keys).agg(F.max_by(packed, F.col(seq_col)).alias("_r"))
            .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others]))


def hierarchy_counts(clients: DataFrame, runs: DataFrame, configs: DataFrame) -> DataFrame:
    """agg_hierarchy_counts via jn_hierarchy_left: configs per client and run, zeros kept."""
    per_run = configs.groupBy("run_id").agg(F.count("config_id").alias("n_configs"))
    return (clients.select("client_id", "client_name")
            .join(runs.select("run_id", "client_id", "run_name"), "client_id", "left")
            .join(per_run, "run_id", "left")
            .select("client_name", "run_name",
                    F.coalesce("n_configs", F.lit(0)).cast("long").alias("n_configs")))


#: KPI rows that one task of :func:`kpi_catalogue` tells apart.
CATALOGUE_ROWS = 500_000


def kpi_catalogue(kpis: DataFrame) -> DataFrame:
    """agg_kpi_catalogue: per KPI name count(distinct config), avg, min, max.

    Every (KPI, configuration) is a group of its own, so the rows are dealt out by configuration
    among as many tasks as their number asks for: a task's groups stay bounded at any size."""
    tasks = -(-kpis.count() // CATALOGUE_ROWS)
    dealt = kpis.select("kpi_name", "config_id", "kpi_value").repartition(max(tasks, 1), "config_id")
    per = dealt.groupBy("kpi_name", "config_id").agg(
        F.sum("kpi_value").alias("_sum"), F.count("kpi_value").alias("_n"), F.min("kpi_value").alias("_min"), F.max("kpi_value").alias("_max"))
    return per.groupBy("kpi_name").agg(
        F.count("config_id").alias("n_configs"), F.try_divide(F.sum("_sum"), F.sum("_n")).alias("avg_value"),
        F.min("_min").alias("min_value"), F.max("_max").alias("max_value"))


def key_coverage(required: DataFrame, available: DataFrame, col: str) -> DataFrame:
    """set_kpi_coverage: (name, status) with status available / missing / unused_in_db."""
    r = required.select(F.col(col).alias("name")).distinct()
    a = available.select(F.col(col).alias("name")).distinct()
    both = r.intersect(a).withColumn("status", F.lit("available"))
    missing = r.subtract(a).withColumn("status", F.lit("missing"))
    unused = a.subtract(r).withColumn("status", F.lit("unused_in_db"))
    return both.unionByName(missing).unionByName(unused)
