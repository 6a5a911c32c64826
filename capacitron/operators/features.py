"""Feature matrix and feature store (SURVEY §2.10 ft_*, §2.9 set_upsert_features,
set_processed_ids, set_clear_store, §2.5 agg_feature_store_summary, §2.1 snk_feature_parquet).

The matrix is a join of three set-based pieces, each built once for all configurations:
configuration metadata (dimension joins), series features (one aggregate per site,
joined through the run's client) and targets (benefit KPI rows pivoted with a fixed
value list — no pivot-discovery job)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import benefits as B
from . import series as S
from . import warehouse as W
from ..functions.nulls import finite_or_zero
from .joins import grown

ID_COLUMNS = ["config_id", "client_name", "run_name", "config_name"]
TARGET_KPIS = ["peak_shaving_benefit", "energy_procurement_optimization", "trading_revenue"]
DIRECT_COLUMNS = ["battery_capacity_kwh", "battery_power_kw", "battery_efficiency"]
# compact series spec used for the training matrix (prefix ``ts__``)
MATRIX_SERIES_SPEC = {
    "load_kwh": {"stats": ["mean", "max", "std"], "percentiles": [50, 90], "custom": ["peak_to_mean"]},
    "generation_kwh": {"stats": ["sum"], "custom": ["capacity_factor"]},
}
MATRIX_DF_FEATURES = ["self_consumption_ratio", "temporal__weekend_load_ratio"]


def targets(kpis: DataFrame, names=TARGET_KPIS) -> DataFrame:
    """ft_targets: ``target_<kpi>`` per configuration, absent -> NULL."""
    names = list(names)
    return (kpis.filter(F.col("kpi_name").isin(names)).groupBy("config_id")
            .pivot("kpi_name", names).agg(F.first("kpi_value"))
            .select("config_id", *[F.col(n).alias(f"target_{n}") for n in names]))


def kpi_inputs(configs: DataFrame, kpis: DataFrame, mapping: dict) -> DataFrame:
    """ft_kpi_inputs: direct inputs from configuration metadata first, else KPI rows.
    ``mapping``: output column -> KPI name used as fallback."""
    wide = B.kpi_wide(kpis, list(mapping.values()))
    j = configs.select("config_id", *mapping.keys()).join(wide, "config_id", "left")
    return j.select("config_id", *[F.coalesce(F.col(k), F.col(v)).alias(k) for k, v in mapping.items()])


def matrix(configs, kpis, runs, clients, series, spec=None, df_features=None,
           include_baseline=False, primary="peak_shaving_benefit") -> DataFrame:
    """ft_matrix: ids + direct + ``ts__`` series features + targets + primary target."""
    spec = spec or MATRIX_SERIES_SPEC
    df_features = MATRIX_DF_FEATURES if df_features is None else df_features
    # targets straight from the benefit columns (equal to pivoting the saved KPI rows, without the
    # unpivot/pivot round trip); the configurations carry their columns along, so they are not
    # brought together with their benefits a second time
    ben = B.benefits(configs, kpis, include_baseline=include_baseline, keep=["battery_efficiency"], how="left")
    cfg = ben.select("config_id", "run_id", "config_name", *DIRECT_COLUMNS, *[F.col(t).alias(f"target_{t}") for t in TARGET_KPIS])
    ts = S.extract(series, spec, df_features, key="config_id", prefix="ts__")
    ts = ts.select(F.col("config_id").alias("client_id"),
                   *[F.col(c).alias(c if c.startswith("ts__") else f"ts__{c}") for c in ts.columns if c != "config_id"])
    feats = [c for c in ts.columns if c != "client_id"]
    # the series features of a client go to its runs, which are fewer than their configurations
    out = W.configs_full(cfg, grown(runs, ts, "client_id", "left"), clients, keep=feats)
    return out.select(*ID_COLUMNS, *DIRECT_COLUMNS, *feats,
                      *[f"target_{t}" for t in TARGET_KPIS], F.col(f"target_{primary}").alias("target"))


def feature_columns(df: DataFrame) -> list[str]:
    """ft_xy (D7): every column except ids and all targets."""
    return [c for c in df.columns if c not in ID_COLUMNS and not c.startswith("target") and c != "client_id"]


def xy(df: DataFrame, target: str = "target") -> DataFrame:
    """Rows with a known target; features + label + group column (client)."""
    feats = feature_columns(df)
    return df.filter(F.col(target).isNotNull()).select("config_id", "client_name", *feats,
                                                       F.col(target).alias("label"))


def vector(df: DataFrame, ordered, fill: dict | None = None) -> DataFrame:
    """ft_vector: features in training order; missing/NaN/inf -> stored fill value or 0."""
    fill = fill or {}
    cols = set(df.columns)
    out = []
    for c in ordered:
        v = F.col(c) if c in cols else F.lit(None).cast("double")
        if c in fill:
            v = F.coalesce(F.when(~F.isnan(v), v), F.lit(float(fill[c])))
        out.append(finite_or_zero(v).alias(c))
    return df.select("config_id", *out)


def store_summary(df: DataFrame) -> DataFrame:
    """agg_feature_store_summary: configs, features, counts by prefix (one row)."""
    feats = feature_columns(df)
    n_ts = sum(1 for c in feats if c.startswith("ts__"))
    n_direct = sum(1 for c in feats if c in DIRECT_COLUMNS)
    n_targets = sum(1 for c in df.columns if c.startswith("target_"))
    return df.agg(F.count("*").alias("n_configs")).select(
        "n_configs", F.lit(len(feats)).alias("n_features"), F.lit(n_ts).alias("n_timeseries_features"),
        F.lit(n_direct).alias("n_direct_features"), F.lit(n_targets).alias("n_targets"))


def metadata(df: DataFrame, target_kpi: str, version: str = "1.0") -> DataFrame:
    """ft_metadata: the feature column list with counts, version and time (one row)."""
    feats = feature_columns(df)
    return df.agg(F.count("*").alias("n_configs")).select(
        F.array(*[F.lit(c) for c in feats]).alias("feature_columns"), F.lit(len(feats)).alias("n_features"),
        "n_configs", F.lit(target_kpi).alias("target_kpi"), F.lit(version).alias("extraction_version"),
        F.current_timestamp().alias("extracted_at"))


class FeatureStore:
    """Parquet feature store with upsert-by-config and snapshot versions.

    Each write goes to a new ``v<N>`` folder under ``root``; the current snapshot is the
    highest version whose ``_SUCCESS`` marker exists.  A reader never sees a half-written
    table and a job can read the current snapshot while writing the next one (no
    read/overwrite of one path).  Paths go through the Hadoop FileSystem API, so ``root``
    can be any shared location (HDFS, object store); see ``session.scratch_path``.
    """

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        out = []
        for st in fs.listStatus(path):
            name = st.getPath().getName()
            if name.startswith("v") and name[1:].isdigit() and fs.exists(
                    jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                out.append(int(name[1:]))
        return sorted(out)

    def current(self) -> str | None:
        v = self._versions()
        return f"{self.root}/v{v[-1]}" if v else None

    def load(self) -> DataFrame | None:
        cur = self.current()
        return self.spark.read.parquet(cur) if cur else None

    def save(self, df: DataFrame, cluster_by: str | None = "client_name") -> str:
        """Write a new snapshot.  Rows are range-partitioned and sorted by ``cluster_by``
        (clients): each file covers a narrow client range, so Parquet min/max statistics
        prune by client, without one directory per client (a client-partitioned layout
        degenerates into millions of small files at scale; a hot client is split across
        range partitions instead of landing in one file)."""
        v = self._versions()
        path = f"{self.root}/v{(v[-1] + 1) if v else 1}"
        if cluster_by and cluster_by in df.columns:
            df = df.repartitionByRange(cluster_by).sortWithinPartitions(cluster_by)
        df.write.mode("overwrite").parquet(path)
        return path

    def upsert(self, new: DataFrame) -> str:
        """set_upsert_features: replace rows with the same config_id, append new ones,
        allow new columns."""
        old = self.load()
        if old is None:
            return self.save(new)
        kept = grown(old, new.select("config_id").distinct(), "config_id", "left_anti")
        return self.save(kept.unionByName(new, allowMissingColumns=True))

    def processed_ids(self) -> DataFrame | None:
        """set_processed_ids: the distinct config ids already in the store."""
        df = self.load()
        return None if df is None else df.select("config_id").distinct()

    def clear(self, schema) -> str:
        """set_clear_store: a new, empty snapshot."""
        return self.save(self.spark.createDataFrame([], schema), cluster_by=None)
