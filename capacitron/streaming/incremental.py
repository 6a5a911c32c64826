"""Incremental jobs on Structured Streaming.

Both read a landing folder with the file source and ``trigger(availableNow=True)``: every
file present is processed exactly once, the checkpoint replaces the reference's
processed-id list, and a restart after a crash resumes from the last committed batch.
``foreachBatch`` sinks write per-batch output folders in overwrite mode, so a batch that
is replayed after a failure rewrites the same folder (idempotent per batch id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import series as S
from ..operators.joins import grown


class BatchedStore:
    """Append-only feature store: one folder per micro-batch, latest row per key wins.

    Appending costs O(batch) instead of rewriting the whole table; reads resolve each
    key's newest row with ``max_by`` (a partial aggregate, skew-safe).
    """

    def __init__(self, spark, root: str, key: str = "config_id"):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def write_batch(self, df: DataFrame, batch_id: int) -> None:
        df.withColumn("_batch", F.lit(int(batch_id))).write.mode("overwrite").parquet(
            f"{self.root}/batch_id={int(batch_id)}")

    def load(self) -> DataFrame:
        df = self.spark.read.option("mergeSchema", "true").parquet(self.root)
        cols = [c for c in df.columns if c not in (self.key, "_batch", "batch_id")]
        latest = F.max_by(F.struct(*cols), F.struct("batch_id", "_batch"))
        return df.groupBy(self.key).agg(latest.alias("_r")).select(self.key, *[F.col(f"_r.{c}").alias(c)
                                                                               for c in cols])


def write_landing(df: DataFrame, path: str, key: str, n_files: int | None = None) -> None:
    """Land ``df`` as parquet files that each hold whole keys; as many as the data ask for."""
    (df.repartition(n_files, key) if n_files else df.repartition(key)).write.mode("overwrite").parquet(path)


#: Bytes of landed files that one micro-batch takes.
BATCH_BYTES = 256 << 20


def _batches(spark, landing: str, schema, batch_bytes: int | None, files_per_batch: int | None):
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r.option("maxBytesPerTrigger", batch_bytes or BATCH_BYTES)).parquet(landing)


def run_feature_stream(spark, landing: str, schema, store_root: str, checkpoint: str,
                       spec=None, df_features=None, files_per_batch: int | None = None, batch_bytes: int | None = None) -> int:
    """inc_features: new landed series files -> features -> batched store."""
    spec = spec or S.SIMULATION_COLUMN_SPECS
    df_features = S.DF_FEATURE_NAMES if df_features is None else df_features
    store = BatchedStore(spark, store_root)

    def per_batch(batch: DataFrame, batch_id: int):
        feats = S.extract(batch, spec, df_features)
        store.write_batch(feats, batch_id)

    q = (_batches(spark, landing, schema, batch_bytes, files_per_batch)
         .writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return len(q.recentProgress)


def score_batch(out_root: str, batch: DataFrame, batch_id: int, score_fn) -> None:
    """Score one micro-batch and log its runs: a row per submission under the key (batch,
    submission).  A replayed batch rewrites its own folder, so it adds nothing."""
    score_fn(batch).withColumn("run_key", F.concat_ws("-", F.lit(int(batch_id)), "submission_id")).withColumn(
        "_batch", F.lit(int(batch_id))).write.mode("overwrite").parquet(f"{out_root}/batch_id={int(batch_id)}")


def run_scoring_stream(spark, landing: str, schema, out_root: str, checkpoint: str, score_fn,
                       files_per_batch: int | None = None, batch_bytes: int | None = None) -> None:
    """inc_score_submission: landed submissions -> ``score_fn(batch)`` -> per-batch output."""
    q = (_batches(spark, landing, schema, batch_bytes, files_per_batch)
         .writeStream.foreachBatch(lambda batch, batch_id: score_batch(out_root, batch, batch_id, score_fn))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def submission_scorer(load: DataFrame, pv: DataFrame, registry, names):
    """``score(batch)``: submissions -> PV scaled by weekday with their consumed share -> the
    features the models were trained on -> predictions.

    ``load`` and ``pv`` are stored profiles of the sites; a batch reads those of its own sites.
    The models are loaded from the registry batch by batch, so a newly published version is used
    from the next batch on, and ``model_versions`` tells which ones scored a row.  A submission
    without a load profile gets NULL predictions."""
    from ..operators import features as FT
    from ..operators import linear as L
    from ..operators import profile as P
    from ..operators.inputs import normalise_pv

    def score(batch: DataFrame) -> DataFrame:
        models = [registry.load(n) for n in names]
        s = normalise_pv(batch).withColumn("site_id", F.col("submission_id"))
        sites = s.select("site_id", "pv_consumed_share")
        ld = grown(load, sites.select("site_id"), "site_id", "left_semi")
        merged = P.merge_load_pv(ld, P.weekday_scale(ld, grown(pv, sites, "site_id"), F.col("pv_consumed_share")))
        series = merged.select(F.col("site_id").alias("config_id"), F.col("timestamp_utc").alias("timestamp"),
                               F.col("grid_load_kwh").alias("load_kwh"), F.col("pv_load_kwh").alias("generation_kwh"))
        feats = S.extract(series, FT.MATRIX_SERIES_SPEC, FT.MATRIX_DF_FEATURES, key="config_id", prefix="ts__")
        feats = feats.select(F.col("config_id").alias("site_id"), F.lit(True).alias("has_profile"),
                             *[F.col(c).alias(c if c.startswith("ts__") else f"ts__{c}") for c in feats.columns if c != "config_id"])
        own = s.select("submission_id", "site_id", F.col("battery_capacity").alias("battery_capacity_kwh"),
                       F.col("battery_power").alias("battery_power_kw"), "pv_consumed_share")
        out = grown(own, feats, "site_id", "left").drop("site_id").withColumn("has_profile", F.coalesce("has_profile", F.lit(False)))
        return out.withColumns({f"pred_{i['name']}": F.when(F.col("has_profile"), L.scored(m, out.columns)) for m, i in models}).withColumn(
            "model_versions", F.lit(", ".join(f"{i['name']} v{i['version']}" for _, i in models)))
    return score
