"""The older extractor classes: same registry idea, own names and
guards.  Each returns aggregate expressions for one ``groupBy(key).agg`` pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import fold_nan, ratio_if_positive, share
from .series import _diff_name, distributed_diff_stats, heavy_keys, segmented_percentiles, with_diffs

LOAD_PERCENTILES = [10, 25, 50, 75, 90, 95]


def load_profile_exprs(col: str = "load_kwh") -> list[Column]:
    """Aggregate part of the load-profile extractor (percentiles are joined separately)."""
    c = F.col(col)
    gate = lambda e: F.when(F.count(c) > 0, e)  # noqa: E731  (empty -> features absent)
    out = [gate(F.avg(c)).alias("load_mean"), gate(F.stddev_samp(c)).alias("load_std"),
           gate(F.min(c)).alias("load_min"), gate(F.max(c)).alias("load_max"),
           gate(F.coalesce(F.sum(c), F.lit(0.0))).alias("load_sum"),
           gate(ratio_if_positive(F.max(c), F.avg(c))).alias("load_peak_to_mean"),
           gate(F.when(F.avg(c) > 0, F.try_divide(F.stddev_samp(c), F.avg(c))).otherwise(0.0)).alias("load_cv")]
    return out


def battery_exprs(soc: str = "soc_percent", power: str = "power_kw") -> list[Column]:
    s, p = F.col(soc), F.col(power)
    ds, dp = F.col(_diff_name(soc)), F.col(_diff_name(power))
    gs = lambda e: F.when(F.count(s) > 0, e)
    gp = lambda e: F.when(F.count(p) > 0, e)
    return [gs(F.avg(s)).alias("soc_mean"), gs(F.stddev_samp(s)).alias("soc_std"),
            gs(F.min(s)).alias("soc_min"), gs(F.max(s)).alias("soc_max"),
            gs(F.coalesce(F.sum(F.abs(ds)), F.lit(0.0)) / 200).alias("cycles_equivalent"),
            gs(share(s < 20)).alias("time_below_20pct"), gs(share(s > 80)).alias("time_above_80pct"),
            gp(F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0))).alias("charge_energy"),
            gp(F.coalesce(F.sum(F.when(p < 0, -p)), F.lit(0.0))).alias("discharge_energy"),
            gp(F.count_if(F.abs(dp) > 0.1).cast("double")).alias("power_reversals")]


def temporal_exprs(ts: str = "timestamp", value: str = "load_kwh") -> list[Column]:
    t, v = F.col(ts), F.col(value)
    total = F.coalesce(F.sum(v), F.lit(0.0))
    peak = F.hour(t).between(9, 17)
    has_peak = (F.max(peak.cast("int")) == 1) & (F.min(peak.cast("int")) == 0)
    off_mean = F.avg(F.when(~peak, v))
    wk = F.weekday(t) >= 5
    has_wk = (F.max(wk.cast("int")) == 1) & (F.min(wk.cast("int")) == 0)
    m = F.month(t)
    summer, winter = m.isin(6, 7, 8), m.isin(12, 1, 2)
    seasonal = ((F.count_distinct(m) >= 6) & (F.max(summer.cast("int")) == 1)
                & (F.max(winter.cast("int")) == 1))
    wmean = F.avg(F.when(winter, v))
    return [
        F.when(has_peak, F.when(total > 0, F.try_divide(F.coalesce(F.sum(F.when(peak, v)), F.lit(0.0)), total))
               .otherwise(0.0)).alias("peak_load_ratio"),
        F.when(has_peak, F.when(off_mean > 0, F.try_divide(F.avg(F.when(peak, v)), off_mean))
               .otherwise(0.0)).alias("peak_vs_offpeak"),
        F.when(has_wk, F.when(total > 0, F.try_divide(F.coalesce(F.sum(F.when(wk, v)), F.lit(0.0)), total))
               .otherwise(0.0)).alias("weekend_load_ratio"),
        F.when(seasonal, F.when(wmean > 0, F.try_divide(F.avg(F.when(summer, v)), wmean))
               .otherwise(0.0)).alias("summer_winter_ratio"),
    ]


def grid_exprs(cols) -> list[Column]:
    cols = set(cols)
    out = []
    if "grid_import_kwh" in cols:
        i = F.col("grid_import_kwh")
        out += [F.coalesce(F.sum(i), F.lit(0.0)).alias("grid_import_total"), F.max(i).alias("grid_import_max")]
    if "grid_export_kwh" in cols:
        e = F.coalesce(F.sum("grid_export_kwh"), F.lit(0.0))
        out.append(e.alias("grid_export_total"))
        if "generation_kwh" in cols:
            g = F.coalesce(F.sum("generation_kwh"), F.lit(0.0))
            out.append(F.when(g > 0, 1 - F.try_divide(e, g)).otherwise(0.0).alias("self_consumption_ratio"))
    return out


def extract_legacy(series: DataFrame, which=("load_profile", "battery", "temporal", "grid"),
                   key: str = "config_id") -> DataFrame:
    """FeatureExtractorRegistry.extract_all: chosen extractors in one aggregate.

    Series of up to ``HEAVY`` rows get percentiles and first differences inside that aggregate's
    exchange; heavy ones from value and time segments, so no task holds one."""
    series = fold_nan(series, [c for c in series.columns if c != key])
    heavy = heavy_keys(series, key) if {"load_profile", "battery"} & set(which) else None
    if heavy is None:
        return _extract(series, which, key, False)
    return _extract(series.join(heavy, key, "left_anti"), which, key, False).unionByName(
        _extract(series.join(heavy, key, "left_semi"), which, key, True))


def _extract(series: DataFrame, which, key: str, heavy: bool) -> DataFrame:
    exprs, df = [], series
    diffs = [c for c in ("soc_percent", "power_kw") if c in series.columns] if "battery" in which else []
    if diffs:
        # the differences of heavy series are aggregated apart and joined
        df = df.withColumns({_diff_name(c): F.lit(None).cast("double") for c in diffs}) if heavy else with_diffs(df, diffs, key)
    if "load_profile" in which:
        exprs += load_profile_exprs()
        if not heavy:
            exprs.append(F.percentile("load_kwh", F.array(*[F.lit(p / 100.0) for p in LOAD_PERCENTILES])).alias("_p"))
    if "battery" in which:
        exprs += battery_exprs()
    if "temporal" in which:
        exprs += temporal_exprs()
    if "grid" in which:
        exprs += grid_exprs(series.columns)
    out = df.groupBy(key).agg(*exprs)
    if "load_profile" in which:
        names = [f"load_p{p}" for p in LOAD_PERCENTILES]
        if heavy:
            pct = segmented_percentiles(series, {"load_kwh": LOAD_PERCENTILES}, key)
            out = out.join(pct.select(key, *[F.col(f"__q_load_kwh_p{p}").alias(n) for p, n in zip(LOAD_PERCENTILES, names)]), key, "left")
        else:
            out = out.withColumns({n: F.get("_p", F.lit(i)) for i, n in enumerate(names)}).drop("_p")
    if heavy and "battery" in which:
        order = out.columns
        soc = distributed_diff_stats(series, "soc_percent", key).select(key, (F.col("soc_percent__abs_diff_sum") / 200).alias("_cycles"))
        power = distributed_diff_stats(series, "power_kw", key).select(key, F.col("power_kw__big_diffs").cast("double").alias("_reversals"))
        out = out.join(soc, key, "left").join(power, key, "left") \
            .withColumn("cycles_equivalent", F.coalesce("_cycles", "cycles_equivalent")) \
            .withColumn("power_reversals", F.coalesce("_reversals", "power_reversals")).select(*order)
    return out
