"""Load / PV profile operators (SURVEY §2.10 pv_*, §2.5 agg_weekday_totals,
agg_average_week, §2.7 win_waterfall, §2.1 snk_profile_view).

Every operator is keyed by ``site_id`` so many submissions are processed in one plan.
Per-site and per-(site, weekday) totals are partial aggregates joined back on the
site key — never a window over all rows of a site, which would put a hot site into one
task.  Fixed-size grids (7 weekdays, 672 quarter-hours) are generated per site with
``explode(sequence(...))`` instead of a cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import slot_label, slot_of
from .joins import grown

SLOTS_PER_WEEK = 672


def scale_annual(profile: DataFrame, targets: DataFrame, value="pv_power_w",
                 target="pv_target_mwh", key="site_id") -> DataFrame:
    """pv_scale_annual: rescale a power profile (W per quarter-hour) so that its annual
    energy equals ``target`` MWh, and convert to kWh per quarter-hour."""
    energy_wh = profile.groupBy(key).agg((F.sum(value) / 4).alias("_wh"))
    f = energy_wh.join(targets.select(key, target), key)
    return (profile.join(f, key)
            .withColumn("pv_generation_kwh",
                        F.col(value) * F.try_divide(F.col(target) * 1e6, F.col("_wh")) / 4e3)
            .drop("_wh", target))


def weekday_totals(load: DataFrame, value="grid_load_kwh", key="site_id") -> DataFrame:
    """agg_weekday_totals: Σ per weekday and its share of the site total, all 7 days."""
    per = (load.groupBy(key, F.weekday("timestamp_utc").alias("weekday"))
           .agg(F.sum(value).alias("total")))
    # site total as a window over the pre-aggregated table: at most 7 rows per site, so
    # the window is bounded whatever the site's size (no extra aggregate + join)
    per = per.withColumn("_site", F.sum("total").over(Window.partitionBy(key)))
    grid = per.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(6))).alias("weekday"))
    site = per.select(key, "_site").distinct()
    return (grid.join(per.drop("_site"), [key, "weekday"], "left").join(site, key, "left")
            .select(key, "weekday", F.coalesce("total", F.lit(0.0)).alias("total"),
                    F.coalesce(F.try_divide(F.col("total"), F.col("_site")), F.lit(0.0)).alias("share")))


def weekday_scale(load: DataFrame, pv: DataFrame, consumed_share, key="site_id") -> DataFrame:
    """pv_weekday_scale: self-consumed PV rescaled per weekday to the load's weekday shares.

    factor(site, wd) = total_pv(site) * share_load(site, wd) / pv(site, wd), 0 if pv <= 0.
    ``consumed_share`` is a Column or number (per-site values come from a join).
    """
    cs = consumed_share if not isinstance(consumed_share, (int, float)) else F.lit(float(consumed_share))
    pvs = pv.select(key, "timestamp_utc", F.weekday("timestamp_utc").alias("weekday"),
                    (F.col("pv_generation_kwh") * cs).alias("self_kwh"))
    # load share per (site, weekday): a partial aggregate plus a bounded window (≤ 7 rows
    # per site); weekdays without load simply have no row and get share 0 below
    site = Window.partitionBy(key)
    shares = (load.groupBy(key, F.weekday("timestamp_utc").alias("weekday"))
              .agg(F.sum("grid_load_kwh").alias("_t"))
              .select(key, "weekday", F.try_divide(F.col("_t"), F.sum("_t").over(site)).alias("share")))
    pw = pvs.groupBy(key, "weekday").agg(F.sum("self_kwh").alias("pv_wd"))
    # ≤ 7 rows per site: a bounded window gives the site's PV total without a join
    pw = pw.withColumn("pv_total", F.sum("pv_wd").over(Window.partitionBy(key)))
    fac = (grown(pw, shares, [key, "weekday"], "left")
           .select(key, "weekday",
                   F.when(F.col("pv_wd") > 0,
                          F.col("pv_total") * F.coalesce("share", F.lit(0.0)) / F.col("pv_wd"))
                   .otherwise(F.lit(0.0)).alias("factor")))
    return (grown(pvs, fac, [key, "weekday"])
            .select(key, "timestamp_utc", (F.col("self_kwh") * F.col("factor")).alias("pv_scaled_kwh")))


def merge_load_pv(load: DataFrame, scaled: DataFrame, key="site_id") -> DataFrame:
    """pv_merge / jn_load_pv: load ⟕ scaled PV on (site, timestamp), missing PV -> 0."""
    j = grown(load, scaled, [key, "timestamp_utc"], "left")
    pv = F.coalesce(F.col("pv_scaled_kwh"), F.lit(0.0))
    return j.select(key, "timestamp_utc", "grid_load_kwh",
                    (F.col("grid_load_kwh") + pv).alias("consumption_kwh"), pv.alias("pv_load_kwh"))


def average_week(profile: DataFrame, key="site_id", tz: str | None = None) -> DataFrame:
    """agg_average_week: mean value and PV per quarter-hour of the week (672 slots per
    site, empty slot = 0).  ``value = consumption ?? grid_load ?? 0``.  ``tz`` shifts the
    slotting into a viewer's time zone (N13); default is the stored UTC wall clock."""
    ts = F.col("timestamp_utc")
    if tz:
        ts = F.from_utc_timestamp(ts.cast("timestamp"), tz)
    cols = set(profile.columns)
    val = F.coalesce(*[F.col(c) for c in ("consumption_kwh", "grid_load_kwh") if c in cols], F.lit(0.0))
    pv = F.coalesce(F.col("pv_load_kwh"), F.lit(0.0)) if "pv_load_kwh" in cols else F.lit(0.0)
    agg = (profile.groupBy(key, slot_of(ts).alias("slot"))
           .agg(F.avg(val).alias("value"), F.avg(pv).alias("pv")))
    # sites taken from the (small) slot aggregate, not from the raw profile
    grid = agg.select(key).distinct().select(
        key, F.explode(F.sequence(F.lit(0), F.lit(SLOTS_PER_WEEK - 1))).alias("slot"))
    return (grid.join(agg, [key, "slot"], "left")
            .select(key, F.col("slot").alias("global_index"), slot_label("slot").alias("label"),
                    F.coalesce("value", F.lit(0.0)).alias("value"),
                    F.coalesce("pv", F.lit(0.0)).alias("pv")))


WATERFALL_STEPS = ["peak_shaving_benefit", "energy_procurement_optimization", "trading_revenue"]


def waterfall(ben: DataFrame, key="config_id") -> DataFrame:
    """win_waterfall: [start, end] per component as a running sum, plus the total bar.
    NULL benefits count as 0 (the UI replaces missing predictions by 0)."""
    steps = F.inline(F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(n).alias("component"),
                 F.coalesce(F.col(n), F.lit(0.0)).alias("amount"))
        for i, n in enumerate(WATERFALL_STEPS)]))
    long = ben.select(key, steps)
    w = Window.partitionBy(key).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    run = long.withColumn("bar_end", F.sum("amount").over(w))
    bars = run.select(key, "step", "component", (F.col("bar_end") - F.col("amount")).alias("bar_start"), "bar_end")
    total = (long.groupBy(key).agg(F.sum("amount").alias("bar_end"))
             .select(key, F.lit(len(WATERFALL_STEPS)).alias("step"), F.lit("total").alias("component"),
                     F.lit(0.0).alias("bar_start"), "bar_end"))
    return bars.unionByName(total)


def profile_view(profile: DataFrame, key="site_id") -> DataFrame:
    """snk_profile_view: doubles rounded to 2 (half-even like pandas), ISO-8601 'Z' times."""
    out = [F.col(key), F.date_format("timestamp_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp_utc")]
    for c, t in profile.dtypes:
        if c not in (key, "timestamp_utc") and t == "double":
            out.append(F.bround(c, 2).alias(c))
    return profile.select(*out)


def ratio_feature(direct: DataFrame, profile: DataFrame, numerator: str, column: str,
                  name: str, key="site_id") -> DataFrame:
    """ft_ratio: direct input ÷ Σ series column per site; NULL if 0 or missing."""
    den = profile.groupBy(key).agg(F.sum(column).alias("_den"))
    return (direct.select(key, numerator).join(den, key, "left")
            .select(key, F.when(F.col("_den") != 0, F.try_divide(F.col(numerator), F.col("_den"))).alias(name)))
