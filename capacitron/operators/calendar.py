"""Declared-only calendar / window features (SURVEY §2.13 dx_rolling, dx_fourier,
dx_peak_window, dx_offpeak_days) as aggregates and bounded window frames."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import row_windows

# ---------------------------------------------------------------------------
# Fixed values from the reference's sample inputs.
# ---------------------------------------------------------------------------
# Off-peak calendar 2024: holidays and Christmas period (weekends are derived).
OFFPEAK_DAYS_2024 = [
    ("2024-01-01", "Neujahr", "Holiday"),
    ("2024-03-29", "Karfreitag", "Holiday"),
    ("2024-04-01", "Ostermontag", "Holiday"),
    ("2024-05-01", "Tag der Arbeit", "Holiday"),
    ("2024-05-09", "Christi Himmelfahrt", "Holiday"),
    ("2024-05-20", "Pfingstmontag", "Holiday"),
    ("2024-10-03", "Tag der Deutschen Einheit", "Holiday"),
    ("2024-12-24", "Christmas Period", "Christmas Holidays"),
    ("2024-12-25", "1. Weihnachtsfeiertag", "Holiday"),
    ("2024-12-26", "2. Weihnachtsfeiertag", "Holiday"),
    ("2024-12-27", "Christmas Period", "Christmas Holidays"),
    ("2024-12-30", "Christmas Period", "Christmas Holidays"),
    ("2024-12-31", "Christmas Period", "Christmas Holidays"),
]
# Sample peak windows of one season: months and [start, end) wall-clock times.
PEAK_WINDOW_MONTHS = [1, 2, 12]
PEAK_WINDOW_TIMES = [("7:45", "9:00"), ("13:00", "13:15"), ("16:45", "20:00")]
ROLLING_WINDOWS = [4, 24, 96]
FOURIER_PERIODS = [96, 672]        # quarter-hours: one day, one week


def rolling(series: DataFrame, col: str = "load_kwh", windows=ROLLING_WINDOWS,
            key="config_id", ts="timestamp") -> DataFrame:
    """Rolling mean / std / max over the last w readings, summarised per series; long series are
    cut into overlapping segments (:mod:`.segments`)."""
    def columns(base):
        out = {}
        for w in windows:
            frame = base.rowsBetween(-(w - 1), 0)
            out |= {f"_m{w}": F.avg(col).over(frame), f"_s{w}": F.stddev_samp(col).over(frame), f"_x{w}": F.max(col).over(frame)}
        return out

    aggs = []
    for w in windows:
        aggs += [F.max(f"_m{w}").alias(f"roll{w}_mean_max"), F.avg(f"_m{w}").alias(f"roll{w}_mean_mean"),
                 F.avg(f"_s{w}").alias(f"roll{w}_std_mean"), F.avg(f"_x{w}").alias(f"roll{w}_max_mean")]
    return row_windows(series.select(key, ts, col), columns, max(windows) - 1, key, ts).groupBy(key).agg(*aggs)


def fourier(series: DataFrame, col: str = "load_kwh", periods=FOURIER_PERIODS,
            key="config_id", ts="timestamp") -> DataFrame:
    """Amplitude 2/n·|Σ v·e^(−2πi t/P)| with t in quarter-hours since the epoch."""
    t = F.unix_micros(F.col(ts).cast("timestamp")) / 9e8
    v = F.col(col)
    aggs = []
    for p in periods:
        ang = t * (2 * math.pi / p)
        c, s = F.sum(v * F.cos(ang)), F.sum(v * F.sin(ang))
        aggs.append((2 * F.sqrt(c * c + s * s) / F.count(v)).alias(f"fourier_p{p}_amplitude"))
    return series.groupBy(key).agg(*aggs)


def _minutes(hhmm: str) -> int:
    h, m = hhmm.split(":")
    return int(h) * 60 + int(m)


def in_peak_window(ts, months=PEAK_WINDOW_MONTHS, times=PEAK_WINDOW_TIMES):
    t = F.col(ts) if isinstance(ts, str) else ts
    mod = F.hour(t) * 60 + F.minute(t)
    inside = F.lit(False)
    for a, b in times:
        inside = inside | ((mod >= _minutes(a)) & (mod < _minutes(b)))
    return F.month(t).isin(*months) & inside


def peak_window(series: DataFrame, col: str = "load_kwh", key="config_id", ts="timestamp") -> DataFrame:
    """Max / mean of the series inside vs outside the configured peak windows."""
    inside = in_peak_window(ts)
    v = F.col(col)
    return series.groupBy(key).agg(
        F.max(F.when(inside, v)).alias("peak_window_max"), F.avg(F.when(inside, v)).alias("peak_window_mean"),
        F.max(F.when(~inside, v)).alias("off_window_max"), F.avg(F.when(~inside, v)).alias("off_window_mean"))


def offpeak_calendar(spark):
    """The fixed holiday table (13 rows) — a bounded dimension, safe to broadcast."""
    return spark.createDataFrame([(d, desc, cat) for d, desc, cat in OFFPEAK_DAYS_2024],
                                 "date string, description string, category string").select(
        F.to_date("date").alias("date"), "description", "category")


def offpeak_days(series: DataFrame, col: str = "load_kwh", key="config_id", ts="timestamp") -> DataFrame:
    """Load per day category: listed holiday / Christmas period, else weekend, else workday."""
    cal = offpeak_calendar(series.sparkSession)
    d = series.withColumn("date", F.to_date(ts))
    j = d.join(F.broadcast(cal), "date", "left")
    cat = F.coalesce(F.col("category"), F.when(F.weekday(ts) >= 5, F.lit("Weekend")).otherwise(F.lit("Workday")))
    return j.groupBy(key, cat.alias("category")).agg(F.sum(col).alias("load"), F.count("*").alias("n_rows"),
                                                     F.count_distinct("date").alias("n_days"))
