"""Row windows over long series without one task per series.

A heavy series (:func:`.series.heavy_keys`) is numbered in time order by a parallel sort
(:func:`.ranking.ranked`) and cut into segments of equal row counts.  The last rows of a segment
are copied in front of the next one, as many as a window reaches back, so a window inside
(key, segment) sees the rows it would see in the whole series; the copies leave the result.
Light series keep the plain window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .ranking import ranked
from .series import heavy_keys

#: Rows of a segment.
ROWS = 50_000


def segmented(series: DataFrame, reach: int, key: str = "config_id", ts: str = "timestamp", rows: int | None = None) -> DataFrame:
    """``series`` with ``_at`` (place in its key), ``_seg`` and ``_copy``: every row in its segment,
    and the last ``reach`` rows of a segment once more in the next."""
    rows = max(rows or ROWS, reach + 1)
    placed = ranked(series, [key, ts], "_at", [key])
    own = F.struct(F.expr(f"_at div {rows}").alias("seg"), F.lit(False).alias("copy"))
    ahead = F.struct(F.expr(f"_at div {rows} + 1").alias("seg"), F.lit(True).alias("copy"))
    late = F.col("_at") % rows >= rows - reach
    return placed.withColumn("_s", F.explode(F.when(late, F.array(own, ahead)).otherwise(F.array(own)))) \
        .withColumn("_seg", F.col("_s.seg")).withColumn("_copy", F.col("_s.copy")).drop("_s")


def row_windows(series: DataFrame, columns: Callable[[WindowSpec], dict[str, Column]], reach: int,
                key: str = "config_id", ts: str = "timestamp") -> DataFrame:
    """``series`` with the columns that ``columns(window)`` builds over a window in time order.

    ``reach`` is how many rows before its own the columns look at, at most.  Rows of equal key
    and time have no defined order, as in any window."""
    heavy = heavy_keys(series, key)
    plain = Window.partitionBy(key).orderBy(ts)
    if heavy is None:
        return series.withColumns(columns(plain))
    light = series.join(heavy, key, "left_anti").withColumns(columns(plain))
    cut = segmented(series.join(heavy, key, "left_semi"), reach, key, ts)
    long_ = cut.withColumns(columns(Window.partitionBy(key, "_seg").orderBy("_at"))).where(~F.col("_copy")).drop("_at", "_seg", "_copy")
    return light.unionByName(long_)


def differences(series: DataFrame, column: str, name: str, key: str = "config_id", ts: str = "timestamp") -> DataFrame:
    """win_diff: each row's difference from the row before it in its series."""
    return row_windows(series, lambda w: {name: F.col(column) - F.lag(column).over(w)}, 1, key, ts)
