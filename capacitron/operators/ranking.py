"""Global ranks without a window over all rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

_INDEX = (1 << 33) - 1           # the low bits of monotonically_increasing_id count rows of a task


def ranked(df: DataFrame, order, name: str = "rank", by=()) -> DataFrame:
    """``df`` with each row's place (from 0) in ``order``, among the rows that agree in ``by``.

    Rows are range-partitioned and sorted in parallel, every task numbers its own rows, and the
    tasks' counts (a row per task and group) tell where each task's numbers begin.  The numbered
    rows are written to the shared folder first, so tasks and counts belong together."""
    by, order = list(by), list(order)
    keys = [F.col(c) for c in by] + [F.col(c) if isinstance(c, str) else c for c in order]
    path = scratch_path(df.sparkSession, f"ranked-{uuid.uuid4().hex}")
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        "*", F.spark_partition_id().alias("_rank_task"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_INDEX)).alias("_rank_at")).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    per = rows.groupBy(*by, "_rank_task").agg(F.count(F.lit(1)).alias("_rank_n"), F.min("_rank_at").alias("_rank_first"))
    # one row per task and group: the window is over tasks, not over rows
    before = Window.partitionBy(*by).orderBy("_rank_task").rowsBetween(Window.unboundedPreceding, -1) if by else \
        Window.orderBy("_rank_task").rowsBetween(Window.unboundedPreceding, -1)
    start = per.withColumn("_rank_start", F.coalesce(F.sum("_rank_n").over(before), F.lit(0)) - F.col("_rank_first")).drop("_rank_n", "_rank_first")
    return rows.join(start, [*by, "_rank_task"]).withColumn(name, F.col("_rank_at") + F.col("_rank_start")).drop("_rank_task", "_rank_at", "_rank_start")
