"""Shared helpers for plan modules: the per-query model accessor and output rounding."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..sources import tables as T
from ..sources.store import read_model


class Model:
    """The storage-sizing model over one scale-factor directory.

    The four warehouse tables are stored Parquet derived once from the driver tables
    (:mod:`capacitron.sources.store`); series and profiles are read from the driver
    tables directly.
    """

    def __init__(self, spark, sf_dir):
        self.spark, self.sf = spark, sf_dir

    def read(self, name):
        return T.read(self.spark, self.sf, name)

    @cached_property
    def configs(self) -> DataFrame:
        return read_model(self.spark, self.sf, "battery_configs")

    @cached_property
    def kpis(self) -> DataFrame:
        return read_model(self.spark, self.sf, "kpi_summary")

    @cached_property
    def runs(self) -> DataFrame:
        return read_model(self.spark, self.sf, "runs")

    @cached_property
    def clients(self) -> DataFrame:
        return read_model(self.spark, self.sf, "clients")

    @cached_property
    def series(self) -> DataFrame:
        return T.series_events(self.spark, self.sf)

    @cached_property
    def ship(self) -> DataFrame:
        return T.series_shipments(self.spark, self.sf)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every floating column (the oracle rounds the same columns)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f"`{f.name}`"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)
