"""Joins of tables that all grow with the data.

Spark sizes a stored table by its files, and one made from it in proportion to its columns.  A
compressed file is a tenth to a fiftieth of its rows in memory, so a table of millions of rows can
look small enough to be sent whole to the driver and to every executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def grown(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """``left.join(right, on, how)``, sorted on both sides whatever their sizes are taken to be."""
    return left.join(right.hint("merge"), on, how)
