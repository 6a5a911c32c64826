"""Prefix look-up against a register.

"First register row whose key starts with the query" is a theta join.  Instead of a
nested-loop or cross join, each register row emits every prefix of its key (bounded
by the key length, e.g. 5 for a postcode), which turns the look-up into an equi-join
on ``prefix``; the first row per query is a ``min(struct(order, ...))`` partial
aggregate.  Exact, shuffle-joinable, no broadcast assumption about the register.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prefix_lookup(queries: DataFrame, qcol: str, register: DataFrame, key: str,
                  order: str, payload) -> DataFrame:
    payload = list(payload)
    k = F.col(key)
    pref = register.select(
        F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(k), F.lit(1))),
                              lambda i: F.substring(k, 1, i))).alias("prefix"),
        F.struct(F.col(order).alias("_o"), *[F.col(c) for c in payload]).alias("_r"))
    best = pref.groupBy("prefix").agg(F.min("_r").alias("_r"))
    q = queries.select(F.col(qcol).alias("prefix")).distinct()
    return (q.join(best, "prefix", "left")
            .select(F.col("prefix").alias(qcol), *[F.col(f"_r.{c}").alias(c) for c in payload]))
