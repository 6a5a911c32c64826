"""Connected components of an edge table by alternating large and small stars.

Edge tables of up to ``FEW_EDGES`` rows are joined in one task (a bounded number of rows, a few
MB) without rounds.  For all others every round is two aggregations (map-side combined, so a node with very many neighbours is
pre-aggregated before the shuffle) and two equi-joins (which AQE splits when skewed).  Each
half round is written to the shared folder; nothing is collected but one checksum row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Edges that one task joins at once; more go through the rounds.
FEW_EDGES = 100_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, component`` of all nodes of a few edges; the smaller root leads."""
    up, kind = {}, None

    def root(x):
        while (y := up[x]) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        kind = batch.schema.field("u").type
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            up.setdefault(u, u)
            up.setdefault(v, v)
            a, b = root(u), root(v)
            if a != b:
                up[max(a, b)] = min(a, b)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([root(x) for x in up], kind)], names=["node", "component"])


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(low, "u")
    return (joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).distinct())


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """``(node, component)`` for every node that has an edge; ``component`` is the smallest
    node of the component.  Node values may be of any orderable type.  Null ends and
    self-loops are ignored; an empty edge table gives an empty result.
    """
    e = written(edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
                .where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct(), "edges")

    def mark(t):
        return t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = mark(e)
    kind = e.schema["u"].dataType.simpleString()
    if before[0] <= FEW_EDGES and kind in ("int", "bigint", "string"):
        return written(e.coalesce(1).mapInArrow(_forest, f"node {kind}, component {kind}"), "components")
    while before[0]:
        e = written(_large_star(e), "large-star")
        e = written(_small_star(e), "small-star")
        now = mark(e)
        if now == before:
            break
        before = now
    star = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.union(e.select(F.col("v"), F.col("v")).distinct())
