"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..N-1 in a defined order.  A keyed Feistel network permutes the next power
of four above N; a value that lands at N or beyond is walked through the network again, which
makes the whole map a permutation of 0..N-1.  A row's place ``p`` then gives ``shard = p % k``
and ``slot = p // k``: shard sizes differ by at most one row, slots have no gaps, and both
directions can be computed for any row without reading the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .shared import text_or_empty, written

ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser (splitmix64 constants) used as the round function."""
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    with np.errstate(over="ignore"):
        base = np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return [int(k) for k in _mix(base, seed % (1 << 64))]


def _half_bits(n: int) -> int:
    return max(1, ((n - 1).bit_length() + 1) // 2)


def _once(x, half: int, keys) -> np.ndarray:
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> h, x & mask
    for k in keys:
        left, right = right, left ^ (_mix(right, k) & mask)
    return (right << h) | left


def _walk(x, n: int, seed: int, backwards: bool) -> np.ndarray:
    x = np.array(x, dtype=np.uint64)
    if n <= 1:
        return x.astype(np.int64)
    half, keys = _half_bits(n), _keys(seed)
    keys = keys[::-1] if backwards else keys
    with np.errstate(over="ignore"):
        x = _once(x, half, keys)
        out = x >= np.uint64(n)
        while out.any():
            x[out] = _once(x[out], half, keys)
            out = x >= np.uint64(n)
    return x.astype(np.int64)


def permute(rows, n: int, seed: int) -> np.ndarray:
    """Places of the given row numbers in the shuffled order of ``n`` rows."""
    return _walk(rows, n, seed, False)


def unpermute(places, n: int, seed: int) -> np.ndarray:
    """The row numbers that stand at the given places (the inverse of :func:`permute`)."""
    return _walk(places, n, seed, True)


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The row number that fills a slot of a shard."""
    return int(unpermute([slot * shards + shard], n, seed)[0])


def row_numbers(df: DataFrame, order: list[str]) -> DataFrame:
    """Add ``row_number`` 0..N-1 in the order of the given columns.

    Range partitions are sorted and numbered locally, the result is written once (so that
    sampled range bounds cannot change between uses), and the start of each partition comes
    from a running sum over one row per partition, the only thing broadcast: it has at most
    as many rows as the shuffle has partitions.
    """
    local = written(df.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("_at", F.monotonically_increasing_id())
                    .withColumn("_part", F.shiftright("_at", 33).cast("int")), "numbered")
    counts = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (local.join(F.broadcast(starts), "_part")
            .withColumn("row_number", F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1))
            .drop("_at", "_part", "_start", "_n"))


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 20240229) -> DataFrame:
    """Shard and slot of every document under the law ``rows`` (sizes at most one row apart).

    ``doc_id, size, text_crc32, law, row_number, shard, slot, grown_shard``; ``size`` is the
    UTF-8 length plus one, and ``grown_shard`` is null because this law does not keep rows in
    place when a shard is added.  The order that numbers the rows is (doc_id, checksum, size,
    text hash), null ids first: repeated rows are interchangeable, so ties change nothing.
    Null texts count as empty.  An empty table gives an empty result.  Other columns are
    ignored.  Only ids, sizes and checksums are shuffled, never texts.
    """
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text_or_empty()) + 1).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
        F.xxhash64(text_or_empty()).alias("_tie"))
    rows = row_numbers(slim, ["doc_id", "text_crc32", "size", "_tie"]).drop("_tie")
    n = rows.count()

    @F.pandas_udf(T.LongType())
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), n, seed))

    return (rows.withColumn("_place", place("row_number"))
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "row_number",
                    (F.col("_place") % shards).cast("int").alias("shard"),
                    F.expr(f"_place div {shards}").cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
