"""Exact Jaccard similarity join of shingle sets with pivots, windows and recursion.

Jaccard distance is a metric, but between unrelated documents it is 1, so document pivots alone
separate nothing.  The join therefore works on three levels; the last two make it exact:

* Set pivots first.  Sets that agree in a band of two min-hashes form a cell, and the smallest
  set of a cell is its pivot.  Every set is measured against the pivots of its cells, a few pairs
  a set however large a cell is; the links found join near copies into groups.
* Pivot shingles cut the space into regions.  All shingles have one global order, rare ones
  first (a fixed table of 65,536 bucket counts defines it).  A set belongs to the region of its
  first shingle and is replicated into every further region its partners' nearest pivot may be:
  if x and y are linked, at most a fifth of x lies outside y, so the window is the first
  ``n - ceil(0.8 n) + 1`` shingles of a set of n.  A region whose members are one group already
  is finished.  Elsewhere the members outside the region's largest group meet all others that
  are not of their own group.
* Where many members lie outside the largest group, sets become pivots again: a few of them are
  measured against the whole region, members within the radius are linked, and only members
  still outside go on to the next round.  Their known distances to an earlier pivot exclude by
  the triangle inequality the members they cannot be linked with.

Candidate pairs are first held against a lower bound of their symmetric difference (parity
maps), the rest is counted exactly from the texts, which travel compressed, all pairs of one set
together (in portions, if they are many).  Equal sets are one node throughout.  Sets are
identified by 64-bit hashes of their shingles and shingles by 64-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import finished, freed, written
from .shingles import BUCKETS, Shingler, bucket_counts, min_hash_bands, ordered, parity_distance, parity_map, set_id

WIDTH = 5
#: A region with more pairs than this for each member is joined by set pivots, ``PIVOTS`` in the
#: first round, then more.
REGION, PIVOTS = 32, 16
#: Bands of two min-hashes that make the cells of the first level.
BANDS = 4
#: Partners of one set that are verified together.
PORTION = 512
#: Pivots and members that meet in a task at once, and earlier regions that a member carries.
PIVOT_BLOCK, MEMBER_BLOCK, EARLY = 512, 2048, 64


def _need(a, b):
    """Least intersection of sets of a and b shingles with 100 * both >= 80 * either."""
    return -(-4 * (a + b) // 9)


# --- pass 1: nodes and bucket counts ----------------------------------------------------------

def _nodes(width: int):
    names = ["doc_id", "text_hash", "n", "node", "map", "cells", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts = Shingler(width), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            n, node, maps, cells = [], [], [], []
            for text in batch.column("text"):
                s = shingler(text.as_py())
                counts += bucket_counts(s)
                n.append(len(s))
                node.append(set_id(s))
                maps.append(parity_map(s))
                cells.append(min_hash_bands(s, BANDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(node, pa.int64()),
                 pa.array(maps, pa.binary()), pa.array(cells, pa.list_(pa.int64())), pa.nulls(len(n), pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays(
            [*[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.binary()), pa.nulls(1, pa.list_(pa.int64())),
             pa.array([counts.astype("<i8").tobytes()], pa.binary())], names=names)
    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for c in batch.column("counts"):
            total += np.frombuffer(c.as_py(), "<i8")
    yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["counts"])


def _bucket_ranks(counts: DataFrame) -> np.ndarray:
    """Ranks of the buckets by their counts, summed in a tree of tasks: one 512 KB row each."""
    parts = counts.count()
    while parts > 1:
        parts = -(-parts // 64)
        counts = written(counts.repartition(parts).mapInArrow(freed(_add), "counts binary"), "bucket-counts")
    total = np.frombuffer(counts.first()[0], "<i8")
    rank = np.empty(BUCKETS, np.uint64)
    rank[np.argsort(total, kind="stable")] = np.arange(BUCKETS, dtype=np.uint64)
    return rank


# --- pass 2: regions --------------------------------------------------------------------------

def _regions(held, width: int):
    """A row for every region a set is in: its shingle, and the shingle's place in the set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, rank, seen = Shingler(width), np.frombuffer(held.value, "<u8").astype(np.uint64), set()
        for batch in batches:
            keys, nodes, sizes = [], [], []
            for text in batch.column("text"):
                s = shingler(text.as_py())
                node = set_id(s)
                if not len(s) or node in seen:                 # a copy in the same task adds nothing
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(node)
                keys.append(ordered(s, rank)[:len(s) - -(-8 * len(s) // 10) + 1].view(np.int64))
                nodes.append(node)
                sizes.append(len(s))
            if keys:
                each = [len(k) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(np.repeat(np.array(nodes, np.int64), each)),
                     pa.array(np.repeat(np.array(sizes, np.int32), each)),
                     pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in each]))],
                    names=["key", "node", "n", "place"])
    return run


def _shared_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of regions with more than one.  Rows come sorted by region and set; equal ones are
    one.  The last row of a batch waits for the next one, no region is held."""
    held, known, last = None, None, None
    for batch in batches:
        key, node = batch.column("key").to_numpy(), batch.column("node").to_numpy()
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        new[0] = last != (key[0], node[0])
        last = (key[-1], node[-1])
        batch = batch.filter(pa.array(new))
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key = batch.column("key").to_numpy()
        same = np.concatenate(([key[0] == known], key[1:] == key[:-1], [False]))
        keep = same[1:] | same[:-1]
        cut = len(key) if keep[-1] else len(key) - 1
        held = batch.slice(cut) if cut < len(key) else None
        known = key[-1] if keep[-1] else None
        yield batch.slice(0, cut).filter(pa.array(keep[:cut]))


# --- verification -------------------------------------------------------------------------------

def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
        bound = np.array([parity_distance(x.as_py(), y.as_py()) for x, y in zip(batch.column("ma"), batch.column("mb"))], np.int64)
        keep = bound <= na + nb - 2 * _need(na, nb)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("a", "b", "na", "nb")), pa.array(bound), pa.array(keep, pa.bool_())],
            names=["a", "b", "na", "nb", "bound", "ok"])


def _zip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array([pack(t.as_buffer()) for t in batch.column("text")], pa.binary())],
            names=["doc_id", "text_hash", "zip"])


def _intersections(width: int):
    """Shared shingles of each set with the one that leads its portion (``b`` null)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        unpack, shingler, lead = zstandard.ZstdDecompressor().decompress, Shingler(width), None
        for batch in batches:
            rows = []
            for a, b, na, nb, value in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "na", "nb", "zip"))):
                s = shingler(unpack(value).decode())
                if b is None:
                    lead = s
                    continue
                at = np.minimum(np.searchsorted(lead, s), len(lead) - 1)
                rows.append((a, b, na, nb, int((lead[at] == s).sum())))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)],
                                             names=["a", "b", "na", "nb", "shared"])
    return run


class _Measure:
    """Bounds and exact intersections of candidate pairs ``a, b, na, nb``."""

    def __init__(self, rows: DataFrame, sets: DataFrame, width: int):
        self.rows, self.sets, self.width = rows, sets, width

    def texts(self, nodes: DataFrame) -> DataFrame:
        """``node, zip``: the text of one holder of each of some sets."""
        holders = self.sets.join(nodes.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "text_hash")
        packed = self.rows.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(freed(_zip), "doc_id long, text_hash long, zip binary")
        return written(packed.join(holders, ["doc_id", "text_hash"]).select("node", "zip").dropDuplicates(["node"]), "texts")

    def bounds(self, pairs: DataFrame) -> DataFrame:
        """Lower bounds of the symmetric differences, and whether a pair may be linked (``ok``)."""
        m = self.sets
        some = pairs.join(m.select(F.col("node").alias("a"), F.col("map").alias("ma")), "a") \
            .join(m.select(F.col("node").alias("b"), F.col("map").alias("mb")), "b")
        return written(some.mapInArrow(freed(_plausible), "a long, b long, na long, nb long, bound long, ok boolean"), "bounds")

    def exact(self, pairs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
        """``a, b, na, nb, shared``; the partners of a set in portions, each behind that set's text."""
        if texts is None:
            texts = self.texts(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        many = written(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n")), "partners")
        dealt = pairs.join(many, "a").withColumn("_part", F.pmod(F.xxhash64("b"), F.expr(f"1 + _n div {PORTION}")).cast("int")).drop("_n")
        partners = dealt.join(texts.withColumnRenamed("node", "b"), "b").select("a", "_part", "b", "na", "nb", "zip")
        null = F.lit(None).cast("long")
        leads = dealt.select("a", "_part").distinct().join(texts.withColumnRenamed("node", "a"), "a") \
            .select("a", "_part", null.alias("b"), null.alias("na"), null.alias("nb"), "zip")
        together = leads.union(partners).repartition("a", "_part").sortWithinPartitions("a", "_part", F.col("b").asc_nulls_first())
        return written(together.select("a", "b", "na", "nb", "zip").mapInArrow(freed(_intersections(self.width)), "a long, b long, na long, nb long, shared long"), "measured")

    def links(self, pairs: DataFrame) -> DataFrame:
        return self.exact(self.bounds(pairs).where("ok").drop("bound", "ok")).where(_LINKED).select("a", "b")


_LINKED = "100 * shared >= 80 * (na + nb - shared)"


_NEAR_SIZE = "5 * least(na, nb) >= 4 * greatest(na, nb)"


def _ordered_pair() -> list:
    """``a < b`` with their sizes, from ``node, n`` and ``p, np``."""
    return [F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b"),
            F.expr("CASE WHEN node < p THEN n ELSE np END").cast("long").alias("na"),
            F.expr("CASE WHEN node < p THEN np ELSE n END").cast("long").alias("nb")]


def _near_pivots(sets: DataFrame, measure: _Measure) -> DataFrame:
    """Links of sets with the pivots (smallest sets) of their min-hash cells."""
    cells = sets.select("node", "n", F.explode("cells").alias("cell"))
    pivot = written(cells.groupBy("cell").agg(F.min(F.struct("node", "n")).alias("p"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
                    .select("cell", F.col("p.node").alias("p"), F.col("p.n").alias("np")), "cell-pivots")
    pairs = cells.join(pivot, "cell").where("node <> p").select(*_ordered_pair()).where(_NEAR_SIZE).distinct()
    return written(measure.links(pairs), "near-links")


def _between_groups(shared: DataFrame, group: DataFrame) -> DataFrame:
    """Members of the regions that hold more than one group (``node, component``): ``key, node, n,
    place``, their group, the region's largest group, and whether few pairs are left in it."""
    named = shared.join(group.withColumnRenamed("component", "_g"), "node", "left").withColumn("_g", F.coalesce("_g", "node"))
    size = named.groupBy("key", "_g").agg(F.count(F.lit(1)).alias("_c"))
    region = size.groupBy("key").agg(F.sum("_c").alias("_m"), F.sum(F.col("_c") * F.col("_c")).alias("_q"),
                                     F.max_by("_g", F.struct("_c", "_g")).alias("_most")).where("_m * _m > _q")
    region = written(region.select("key", "_most", F.expr(f"_m * _m - _q <= 2 * {REGION} * _m").alias("_few")), "open-regions")
    return written(named.join(region, "key"), "open-members")


def _few_pairs(members: DataFrame) -> DataFrame:
    """Pairs across groups in regions with few of them: members outside the largest group with all
    members of other groups.  A linked pair's first common region passes the place test."""
    few = members.where("_few")
    other = few.select("key", F.col("node").alias("p"), F.col("n").alias("np"), F.col("place").alias("_pp"), F.col("_g").alias("_pg"))
    met = few.where("_g <> _most").join(other, "key").where("_g <> _pg AND (_pg = _most OR node < p)") \
        .where("5 * least(n, np) >= 4 * greatest(n, np) AND least(n - place, np - _pp) >= (4 * (n + np) + 8) div 9")
    return met.select(*_ordered_pair()).distinct()


def _in_order(key: str):
    """A region's shingle as a number in the global (unsigned) order."""
    return F.col(key).bitwiseXOR(F.lit(-(1 << 63)))


def _meet(pivots: list, members: list) -> pa.RecordBatch:
    """Pairs of a block of pivots and a block of members of one region.

    A pair that shares an earlier large region is left to that one (``early`` may be cut short,
    then some pairs are met again).  A pivot that leads its region meets every member."""
    p, m = (pa.Table.from_batches(rows).combine_chunks() for rows in (pivots, members))
    of = {c: (p.column(c).to_numpy(), m.column(c).to_numpy()) for c in ("node", "n", "place", "_g", "low", "high")}
    (pn, mn), (ps, ms), (pp, mp), (pg, mg), (pl, ml), (ph, mh) = of.values()
    lead = p.column("lead").to_numpy(zero_copy_only=False)
    here = p.column("at")[0].as_py()
    early = [[{k for k in row if k < here} for row in t.column("early").to_pylist()] for t in (p, m)]
    known = {k: i for i, k in enumerate(set().union(*early[0]) & set().union(*early[1]))}
    maps = [[np.frombuffer(v.as_buffer(), np.uint8) for v in t.column("map").combine_chunks()] for t in (p, m)]
    out = []
    if known:                                                  # members by earlier regions, as columns of bits
        has = [np.zeros((len(rows), len(known) // 8 + 1), np.uint8) for rows in early]
        for bits, rows in zip(has, early):
            for i, row in enumerate(rows):
                for k in row:
                    if (j := known.get(k)) is not None:
                        bits[i, j >> 3] |= 1 << (j & 7)
    for i in range(len(pn)):
        near = (mn != pn[i]) & (5 * np.minimum(ms, ps[i]) >= 4 * np.maximum(ms, ps[i]))
        if not lead[i]:
            near &= (mg != pg[i]) & (9 * np.minimum(ms - mp, ps[i] - pp[i]) >= 4 * (ms + ps[i]))
            near &= ~((ml > ph[i] + 0.2 + 1e-9) | (pl[i] > mh + 0.2 + 1e-9))      # NaN, a distance not known, excludes nothing
            if known:
                near[near] = ~(has[1][near] & has[0][i]).any(1)
        at = np.flatnonzero(near)
        if len(at):
            out.append((np.full(len(at), pn[i]), mn[at], np.full(len(at), ps[i]), ms[at], _parity_distances(maps[0][i], [maps[1][j] for j in at]),
                        np.full(len(at), lead[i])))
    p, m, ps, ms, bound, lead = (np.concatenate(c) for c in zip(*out)) if out else [np.zeros(0, np.int64)] * 6
    ok = bound <= ps + ms - 2 * _need(ps, ms)
    keep, first = ok | (lead != 0), p < m
    return pa.RecordBatch.from_arrays(
        [pa.array(np.where(first, x, y)[keep].astype(np.int64)) for x, y in ((p, m), (m, p), (ps, ms), (ms, ps))]
        + [pa.array(bound[keep].astype(np.int64)), pa.array(ok[keep].astype(bool))], names=["a", "b", "na", "nb", "bound", "ok"])


def _parity_distances(one: np.ndarray, others: list) -> np.ndarray:
    """Lower bounds of the symmetric differences of a set with many, by maps of equal size at once."""
    sizes, out = np.array([len(o) for o in others]), np.zeros(len(others), np.int64)
    for size in np.unique(sizes):
        for at in np.array_split(at := np.flatnonzero(sizes == size), -(-len(at) * int(size) // (8 << 20))):
            x, y = one, np.stack([others[j] for j in at])
            while y.shape[1] > len(x):
                y = y[:, :y.shape[1] // 2] ^ y[:, y.shape[1] // 2:]
            while len(x) > y.shape[1]:
                x = x[:len(x) // 2] ^ x[len(x) // 2:]
            out[at] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every block of pivots with its block of members; rows come sorted by block, pivots first."""
    now, pivots, members = None, [], []
    for batch in batches:
        block = np.stack([batch.column(c).to_numpy() for c in ("key", "_pc", "_mc")], 1).astype(np.int64)
        pivot = batch.column("pivot").to_numpy(zero_copy_only=False)
        change = (block[1:] != block[:-1]).any(1) | (pivot[1:] != pivot[:-1])
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(block)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if now != tuple(block[a]):
                if pivots and members:
                    yield _meet(pivots, members)
                now, pivots, members = tuple(block[a]), [], []
            (pivots if pivot[a] else members).append(batch.slice(a, b - a))
    if pivots and members:
        yield _meet(pivots, members)


def _pivot_pairs(named: DataFrame, pivots: DataFrame, maps: DataFrame, first: DataFrame | None) -> DataFrame:
    """Pairs ``a, b, na, nb, bound, ok`` of pivots and members of their regions that may be linked
    (``ok``), and all pairs with the first pivot of a region in the first round.

    Pivots and members meet in blocks inside tasks: what is shuffled follows the members, and
    only pairs that pass every test become rows."""
    if first is None:
        known = named.withColumns({"low": F.lit(float("nan")), "high": F.lit(float("nan"))})
    else:
        known = named.join(first, ["key", "node"], "left").withColumns({c: F.coalesce(c, F.lit(float("nan"))) for c in ("low", "high")})
    wide = known.join(maps, "node")
    sizes = written(pivots.groupBy("key").agg(F.count(F.lit(1)).alias("_p")).join(named.groupBy("key").agg(F.count(F.lit(1)).alias("_m")), "key")
                    .select("key", F.expr(f"cast(1 + _p div {PIVOT_BLOCK} as int) AS _ps"), F.expr(f"cast(1 + _m div {MEMBER_BLOCK} as int) AS _ms")), "blocks")
    columns = ["key", "_pc", "_mc", "pivot", "lead", _in_order("key").alias("at"), "node", "n", "place", "_g", "low", "high", "early", "map"]
    mine = lambda many, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(many)).cast("int")
    one = wide.join(sizes, "key").withColumns({"_mc": mine("_ms", 1), "pivot": F.lit(False), "lead": F.lit(False)}) \
        .withColumn("_pc", F.explode(F.expr("sequence(0, _ps - 1)"))).select(*columns)
    other = wide.join(pivots, ["key", "node"]).join(sizes, "key") \
        .withColumns({"_pc": mine("_ps", 2), "pivot": F.lit(True), "lead": (F.col("_r") == 1) & F.lit(first is None)}) \
        .withColumn("_mc", F.explode(F.expr("sequence(0, _ms - 1)"))).select(*columns)
    together = other.union(one).repartition("key", "_pc", "_mc").sortWithinPartitions("key", "_pc", "_mc", F.desc("pivot"))
    return written(together.mapInArrow(freed(_blocks), "a long, b long, na long, nb long, bound long, ok boolean"), "bounds")


def _large_regions(members: DataFrame, links: DataFrame, measure: _Measure) -> DataFrame:
    """Links inside regions with many pairs between groups, found by rounds of set pivots.

    A member that has been a pivot has met the whole region.  Members of the region's largest
    group (by the links so far) need not meet each other.  So a region is finished when every
    other member has been a pivot."""
    texts = measure.texts(members)                             # texts are read once for all rounds
    early = members.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(_in_order("key"))), 1, EARLY).alias("early"))
    maps = written(early.join(measure.sets.select("node", "map"), "node"), "maps")
    done, pivots_now = None, PIVOTS
    first = None                           # (key, node, low, high): bounds of the distance to the first pivot
    while True:
        group = connected_components(links, "a", "b")
        named = written(members.join(group.withColumnRenamed("component", "_g"), "node", "left")
                        .withColumn("_g", F.coalesce("_g", "node")), "named")
        most = named.groupBy("key", "_g").count().groupBy("key").agg(F.max_by("_g", F.struct("count", "_g")).alias("_most"))
        left = named.join(most, "key").where("_g <> _most").select("key", "node")
        left = written(left if done is None else left.join(done, ["key", "node"], "left_anti"), "left")
        if left.isEmpty():
            return links
        order = Window.partitionBy("key").orderBy(F.xxhash64("node"), "node")
        pivots = written(left.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= pivots_now), "pivots")
        bounds = _pivot_pairs(named, pivots, maps, first)
        measured = measure.exact(bounds.where("ok").select("a", "b", "na", "nb").distinct(), texts)
        if first is None:
            # distances to the first pivot of each region: exact, or at least a lower bound
            exact = measured.selectExpr("a", "b", "1 - shared / (na + nb - shared) AS d")
            distance = bounds.select("a", "b", "na", "nb", "bound").distinct().join(exact, ["a", "b"], "left") \
                .selectExpr("a", "b", "coalesce(d, 2 * bound / (na + nb + bound)) AS low", "coalesce(d, 1D) AS high")
            ends = distance.union(distance.select("b", "a", "low", "high")).toDF("node", "p", "low", "high")
            lead = pivots.where("_r = 1").select("key", F.col("node").alias("p"))
            first = written(members.select("key", "node").join(lead, "key").join(ends, ["node", "p"])
                            .select("key", "node", "low", "high")
                            .union(lead.selectExpr("key", "p", "0D", "0D")), "first-pivot")
        links = written(links.union(measured.where(_LINKED).select("a", "b")).distinct(), "links")
        pivots_now *= 256                                       # few rounds, however many are left
        now = pivots.select("key", "node")
        done = written(now if done is None else done.union(now), "met")


def _joined_groups(group: DataFrame, links: DataFrame) -> DataFrame:
    """Components of groups and further links: only links between groups are followed, so what the
    groups hold already is not gone through again."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    known = written(group.union(ends.join(group, "node", "left_anti").select("node", F.col("node").alias("component"))), "groups")
    between = links.join(known.toDF("a", "_ga"), "a").join(known.toDF("b", "_gb"), "b").where("_ga <> _gb").select("_ga", "_gb").distinct()
    merged = connected_components(between, "_ga", "_gb").toDF("component", "_c")
    return known.join(merged, "component", "left").select("node", F.coalesce("_c", "component").alias("component"))


def similar_sets(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """``(rows, members)``: each row of ``docs`` with its set (``doc_id, text_hash, n, node``),
    and each linked node with its component of nodes."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
                       F.col("text").cast("string").alias("text"))
    schema = "doc_id long, text_hash long, n long, node long, map binary, cells array<long>, counts binary"
    first = written(rows.mapInArrow(freed(_nodes(width)), schema), "nodes")
    nodes = first.where("counts IS NULL").select("doc_id", "text_hash", "n", "node")
    rank = _bucket_ranks(first.where("counts IS NOT NULL").select("counts"))
    held = spark.sparkContext.broadcast(rank.astype("<u8").tobytes())      # 512 KB at any size
    # equal sets have equal maps and cells, so any of them will do; the holder is fixed
    sets = first.where("n > 0 AND doc_id IS NOT NULL").groupBy("node").agg(
        F.first("n").alias("n"), F.first("map").alias("map"), F.first("cells").alias("cells"), F.min(F.struct("doc_id", "text_hash")).alias("_d"))
    sets = written(sets.select("node", "n", "map", "cells", "_d.*"), "sets")
    measure = _Measure(rows, sets, width)
    links = _near_pivots(sets, measure)
    finished(spark)
    regions = rows.where("doc_id IS NOT NULL").select("text") \
        .mapInArrow(freed(_regions(held, width)), "key long, node long, n int, place int") \
        .repartition("key").sortWithinPartitions("key", "node")
    shared = written(regions.mapInArrow(freed(_shared_regions), "key long, node long, n int, place int"), "regions")
    finished(spark)
    group = written(connected_components(links, "a", "b"), "near-groups")
    members = _between_groups(shared, group)
    more = written(measure.links(_few_pairs(members)), "links")
    finished(spark)
    large = members.where("NOT _few").select("key", "node", "n", "place")
    if not large.isEmpty():
        more = _large_regions(large, written(links.union(more).distinct(), "links"), measure)
    return nodes, _joined_groups(group, more)


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_shingles, component_id, text_hash`` for every row.

    ``component_id`` is the smallest id reachable by links, the row's own included; documents
    with equal sets are linked.  Null and empty texts, and texts without words, have an empty
    set and are linked with nothing.  A row with a null id is linked with nothing and has a null
    component.  Rows that repeat an id are each answered by their own text.  An empty table
    gives an empty result; other columns are ignored."""
    nodes, groups = similar_sets(docs, width)
    linked = nodes.where("n > 0 AND doc_id IS NOT NULL")
    name = linked.groupBy("node").agg(F.min("doc_id").alias("_low")) \
        .join(groups.withColumnRenamed("component", "_g"), "node", "left").withColumn("_g", F.coalesce("_g", "node"))
    low = name.groupBy("_g").agg(F.min("_low").alias("component_id"))
    named = written(name.join(low, "_g").select("node", "component_id"), "components")
    answer = linked.join(named, "node").select("doc_id", "n", "component_id", "text_hash")
    alone = nodes.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"), "text_hash")
    return answer.union(alone).withColumnRenamed("n", "n_shingles")


def one_of_each(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` with one document per component: the smallest id (and text hash).

    A row repeated with equal id and text is one document.  Documents linked with nothing
    stay, null ids included."""
    groups = written(near_duplicates(docs, width), "near-duplicates")
    single = groups.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "text_hash").distinct()
    chosen = groups.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("component_id") \
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("_d")).select("_d.*")
    keep = written(single.union(chosen).distinct(), "kept")
    d = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_id"),
                    F.xxhash64(F.col("text").cast("string")).alias("_h"))
    on = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("text_hash"))
    return d.join(keep, on, "left_semi").dropDuplicates(["_id", "_h"]).select("_row.*")
