"""Removal of repeated word passages by relative Lempel-Ziv parsing.

A window is ``window`` consecutive words of a document.  A word goes when a window over it also
starts in a document with a smaller id.

* Reference blocks.  Every window has an anchor, the ``gram``-word piece of least hash inside it
  (the leftmost of equals), so equal windows have equal anchors, and a document's windows with
  one anchor are one fragment of it.  Anchors met in one text only are dropped.  The others' hash
  deals the fragments to blocks: a fragment meets every fragment that shares a window with it,
  and no others need to be searched.  Fragments of equal content are one, held by the smallest
  id, and texts of equal content are one document: only the smallest id is parsed, the others
  are covered whole.
* Parsing.  A block of about ``BLOCK_WORDS`` words is indexed once (ranks of its suffixes by
  doubling, and smallest ids over ranges of ranks).  Every fragment is factored greedily against
  the fragments of smaller ids in it: the longest match at a place is the better one of the two
  nearest suffixes of a smaller id.  A factor of ``window`` words or more is a duplicate span.
* Boundaries.  A window over the end of a factor may be repeated too.  So behind each factor the
  leftmost start is searched from which a match crosses the boundary (if one start crosses, all
  later ones do), and the next factor begins there; none is missed.
* An anchor whose fragments exceed a block is cut into its single windows, which meet by their
  digest in an aggregation; no group of fragments is ever held beyond a block.

Fragments travel as words, so factors are exact; equal texts are told by 64-bit, equal fragments
and windows of large groups by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .shingles import _mix, _WordHash

WINDOW, GRAM = 50, 16
#: Words of a reference block; a group of fragments that is larger is cut into windows.
BLOCK_WORDS = 1 << 18


# --- anchors ------------------------------------------------------------------------------------

def anchors(h: np.ndarray, window: int, gram: int):
    """Hash of the anchor, first and last window start of every fragment of a document, from its
    word hashes.  ``gram`` is a power of two of at most ``window``."""
    none = np.zeros(0, np.int64)
    n = len(h) - window + 1
    if n < 1:
        return none, none, none
    with np.errstate(over="ignore"):
        k = 1
        while k < gram:
            h = _mix(h[:-k] * np.uint64(0x9E3779B97F4A7C15) + h[k:])
            k *= 2
    place = np.uint64((1 << 32) - 1)                    # the place below makes the leftmost the least
    span, k, low = window - gram + 1, 1, (h & ~place) | np.arange(len(h), dtype=np.uint64)
    while 2 * k <= span:
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    at = (np.minimum(low[:n], low[span - k:span - k + n]) & place).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return h[at[first]].view(np.int64), first, np.append(first[1:] - 1, n - 1)


def _anchor_rows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = _WordHash(), set()
        for batch in batches:
            rows = []
            for t, text in zip(batch.column("t").to_pylist(), batch.column("text")):
                if t in seen or not text.is_valid:             # a copy in the same task adds nothing
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(t)
                words = text.as_buffer().to_pybytes().split()
                if len(words) >= window:
                    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                    rows.append((t, *anchors(h, window, gram)))
            if rows:
                each = [len(r[1]) for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([r[1] for r in rows]), pa.int64()),
                     pa.array(np.repeat(np.array([r[0] for r in rows], np.int64), each)),
                     *(pa.array(np.concatenate([r[k] for r in rows]), pa.int32()) for k in (2, 3))],
                    names=["anchor", "t", "low", "high"])
    return run


def _zip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column("t"), batch.column("doc_id"),
             pa.array([pack(t.as_buffer()) if t.is_valid else None for t in batch.column("text")], pa.binary())],
            names=["t", "doc_id", "zip"])


def _words(value) -> list[bytes]:
    import zstandard
    return zstandard.ZstdDecompressor().decompress(value.as_buffer()).split() if value.is_valid else []


def _fragments(window: int):
    """A row per fragment of a document; its words go with its first row in a task."""
    names = ["anchor", "mark", "t", "first", "low", "size", "part"]
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            rows, size = [], 0
            for t, first, value, spans in zip(*(batch.column(c) for c in ("t", "first", "zip", "spans"))):
                words, t, first = _words(value), t.as_py(), first.as_py()
                for s in spans.as_py():
                    low, end = s["low"], s["high"] + window
                    part = b" ".join(words[low:end])
                    mark = hashlib.blake2b(part, digest_size=16).digest()
                    fresh = mark not in sent
                    if fresh:
                        if len(sent) > 200_000:
                            sent.clear()
                        sent.add(mark)
                        size += len(part)
                    rows.append((s["anchor"], mark, t, first, low, end - low, part if fresh else None))
                    if size > 8 << 20 or len(rows) > 50_000:
                        yield batch_of(rows)
                        rows, size = [], 0
            if rows:
                yield batch_of(rows)
    return run


# --- parsing ------------------------------------------------------------------------------------

class Block:
    """An index over fragments: the longest match of any place in fragments of smaller ids."""

    def __init__(self, parts: list[bytes], first: np.ndarray):
        split = [p.split(b" ") for p in parts]
        size = np.array([len(w) for w in split])
        self.begin = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
        self.end = self.begin + size
        number: dict[bytes, int] = {}
        text = np.empty(int(size.sum()) + len(parts), np.int64)
        for a, words in zip(self.begin.tolist(), split):
            text[a:a + len(words)] = [number.setdefault(w, len(number)) for w in words]
        text[self.end] = len(number) + np.arange(len(parts))   # a mark of its own ends each fragment
        # classes of equal pieces of 1, 2, 4, ... words, numbered in their order
        self.levels, step, deepest = [text], 1, int(size.max(initial=1)) + 1
        while step < deepest and int(self.levels[-1].max()) + 1 < len(text):
            second = np.zeros(len(text), np.int64)
            second[:-step] = self.levels[-1][step:] + 1
            key = self.levels[-1] * (len(text) + len(number) + 2) + second
            self.levels.append(np.unique(key, return_inverse=True)[1].reshape(-1))
            step *= 2
        self.rank = self.levels[-1]                            # the marks make all suffixes differ
        if len(self.levels) == 1:
            self.rank = np.unique(text, return_inverse=True)[1].reshape(-1)
        self.suffix = np.argsort(self.rank, kind="stable")
        self.first = np.repeat(first, size + 1)
        self.least = [self.first[self.suffix]]                 # smallest ids over 1, 2, 4, ... ranks
        while 2 << (len(self.least) - 1) <= len(text):
            half, width = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(half[:-width], half[width:]))

    def _nearest(self, rank: np.ndarray, first: np.ndarray, step: int) -> np.ndarray:
        """The nearest rank below (``step`` -1) or above (1) with a smaller id; -1 if none."""
        n, at = len(self.rank), rank.copy() if step < 0 else rank + 1
        for k in range(len(self.least) - 1, -1, -1):
            table, width = self.least[k], 1 << k
            start = at - width if step < 0 else at
            ok = (start >= 0) & (start + width <= n)
            ok[ok] = table[start[ok]] >= first[ok]
            at[ok] += step * width
        if step < 0:
            return at - 1
        return np.where(at < n, at, -1)

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            same = self.levels[k][a] == self.levels[k][b]
            a[same] += 1 << k
            b[same] += 1 << k
            out[same] += 1 << k
        return out

    def longest(self, place: np.ndarray) -> np.ndarray:
        """Words from each place on that also stand in a fragment of a smaller id."""
        rank, first, out = self.rank[place], self.first[place], np.zeros(len(place), np.int64)
        for step in (-1, 1):
            near = self._nearest(rank, first, step)
            some = np.flatnonzero(near >= 0)
            out[some] = np.maximum(out[some], self._common(place[some], self.suffix[near[some]]))
        return out


def factor(parts: list[bytes], first: np.ndarray, window: int) -> list[list[dict]]:
    """For each fragment the window starts that lie in its long factors, as ranges a..b."""
    block, out = Block(parts, first), [[] for _ in parts]
    live = np.flatnonzero((first > first.min(initial=0)) & (block.end - block.begin >= window)) if len(parts) else []
    place = block.begin[live]
    while len(live):
        size = block.longest(place)
        for k, a, n in zip(live.tolist(), place.tolist(), size.tolist()):
            if n >= window:
                a -= int(block.begin[k])
                out[k].append({"a": a, "b": a + n - window})
        edge, last = place + size, block.end[live] - window
        go = (edge < block.end[live]) & (place < last)
        live, place, edge, last = live[go], place[go], edge[go], last[go]
        # the leftmost start behind this factor's from which a match crosses its end
        low, high = place + 1, edge + 1                        # high: the word at the end matches nowhere
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            crosses = middle + block.longest(middle) > edge[open_]
            high[open_[crosses]] = middle[crosses]
            low[open_[~crosses]] = middle[~crosses] + 1
        go = low <= last
        live, place = live[go], low[go]
    return out


def _parsed(window: int):
    """Long factors of distinct fragments; rows come sorted by anchor, and a block is closed
    between two anchors."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def answer(rows):
        spans = factor([r[3] for r in rows], np.array([r[2] for r in rows], np.int64), window)
        hit = [k for k, s in enumerate(spans) if s]
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[k][0] for k in hit], pa.int64()), pa.array([rows[k][1] for k in hit], pa.binary()),
             pa.array([spans[k] for k in hit], kind)], names=["anchor", "mark", "starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "mark", "first", "part", "size"))):
                if size >= BLOCK_WORDS and rows[-1][0] != row[0]:
                    yield answer(rows)
                    rows, size = [], 0
                rows.append(row)
                size += row[4]
        if rows:
            yield answer(rows)
    return run


def _single_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                rows = []
                for anchor, mark, first, part in zip(*(batch.column(c)[a:a + 1000].to_pylist() for c in ("anchor", "mark", "first", "part"))):
                    words = part.split(b" ")
                    for at in range(len(words) - window + 1):
                        rows.append((hashlib.blake2b(b" ".join(words[at:at + window]), digest_size=16).digest(), anchor, mark, first, at))
                kinds = (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int32())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                     names=["w", "anchor", "mark", "first", "at"])
    return run


def _repeated_in(one: DataFrame, window: int) -> DataFrame:
    """``anchor, mark, starts``: window starts of distinct fragments that a smaller id has too."""
    groups = written(one.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_words"))
                     .where("_n > 1"), "passage-groups")
    fit, hot = groups.where(F.col("_words") <= BLOCK_WORDS), groups.where(F.col("_words") > BLOCK_WORDS)
    starts = "anchor long, mark binary, starts array<struct<a:int,b:int>>"
    parsed = one.join(fit.select("anchor"), "anchor", "left_semi").select("anchor", "mark", "first", "part", "size") \
        .repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_parsed(window), starts)
    if hot.isEmpty():
        return parsed
    single = written(one.join(hot.select("anchor"), "anchor", "left_semi").select("anchor", "mark", "first", "part").mapInArrow(
        _single_windows(window), "w binary, anchor long, mark binary, first long, at int"), "single-windows")
    least = single.groupBy("w").agg(F.min("first").alias("_least"), F.max("first").alias("_most")).where("_least < _most")
    again = single.join(least.select("w", "_least"), "w").where("_least < first").groupBy("anchor", "mark").agg(
        F.collect_set(F.struct(F.col("at").alias("a"), F.col("at").alias("b"))).alias("starts"))
    return parsed.union(again.select("anchor", "mark", "starts"))


# --- documents ----------------------------------------------------------------------------------

def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.xxhash64(text).alias("t"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def repeated_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``t, first, spans`` of every distinct text (``t`` its hash) of a row with an id: the
    smallest id that has it, and the word ranges of that document which windows of smaller ids
    cover (they may overlap; null if none)."""
    rows = _rows(docs).where("doc_id IS NOT NULL AND text IS NOT NULL")
    texts = written(rows.groupBy("t").agg(F.min("doc_id").alias("first")), "texts")
    found = written(rows.select("t", "text").mapInArrow(_anchor_rows(window, gram), "anchor long, t long, low int, high int"),
                    "passage-anchors")
    # written, so that the join reads two plain shuffles and a hot anchor's rows are split
    shared = written(found.groupBy("anchor").agg(F.min("t").alias("_a"), F.max("t").alias("_b")).where("_a < _b").select("anchor"),
                     "shared-anchors")
    again = found.join(shared, "anchor", "left_semi").groupBy("t") \
        .agg(F.collect_set(F.struct("low", "high", "anchor")).alias("spans"))
    # one holder of each text meets its fragments: the row of the smallest id
    wanted = texts.join(again, "t").withColumn("doc_id", F.col("first"))
    packed = rows.mapInArrow(_zip, "t long, doc_id long, zip binary")
    parts = written(packed.join(wanted, ["t", "doc_id"]).select("t", "first", "zip", "spans").mapInArrow(
        _fragments(window), "anchor long, mark binary, t long, first long, low int, size int, part binary"), "passage-fragments")
    one = written(parts.groupBy("anchor", "mark").agg(
        F.min("first").alias("first"), F.max("first").alias("most"), F.max("size").alias("size"),
        F.first("part", ignorenulls=True).alias("part")), "distinct-passages")
    verdict = written(one.select("anchor", "mark", F.col("first").alias("_least"), "most")
                      .join(_repeated_in(one, window), ["anchor", "mark"], "left").where("starts IS NOT NULL OR _least < most"), "passage-verdicts")
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("size") - window).alias("b")))
    ranges = parts.select("anchor", "mark", "t", "first", "low", "size").join(verdict, ["anchor", "mark"]) \
        .select("t", "low", F.explode(F.when(F.col("_least") < F.col("first"), whole).otherwise(F.col("starts"))).alias("s"))
    spans = ranges.select("t", F.struct((F.col("low") + F.col("s.a")).alias("low"),
                                        (F.col("low") + F.col("s.b") + window).alias("high")).alias("span")) \
        .groupBy("t").agg(F.collect_set("span").alias("spans"))
    return written(texts.join(spans, "t", "left").select("t", "first", "spans"), "passages")


def _cut(window: int):
    kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, ranges, kept = [], [], [], []
            for doc, first, value, spans in zip(*(batch.column(c) for c in ("doc_id", "first", "zip", "spans"))):
                words, doc, first = _words(value), doc.as_py(), first.as_py()
                found = []
                if doc is not None and first is not None and first < doc:
                    found = [(0, len(words))] if len(words) >= window else []
                elif doc is not None and spans.is_valid:
                    for a, b in sorted((s["low"], s["high"]) for s in spans.as_py()):
                        if found and a <= found[-1][1]:
                            found[-1] = (found[-1][0], max(b, found[-1][1]))
                        else:
                            found.append((a, b))
                left, at = [], 0
                for a, b in found:
                    left += words[at:a]
                    at = b
                left += words[at:]
                n.append(len(words))
                gone.append(len(words) - len(left))
                ranges.append([{"low": a, "high": b} for a, b in found])
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(ranges, kind),
                 pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "removed", "kept"])
    return run


def remove_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_words, n_removed, removed, kept`` of every row: its words, how many went, their
    ranges (ascending, apart), and the words that stay, joined by one space.

    Windows are judged on the input, not on what is left.  Null and empty texts have no words;
    texts of fewer than ``window`` words keep all.  Rows that repeat an id do not cover each other
    (an id is not smaller than itself).  A row with a null id keeps all its words and covers
    none.  Texts of any length are parsed as a whole.  An empty table gives an empty result; other
    columns are ignored."""
    found = repeated_passages(docs, window, gram)
    packed = _rows(docs).mapInArrow(_zip, "t long, doc_id long, zip binary")
    return packed.join(found, "t", "left").select("doc_id", "first", "zip", "spans").mapInArrow(
        _cut(window), "doc_id long, n_words long, n_removed long, removed array<struct<low:int,high:int>>, kept string")
