"""Benchmark decontamination by suffix arrays over the training documents.

Every Arrow batch of documents is a shard.  A shard's suffix array holds the word positions
from which a benchmark suffix could match at all, sorted by prefix doubling; every suffix of
every benchmark item is binary-searched in it.  That yields each benchmark suffix's longest
verbatim match and, for windows of ``width`` words, the interval of positions where the window
occurs.  Documents are whole inside a row, so a shard decides its own documents and no text is
ever shuffled.

The benchmark is a stated query set.  It is sent to the tasks in blocks of at most
``block_bytes``, one pass over the documents per block, so its size is bounded per pass
whatever the size of the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Bytes that separate words; A-Z are lower-cased, all others kept (fixed by the contract).
_TABLE = bytes((b + 32) if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
               for b in range(256))

ITEMS_SCHEMA = "doc_id long, text_hash long, n_words long, hit array<int>, items array<long>, longest int, longest_item long, longest_at int"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class TestSet:
    """The words of a block of items as numbers, its suffixes and its windows."""

    def __init__(self, items: list[tuple[int, bytes]], width: int):
        self.width = width
        self.vocab: dict[bytes, int] = {}
        seqs = []
        for item, text in items:
            w = words_of(text)
            if w:
                seqs.append((item, np.array([self.vocab.setdefault(x, len(self.vocab)) for x in w], np.int32)))
        self.ids = np.array([s[0] for s in seqs], np.int64)
        size = sum(len(s[1]) + 1 for s in seqs)
        self.words = np.full(size + 1, -1, np.int32)          # items, each closed by -1
        self.suffix, self.item, self.window = [], [], []
        at = 0
        for k, (_, seq) in enumerate(seqs):
            n = len(seq)
            self.words[at:at + n] = seq
            self.suffix.append(np.arange(at, at + n))
            self.item.append(np.full(n, k))
            length = np.minimum(np.arange(n, 0, -1), width)     # words of the suffix's window
            length[(length < width) & (np.arange(n) > 0)] = 0   # a short item is one window
            if n >= width:
                length[length < width] = 0
            self.window.append(length)
            at += n + 1
        join = (lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64))
        self.suffix, self.item, self.window = join(self.suffix), join(self.item), join(self.window)
        self.shortest = int(self.window[self.window > 0].min()) if len(self.window) else width
        self.longest = max((len(s[1]) for s in seqs), default=0)


def suffix_array(words: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``at`` sorted by the words that follow them, compared up to ``depth`` words
    (prefix doubling over ranks; -1 ends a suffix)."""
    rank = np.zeros(len(words) + 1, np.int64)
    rank[:-1] = words + 1
    step = 1
    while step < depth and len(at):
        second = np.zeros(len(rank), np.int64)
        second[:-step] = rank[step:]
        second[rank == 0] = 0
        key = rank * (int(rank.max()) + 1) + second
        _, rank = np.unique(key, return_inverse=True)
        rank = rank.reshape(-1)
        step *= 2
    order = np.argsort(rank[at], kind="stable")
    return at[order], rank[at][order]


def _search(words, sa, test, starts, lengths, upper):
    """First suffix that is not below (``upper``: that is above) the first ``lengths`` words of
    each test suffix; all test suffixes are searched at once, word by word."""
    lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(sa), np.int64)
    top = len(words) - 1
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        pos = sa[np.minimum(mid, len(sa) - 1)]
        state = np.zeros(len(starts), np.int8)                  # -1 suffix below, 1 above, 0 equal
        live = open_.copy()
        ended = np.zeros(len(starts), bool)
        k = 0
        while live.any():
            i = np.flatnonzero(live)
            done = k >= lengths[i]
            live[i[done]] = False
            i = i[~done]
            a = np.where(ended[i], -1, words[np.minimum(pos[i] + k, top)])
            b = test[starts[i] + k]
            ended[i] |= a < 0
            state[i[a < b]], state[i[a > b]] = -1, 1
            live[i[a != b]] = False
            k += 1
        below = (state <= 0) if upper else (state < 0)
        lo = np.where(open_ & below, mid + 1, lo)
        hi = np.where(open_ & ~below, mid, hi)
    return lo


def _common(words, pos, test, starts, lengths):
    """Common words of shard suffixes and test suffixes."""
    n, live, k, top = np.zeros(len(starts), np.int64), np.ones(len(starts), bool), 0, len(words) - 1
    while live.any():
        i = np.flatnonzero(live)
        i = i[k < lengths[i]]
        same = (words[np.minimum(pos[i] + k, top)] == test[starts[i] + k]) & (test[starts[i] + k] >= 0)
        live[:] = False
        live[i[same]] = True
        n[i[same]] += 1
        k += 1
    return n


def match_shard(words: np.ndarray, t: TestSet):
    """Occurrences ``(position, words, test suffix)`` of windows in a shard, and the longest
    match ``(words, position)`` of every test suffix.  ``words`` are test-set numbers, -1 for
    any other word and between documents."""
    none = np.zeros(0, np.int64)
    if not len(t.suffix):
        return none, none, none, none, none
    inside = words >= 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    good = ends - starts >= t.shortest                          # a match needs that many known words in a row
    starts, ends = starts[good], ends[good]
    total = int((ends - starts).sum())
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(ends - starts)[:-1])), ends - starts) + np.arange(total) \
        if total else none
    if not total:
        return none, none, none, np.zeros(len(t.suffix), np.int64), np.zeros(len(t.suffix), np.int64)
    # the shard keeps only those runs: what lies between can match no test suffix
    run = np.full(total + len(starts) + 1, -1, np.int64)
    shift = np.repeat(np.arange(len(starts)), ends - starts) + np.arange(total)
    run[shift] = words[at]
    back = np.zeros(len(run), np.int64)
    back[shift] = at
    sa, _ = suffix_array(run, shift, max(t.longest, 1))
    rest = np.searchsorted(np.flatnonzero(t.words < 0), t.suffix)
    rest = np.flatnonzero(t.words < 0)[rest] - t.suffix          # words to the item's end
    place = _search(run, sa, t.words, t.suffix, rest, False)
    best, where = np.zeros(len(t.suffix), np.int64), np.zeros(len(t.suffix), np.int64)
    for side in (place - 1, place):
        ok = (side >= 0) & (side < len(sa))
        pos = sa[np.clip(side, 0, len(sa) - 1)]
        n = np.where(ok, _common(run, pos, t.words, t.suffix, rest), 0)
        better = n > best
        best, where = np.where(better, n, best), np.where(better, back[pos], where)
    win = np.flatnonzero((t.window > 0) & (best >= t.window))    # windows that occur in the shard
    lo = _search(run, sa, t.words, t.suffix[win], t.window[win], False)
    hi = _search(run, sa, t.words, t.suffix[win], t.window[win], True)
    n = hi - lo
    which = np.repeat(win, n)
    off = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return back[sa[np.repeat(lo, n) + off]], t.window[which], which, best, where


def _scan(items, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = TestSet(items.value, width)
        find = t.vocab.get
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for k in _shards(texts, 32 << 20):
                part, shard, doc_n = texts[k[0]:k[1]], [], []
                for x in part:
                    w = words_of(x.as_py() or b"")
                    doc_n.append(len(w))
                    shard.append(np.fromiter((find(y, -1) for y in w), np.int32, len(w)))
                    shard.append(np.full(1, -1, np.int32))
                yield _answer(batch.slice(k[0], k[1] - k[0]), np.concatenate(shard), np.array(doc_n), t)
    return run


def _shards(texts, limit: int):
    """Row ranges of at most ``limit`` bytes (a longer single text is a range of its own)."""
    start, size = 0, 0
    for i, n in enumerate(pa.compute.binary_length(texts).fill_null(0).to_pylist()):
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def _answer(rows: pa.RecordBatch, words: np.ndarray, n: np.ndarray, t: TestSet) -> pa.RecordBatch:
    pos, length, which, best, where = match_shard(words, t)
    begin = np.cumsum(n + 1) - (n + 1)
    doc = np.searchsorted(begin, pos, "right") - 1
    depth = np.zeros(len(words) + 1, np.int32)
    np.add.at(depth, pos, 1)
    np.add.at(depth, pos + length, -1)
    hit = np.flatnonzero(np.cumsum(depth)[:-1] > 0)
    hit_doc = np.searchsorted(begin, hit, "right") - 1
    pairs = np.unique(np.stack([doc, t.item[which]]) if len(which) else np.zeros((2, 0), np.int64), axis=1)
    far = np.argsort(-best, kind="stable") if len(best) else np.zeros(0, np.int64)
    far = far[best[far] > 0] if len(far) else far
    far_doc = np.searchsorted(begin, where[far], "right") - 1
    _, first = np.unique(far_doc, return_index=True)
    lead = {int(far_doc[i]): far[i] for i in first}
    cut = np.searchsorted(hit_doc, np.arange(len(n) + 1))
    cut_items = np.searchsorted(pairs[0], np.arange(len(n) + 1))
    local = hit - begin[hit_doc] if len(hit) else hit
    return pa.RecordBatch.from_arrays([
        rows.column("doc_id"), rows.column("text_hash"), pa.array(n, pa.int64()),
        pa.array([local[a:b] for a, b in zip(cut[:-1], cut[1:])], pa.list_(pa.int32())),
        pa.array([t.ids[pairs[1][a:b]] for a, b in zip(cut_items[:-1], cut_items[1:])], pa.list_(pa.int64())),
        pa.array([int(best[lead[i]]) if i in lead else 0 for i in range(len(n))], pa.int32()),
        pa.array([int(t.ids[t.item[lead[i]]]) if i in lead else None for i in range(len(n))], pa.int64()),
        pa.array([int(where[lead[i]] - begin[i]) if i in lead else None for i in range(len(n))], pa.int32()),
    ], names=["doc_id", "text_hash", "n_words", "hit", "items", "longest", "longest_item", "longest_at"])


def matches(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """Per document: ``n_words``, the hit word positions, the items found, and a shard's longest
    verbatim match that lies in it (words, item, position).

    A window is ``width`` consecutive words of an item, or a shorter item whole; items without
    words have none.  Null and empty texts have no words; items with a null id are skipped;
    items that share an id count as one.  Repeated documents are each answered; an empty
    benchmark finds nothing; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
                       F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")) \
        .where("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-2 * size // block_bytes))
    found = None
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        block = sorted((r[0], r[1].encode()) for r in part.toLocalIterator())
        held = spark.sparkContext.broadcast(block)
        got = rows.mapInArrow(_scan(held, width), ITEMS_SCHEMA)
        found = got if found is None else found.union(written(got, "leaks") if blocks > 1 else got)
    if blocks == 1:
        return found
    # several blocks answered the same rows: one row per document again; repeated rows agree
    return found.groupBy("doc_id", "text_hash").agg(
        F.first("n_words").alias("n_words"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("hit"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.max(F.struct("longest", "longest_item", "longest_at")).alias("_m"),
        (F.count(F.lit(1)) / blocks).cast("int").alias("_times")) \
        .withColumn("_times", F.explode(F.sequence(F.lit(1), "_times"))) \
        .select("doc_id", "text_hash", "n_words", "hit", "items", "_m.*")


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` per document.

    ``items_sha256`` is the hash of the found item ids, sorted as strings and comma-joined
    (of the empty string when there are none)."""
    ids = F.array_sort(F.transform(F.array_distinct("items"), lambda x: x.cast("string")))
    return matches(docs, benchmark, width).select(
        "doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"),
        F.size(F.array_distinct("items")).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"), "longest", "longest_item", "longest_at")


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The rows of ``docs`` without any window of the benchmark, with their own columns.

    A document with several rows is kept or removed by id and text; ids may be null."""
    bad = written(matches(docs, benchmark, width).where(F.size("hit") > 0)
                  .select("doc_id", "text_hash").distinct(), "leaking")
    d = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_id"),
                    F.xxhash64(F.col("text").cast("string")).alias("_h"))
    on = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("text_hash"))
    return d.join(bad, on, "left_anti").select("_row.*")
