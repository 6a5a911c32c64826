"""Removal of repeated passages by sharded suffix arrays.

Every ``length``-byte string is assigned to an anchor: the ``GRAM``-byte piece of least hash
inside it (the leftmost of equals).  Equal strings have equal anchors, so the anchor's hash is a
shard key that never separates two occurrences.  A document's strings with the same anchor form
one fragment.  Anchors that occur once in the distinct texts are dropped; fragments with the same
content are counted before they travel on; the distinct fragments of a shard are suffix-sorted
by induced sorting (:mod:`.induced_sort`), and a string is repeated when it has a common prefix
of ``length`` bytes with a neighbour in the suffix array or its fragment occurs more than once.

All strings of an anchor share a core, at first the anchor itself.  An anchor whose distinct
fragments exceed ``SHARD_BYTES`` is divided: a string reaches half of the free bytes beyond the
core either to its right or to its left, and the core grown to that side is its new shard key,
which equal strings share.  Fragments cut to one side are counted again, and groups that are
still too large are divided further, at the latest until the core is the whole string.  So no
sort takes more than twice ``SHARD_BYTES``.

Texts are told by a 64-bit hash, and a text that several rows have is searched once: every byte
of it is repeated, and for all others it counts like any text.  Texts travel compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .induced_sort import suffix_array
from .shared import freed, written

LENGTH, GRAM = 200, 64
#: Fragments are suffix-sorted in shards of about so many bytes, always whole groups of no more.
SHARD_BYTES = 4 << 20


def _byte_values() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _least_grams(text: bytes, length: int, gram: int):
    """Hashes of a text's pieces, and the place of the anchor in each of its strings."""
    with np.errstate(over="ignore"):
        h, k = _byte_values()[np.frombuffer(text, np.uint8)], 1
        while k < gram:
            h = _mix(h[:-k] * np.uint64(0x9E3779B97F4A7C15) + h[k:])
            k *= 2
    # the place in the lower half makes the leftmost of equal hashes the least
    place = np.uint64((1 << 32) - 1)
    span, k, low = length - gram + 1, 1, (h & ~place) | np.arange(len(h), dtype=np.uint64)
    while 2 * k <= span:
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    n = len(text) - length + 1
    low = np.minimum(low[:n], low[span - k:span - k + n])               # least hash in each string
    return h, (low & place).astype(np.int64)


def anchors(text: bytes, length: int, gram: int):
    """Hash of the anchor, first and last string start of every fragment of a text.

    ``gram`` is a power of two below ``length``."""
    none = np.zeros(0, np.int64)
    if len(text) < length:
        return none, none, none
    h, at = _least_grams(text, length, gram)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return h[at[first]].view(np.int64), first, np.append(first[1:] - 1, len(at) - 1)


def _slices(sizes, limit: int):
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


#: Anchor rows among which a task looks for repeated ones before it hands them on.
CHUNK = 500_000


def _anchor_rows(length: int, gram: int):
    """A row per fragment of every text of a task (a copy adds nothing).

    An anchor met twice in a chunk is sure to be repeated: one of its rows goes to the anchor's
    task as a witness for others, the rest are dealt out by themselves.  So a very common anchor
    sends a row per chunk to its task, not a row per document."""
    names = ["route", "anchor", "t", "low", "high", "sure"]

    def answer(rows):
        anchor, t, low, high = (np.concatenate([r[k] for r in rows]) for k in range(4))
        order = np.argsort(anchor, kind="stable")
        same = anchor[order][1:] == anchor[order][:-1]
        sure, route = np.zeros(len(anchor), bool), anchor.copy()
        sure[order[1:]] |= same
        later = sure.copy()
        sure[order[:-1]] |= same
        with np.errstate(over="ignore"):
            own = _mix(t.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + low.astype(np.uint64)) ^ anchor.view(np.uint64)
        route[later] = own.view(np.int64)[later]
        return pa.RecordBatch.from_arrays(
            [pa.array(route), pa.array(anchor), pa.array(t), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(sure)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, seen = [], 0, set()
        for batch in batches:
            for t, text in zip(batch.column("t").to_pylist(), batch.column("text")):
                if t in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(t)
                got = anchors(text.as_buffer().to_pybytes(), length, gram)
                if len(got[0]):
                    rows.append((got[0], np.full(len(got[0]), t, np.int64), got[1], got[2]))
                    size += len(got[0])
                if size >= CHUNK:
                    yield answer(rows)
                    rows, size = [], 0
        if rows:
            yield answer(rows)
    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that are sure, or whose anchor has another row; rows come sorted by route, text and
    place, and equal ones (from copies in several tasks) are one.  The last row of a batch waits
    for the next one, no group is held."""
    held, known, last = None, None, None           # a row not yet decided, the last row's route, the last row
    for batch in batches:
        r, t, low = (batch.column(c).to_numpy() for c in ("route", "t", "low"))
        if not len(r):
            continue
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (t[1:] != t[:-1]) | (low[1:] != low[:-1])
        new[0] = last != (r[0], t[0], low[0])
        last = (r[-1], t[-1], low[-1])
        batch = batch.filter(pa.array(new))
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        r = batch.column("route").to_numpy()
        same = np.concatenate(([r[0] == known], r[1:] == r[:-1], [False]))
        keep = same[1:] | same[:-1]
        cut = len(r) if keep[-1] else len(r) - 1
        held = batch.slice(cut) if cut < len(r) else None
        known = r[-1] if keep[-1] else None
        sure = batch.column("sure").to_numpy(zero_copy_only=False)
        yield _plain(batch.slice(0, cut).filter(pa.array((keep | sure)[:cut])))
    if held is not None:
        yield _plain(held.filter(held.column("sure")))


def _plain(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.select(["anchor", "t", "low", "high"])


def _zip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        raw = batch.column("text").cast(pa.large_binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"),
                                          pa.array([pack(t.as_py()) if t.is_valid else None for t in raw], pa.binary())],
                                         names=[*(c for c in batch.schema.names if c != "text"), "zip"])


def _unzip(value) -> bytes:
    import zstandard
    return zstandard.ZstdDecompressor().decompress(value.as_buffer()) if value.is_valid else b""


def _fragments(length: int):
    """A row per fragment of a text; its bytes go with its first row in a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            rows, size = [], 0
            for key, value, spans in zip(batch.column("t"), batch.column("zip"), batch.column("spans")):
                text, key = _unzip(value), key.as_py()
                for s in spans.as_py():
                    part = text[s["low"]:s["high"] + length]
                    mark = hashlib.blake2b(part, digest_size=16).digest()
                    fresh = mark not in sent
                    if fresh:
                        if len(sent) > 200_000:
                            sent.clear()
                        sent.add(mark)
                    rows.append((s["anchor"], mark, key, s["low"], len(part), part if fresh else None))
                    size += len(part) if fresh else 0
                if size > 8 << 20 or len(rows) > 50_000:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)
    return run


def _batch(rows) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      names=["anchor", "mark", "t", "low", "size", "part"])


def repeated_starts(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each of some distinct texts, a flag per string start: whether the string occurs again
    in any of them.  Matches do not cross texts."""
    sizes = np.array([len(p) for p in parts])
    text = np.zeros(int(sizes.sum()) + len(parts), np.int16)           # 0 ends each part
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    for a, p in zip(begin, parts):
        text[a:a + len(p)] = np.frombuffer(p, np.uint8).astype(np.int16) + 1
    sa, lcp = suffix_array(text, length)
    room = np.repeat(begin + sizes, sizes + 1) - np.arange(len(text))   # bytes to the part's end
    long_enough = room[sa] >= length
    pair = np.flatnonzero((lcp[1:] >= length) & long_enough[1:] & long_enough[:-1])
    flag = np.zeros(len(text), bool)
    flag[sa[pair]] = True
    flag[sa[pair + 1]] = True
    return [flag[a:a + max(0, n - length + 1)] for a, n in zip(begin, sizes)]


def _runs(flag: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flag.view(np.int8), [0]))))
    return [{"a": int(a), "b": int(b - 1)} for a, b in zip(edge[::2], edge[1::2])]


def _sorted_shards(length: int):
    """Repeated string starts of distinct fragments; rows come sorted by anchor, and a shard is
    closed between two anchors."""
    def answer(rows):
        flags = repeated_starts([r[2] for r in rows], length)
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()),
             pa.array([_runs(f) for f in flags], kind)], names=["anchor", "mark", "starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for anchor, mark, part in zip(*(batch.column(c).to_pylist() for c in ("anchor", "mark", "part"))):
                if size >= SHARD_BYTES and rows[-1][0] != anchor:
                    yield answer(rows)
                    rows, size = [], 0
                rows.append((anchor, mark, part))
                size += len(part)
        if rows:
            yield answer(rows)
    return run


def halves(part: bytes, left: int, right: int, length: int):
    """The strings of a fragment with the core ``part[left:right]``, divided by the side on which
    they reach half of the free bytes beyond it: side, first string start, fragment, and the
    grown core within it.  Equal strings reach to the same side and have the same grown core."""
    free, last = length - (right - left), len(part) - length
    half = free // 2
    cut = left - half                                                  # first start that reaches to the right
    if cut <= last:
        a = max(0, cut)
        yield 1, a, part[a:], left - a, right + free - half - a
    if cut > 0:
        b = min(last, cut - 1)
        yield 0, 0, part[:b + length], left - half - 1, right


def _divided(length: int, gram: int):
    """Both halves of every fragment of a group that is too large for one sort.  ``left`` is null
    where the core is still the anchor."""
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    names = ["anchor", "mark", "of_anchor", "of_mark", "low", "size", "left", "right", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for anchor, mark, left, right, part in zip(*(batch.column(c).to_pylist() for c in ("anchor", "mark", "left", "right", "part"))):
                if left is None:
                    left = int(_least_grams(part, length, gram)[1][0])
                    right = left + gram
                for side, low, piece, a, b in halves(part, left, right, length):
                    key = hashlib.blake2b(b"%d %d " % (anchor, side) + piece[a:b], digest_size=8).digest()
                    rows.append((int.from_bytes(key, "little", signed=True), hashlib.blake2b(piece, digest_size=16).digest(),
                                 anchor, mark, low, len(piece), a, b, piece))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
    return run


def _repeated_in(one: DataFrame, length: int, gram: int) -> DataFrame:
    """``anchor, mark, starts``: ranges of repeated string starts in distinct fragments."""
    groups = written(one.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_bytes"))
                     .where("_n > 1"), "groups")
    # groups with one content need no sorting; those of bounded size go to their shards
    fit, hot = groups.where(F.col("_bytes") <= SHARD_BYTES), groups.where(F.col("_bytes") > SHARD_BYTES)
    sorted_ = one.join(fit.select("anchor"), "anchor").select("anchor", "mark", "part") \
        .repartition("anchor").sortWithinPartitions("anchor") \
        .mapInArrow(freed(_sorted_shards(length)), "anchor long, mark binary, starts array<struct<a:int,b:int>>")
    copies = one.where("several").select("anchor", "mark", F.array(
        F.struct(F.lit(0).alias("a"), (F.col("size") - length).alias("b"))).alias("starts"))
    starts = sorted_.where(F.size("starts") > 0).union(copies)
    if hot.isEmpty():
        return starts
    divided = written(one.join(hot.select("anchor"), "anchor").select("anchor", "mark", "left", "right", "part").mapInArrow(freed(_divided(length, gram)), "anchor long, mark binary, of_anchor long, of_mark binary, low int, size int, left int, right int, part binary"),
        "divided-fragments")
    again = written(divided.groupBy("anchor", "mark").agg(
        (F.count(F.lit(1)) > 1).alias("several"), *[F.first(c).alias(c) for c in ("size", "left", "right", "part")]), "distinct-fragments")
    found = divided.select("anchor", "mark", "of_anchor", "of_mark", "low").join(_repeated_in(again, length, gram), ["anchor", "mark"])
    return starts.union(found.select(
        F.col("of_anchor").alias("anchor"), F.col("of_mark").alias("mark"),
        F.transform("starts", lambda s: F.struct((s.a + F.col("low")).alias("a"), (s.b + F.col("low")).alias("b"))).alias("starts")))


def _cut(text: bytes, spans) -> tuple[bytes, int, int]:
    """What is left, bytes removed, and maximal removed runs."""
    left, at, runs, gone = [], 0, 0, 0
    for a, b in sorted((s["low"], s["high"]) for s in spans):
        if a > at or not runs:
            left.append(text[at:a])
            runs += 1
            at = a
        if b > at:
            gone += b - at
            at = b
    left.append(text[at:])
    return b"".join(left), gone, runs


def _keyed(docs: DataFrame, *keep) -> DataFrame:
    """Every row's text with its hash (``t``) and the hash of id and text (``key``), and some of
    its columns."""
    doc, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(F.xxhash64(text).alias("t"), F.xxhash64(doc, text).alias("key"), *keep, text.alias("text"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``t, copied, spans`` of the texts (``t`` their hash) that repeat something: whether several
    rows have the text whole (then every byte is repeated), and the byte ranges that repeated
    strings cover (they may overlap; null if none).

    A text that many rows have is searched once, in the row of the smallest key."""
    rows = _keyed(docs).where(F.octet_length("text") >= length)
    texts = written(rows.groupBy("t").agg(F.count(F.lit(1)).alias("_n"), F.min("key").alias("key")), "texts")
    found = rows.select("t", "text").mapInArrow(freed(_anchor_rows(length, gram)), "route long, anchor long, t long, low int, high int, sure boolean")
    again = found.repartition("route").sortWithinPartitions("route", "t", "low") \
        .mapInArrow(freed(_repeated), "anchor long, t long, low int, high int")
    again = written(again.groupBy("t").agg(F.collect_set(F.struct("low", "high", "anchor")).alias("spans")), "anchors")
    packed = rows.select("t", "key", "text").mapInArrow(freed(_zip), "t long, key long, zip binary")
    wanted = texts.select("t", "key").join(again, "t")
    parts = written(packed.join(wanted, ["t", "key"]).select("t", "zip", "spans").mapInArrow(freed(_fragments(length)), "anchor long, mark binary, t long, low int, size int, part binary"), "fragments")
    place = F.xxhash64("t", "low")
    one = parts.groupBy("anchor", "mark").agg((F.min(place) < F.max(place)).alias("several"), F.max("size").alias("size"),
                                              F.first("part", ignorenulls=True).alias("part"))
    one = written(one, "distinct-fragments")
    core = [F.lit(None).cast("int").alias(c) for c in ("left", "right")]
    starts = written(_repeated_in(one.select("*", *core), length, gram), "starts")
    spans = parts.select("anchor", "mark", "t", "low").join(starts, ["anchor", "mark"]) \
        .select("t", "low", F.explode("starts").alias("s")) \
        .select("t", F.struct((F.col("low") + F.col("s.a")).alias("low"),
                              (F.col("low") + F.col("s.b") + length).alias("high")).alias("span"))
    spans = spans.groupBy("t").agg(F.collect_set("span").alias("spans"))
    copied = F.col("_n") > 1
    return written(texts.select("t", copied.alias("copied")).join(spans, "t", "left").where("copied OR spans IS NOT NULL"), "spans")


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep = None
    for batch in batches:
        keep = keep or [c for c in batch.schema.names if c not in ("zip", "spans", "copied")]
        texts, gone, runs, size = [], [], [], []
        for value, spans, copied in zip(batch.column("zip"), batch.column("spans"), batch.column("copied").to_pylist()):
            raw = _unzip(value)
            if copied:                                         # only texts that hold a whole string are listed
                left, removed, n = b"", len(raw), 1
            else:
                left, removed, n = _cut(raw, spans.as_py() or []) if spans.is_valid else (raw, 0, 0)
            texts.append(left)
            gone.append(removed)
            runs.append(n)
            size.append(len(raw))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keep), pa.array(texts, pa.binary()), pa.array(size, pa.int64()),
             pa.array(gone, pa.int64()), pa.array(runs, pa.int64())],
            names=[*keep, "kept", "n_bytes", "n_removed", "n_spans"])


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cut_rows(batches):
        digest = [hashlib.sha256(k.as_buffer()).hexdigest() for k in batch.column("kept")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")), pa.array(digest, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cut_rows(batches):
        text = [None if null.as_py() else k.as_py().decode("utf-8", "ignore")
                for k, null in zip(batch.column("kept"), batch.column("_null"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_row"), pa.array(text, pa.string()), batch.column("n_bytes"), batch.column("n_removed")],
            names=["_row", "text", "n_bytes", "n_removed"])


def removal_digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row.

    Null texts count as empty; texts shorter than ``length`` bytes keep everything; repeated
    rows are occurrences of each other; an empty table gives an empty result; other columns are
    ignored."""
    spans = repeated_spans(docs, length, gram)
    packed = _keyed(docs, F.col("doc_id").cast("long").alias("doc_id")).drop("key").mapInArrow(freed(_zip), "t long, doc_id long, zip binary")
    return packed.join(spans, "t", "left").mapInArrow(freed(_digest_rows), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with repeated bytes cut out of the texts; documents left without any byte that
    had some before are dropped.

    Where a cut parts a character the broken bytes go as well.  ``n_chars`` is counted anew if
    there is such a column; all other columns stay."""
    spans = repeated_spans(docs, length, gram)
    names = docs.columns
    rest = [c for c in names if c != "text"]
    packed = _keyed(docs, F.struct(*rest).alias("_row")).drop("key")
    row = packed.schema["_row"].dataType.simpleString()
    packed = packed.mapInArrow(freed(_zip), f"t long, _row {row}, zip binary")
    cut = packed.join(spans, "t", "left").withColumn("_null", F.col("zip").isNull()).mapInArrow(freed(_text_rows), f"_row {row}, text string, n_bytes long, n_removed long")
    cut = cut.where("n_bytes = 0 OR n_removed < n_bytes")

    def column(c):
        if c == "text":
            return F.col("text")
        own = F.col(f"_row.`{c}`")
        if c != "n_chars":
            return own.alias(c)
        return F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(own).cast(docs.schema[c].dataType).alias(c)

    return cut.select(*[column(c) for c in names])
