"""Fill-in-the-middle transformation as a pipeline of ``pyarrow.compute`` kernels.

Every batch of texts goes through the same steps.  Its texts are split into units (code points,
or lines with their end) as one list array over the batch's own bytes.  The lists are flattened
with the index of their parent, every unit gets its ordinal within its text, and three filters
by role (before the first cut, between the cuts, behind the second) give the units of prefix,
middle and suffix.  Each filtered array is rebuilt into lists and joined into one piece per
text, and the pieces are joined around the sentinels element by element.

Cuts and forms come from four numbers of a SHA-256 of seed and id, computed by Spark, so a
document's transformation depends on nothing but its id and its number of units.

A text of more than ``SEGMENT`` bytes is split into several lists, whose ordinals go on from one
to the next and whose pieces are joined in the end, so the kernels' memory does not grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are split into units at a time.
SEGMENT = 1 << 20
EMPTY = pa.scalar("", pa.large_string())


@dataclass(frozen=True)
class Plan:
    """How texts are transformed: the unit of the cuts (``char`` or ``line``), the seed of the
    numbers, the shares of transformed texts and of the suffix-first form among them, in per
    cent, and the sentinels of prefix, suffix and middle (no two of which may overlap)."""

    unit: str = "char"
    seed: int = 1
    share: int = 90
    spm_share: int = 20
    sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")


def _count(text: pa.Array, unit: str) -> pa.Array:
    if unit == "char":
        return pc.utf8_length(text).cast(pa.int64())
    open_end = pc.and_(pc.greater(pc.binary_length(text), 0), pc.invert(pc.ends_with(text, "\n")))
    return pc.add(pc.count_substring(text, "\n").cast(pa.int64()), open_end.cast(pa.int64()))


def _unit_starts(data: pa.Array, texts: np.ndarray, unit: str) -> pa.Array:
    """Places of the bytes that begin a unit; the first byte of a text begins one."""
    if unit == "char":
        mask = pc.not_equal(pc.bit_wise_and(data, pa.scalar(0xC0, pa.uint8())), pa.scalar(0x80, pa.uint8()))
    else:
        mask = np.concatenate(([True], pc.equal(data, pa.scalar(10, pa.uint8())).to_numpy(False)[:-1]))
        mask[texts[texts < len(mask)]] = True
        mask = pa.array(mask)
    return pc.indices_nonzero(mask).cast(pa.int64())


def _next_start(data: memoryview, at: int, end: int, unit: str) -> int:
    """The first unit start at or behind a byte."""
    if unit == "char":
        while at < end and data[at] & 0xC0 == 0x80:
            at += 1
        return at
    while at < end and data[at - 1] != 10:
        at += 1
    return at


def _segments(offsets: np.ndarray, data: memoryview, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every list (with the end of the last), and the text it belongs to."""
    if not len(offsets) or int(np.diff(offsets).max(initial=0)) <= SEGMENT:
        return offsets, np.arange(len(offsets) - 1)
    begin, row = [], []
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        at = a
        while True:
            begin.append(at)
            row.append(k)
            at = _next_start(data, at + SEGMENT, b, unit) if at + SEGMENT < b else b
            if at >= b:
                break
    return np.array([*begin, offsets[-1]], np.int64), np.array(row, np.int64)


def _groups(begin: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of lists of about ``SEGMENT`` bytes together."""
    a, last = 0, len(begin) - 1
    while a < last:
        b = max(a + 1, int(np.searchsorted(begin, begin[a] + SEGMENT, "right")) - 1)
        yield a, min(b, last)
        a = min(b, last)


def _joined(ends: np.ndarray, values: pa.Array) -> pa.Array:
    """Values rebuilt into lists and each list joined into one text."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), EMPTY)


def _pieces(text: pa.Array, low: pa.Array, high: pa.Array, unit: str) -> list[pa.Array]:
    """Prefix, middle and suffix of every text, cut in front of unit ``low`` and unit ``high``."""
    raw = text.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
    data = raw.buffers()[2] or pa.py_buffer(b"")
    begin, row = _segments(offsets, memoryview(data).cast("B"), unit)
    done: list[list[pa.Array]] = [[], [], []]
    used = np.zeros(len(text), np.int64)                       # units of each text so far
    for a, b in _groups(begin):
        first, size = int(begin[a]), int(begin[b] - begin[a])
        window = data.slice(first, size)
        starts = _unit_starts(pa.Array.from_buffers(pa.uint8(), size, [None, window]), begin[a:b] - first, unit) if size else pa.array([], pa.int64())
        edges = pa.concat_arrays([starts, pa.array([size], pa.int64())])
        units = pa.LargeStringArray.from_buffers(len(starts), edges.buffers()[1], window)
        bounds = np.searchsorted(starts.to_numpy(), begin[a:b + 1] - first)
        lists = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), units)
        flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
        rows, each = row[a:b], np.diff(bounds)
        base = used[rows]                                      # a long text alone fills a group
        np.add.at(used, rows, each)
        place = pc.add(pc.subtract(pa.array(np.arange(len(flat))), pc.take(pa.array(bounds[:-1]), parent)),
                       pc.take(pa.array(base), parent))
        owner = pa.array(rows)
        behind_low = pc.greater_equal(place, pc.take(pc.take(low, owner), parent))
        behind_high = pc.greater_equal(place, pc.take(pc.take(high, owner), parent))
        for out, role in zip(done, (pc.invert(behind_low), pc.and_not(behind_low, behind_high), behind_high)):
            count = np.bincount(pc.filter(parent, role).to_numpy(), minlength=b - a)
            out.append(_joined(np.concatenate(([0], np.cumsum(count))), pc.filter(flat, role)))
    if len(row) == len(text):
        return [pa.concat_arrays(out) if out else pa.array([], pa.large_string()) for out in done]
    ends = np.searchsorted(row, np.arange(len(text) + 1))
    return [_joined(ends, pa.concat_arrays(out)) for out in done]


def _split_once(text: pa.Array, mark: str) -> tuple[pa.Array, pa.Array]:
    parts = pc.split_pattern(text, pattern=mark, max_splits=1)
    return pc.list_element(parts, 0), pc.list_element(parts, 1)


def _rebuilt(output: pa.Array, form: pa.Array, plan: Plan) -> pa.Array:
    """The texts again, from nothing but the outputs and their forms."""
    p, s, m = plan.sentinels
    text = output
    for name, lead, mark in (("psm", p, s), ("spm", s, p)):
        rows = pc.indices_nonzero(pc.equal(form, name))
        if len(rows):
            body = pc.utf8_slice_codeunits(pc.take(output, rows), len(lead))
            one, rest = _split_once(body, mark)
            two, middle = _split_once(rest, m)
            prefix, suffix = (one, two) if name == "psm" else (two, one)
            whole = pc.binary_join_element_wise(prefix, middle, suffix, EMPTY)
            text = pc.replace_with_mask(text, pc.equal(form, name), whole)
    return text


def transform(batch: pa.RecordBatch, plan: Plan) -> pa.RecordBatch:
    """One batch of ``doc_id, text, h1, h2, h3, h4``; null texts are empty."""
    text = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
    h1, h2, h3, h4 = (batch.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4))
    n = _count(text, plan.unit).to_numpy()
    plain = pc.or_kleene(pc.equal(pc.binary_length(text), 0), pa.array(h3 % 100 >= plan.share))
    for mark in plan.sentinels:
        plain = pc.or_(plain, pc.match_substring(text, mark))
    form = pc.if_else(plain, "plain", pc.if_else(pa.array(h4 % 100 < plan.spm_share), "spm", "psm"))
    x, y = h1 % (n + 1), h2 % (n + 1)
    low, high = np.minimum(x, y), np.maximum(x, y)
    cut = pc.indices_nonzero(pc.invert(plain))
    output = text
    if len(cut):
        prefix, middle, suffix = _pieces(pc.take(text, cut), pc.take(pa.array(low), cut), pc.take(pa.array(high), cut), plan.unit)
        p, s, m = (pa.scalar(x, pa.large_string()) for x in plan.sentinels)
        psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, EMPTY)
        spm = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, EMPTY)
        output = pc.replace_with_mask(text, pc.invert(plain), pc.if_else(pc.equal(pc.take(form, cut), "spm"), spm, psm))
    null = pa.scalar(None, pa.int64())
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(n, pa.int64()), form.cast(pa.string()), pc.if_else(plain, null, pa.array(low, pa.int64())),
         pc.if_else(plain, null, pa.array(high - low, pa.int64())), output.cast(pa.string()),
         _rebuilt(output, form, plan).cast(pa.string())],
        names=["doc_id", "n", "form", "prefix_units", "middle_units", "output", "restored"])


def _batches(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column("text")).cast(pa.int64()), 0).to_numpy()
            ends = np.concatenate(([0], np.cumsum(size)))
            a = 0
            while a < batch.num_rows:                          # rows of about four segments, or one long row
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + 4 * SEGMENT, "right")) - 1)
                yield transform(batch.slice(a, b - a), plan)
                a = b
    return run


def fill_in_middle(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``doc_id, n, form, prefix_units, middle_units, output, restored`` of every row.

    ``n`` counts the units of the text.  ``form`` is ``psm`` (prefix, suffix, middle), ``spm``
    (suffix, prefix, middle) or ``plain``: empty texts, texts that hold a sentinel, and the share
    that is left alone keep their text, and have no pieces (null).  ``restored`` is rebuilt from
    ``output`` and ``form`` alone.  Null texts are empty.  A null id counts as an empty string in
    the hash.  Rows that repeat an id are cut by the same numbers, each within its own text.  Texts
    of any length are cut as a whole.  An empty table gives an empty result; other columns are
    ignored."""
    doc = F.col("doc_id").cast("long")
    digest = F.sha2(F.concat(F.lit(f"{plan.seed}:"), F.coalesce(doc.cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(doc.alias("doc_id"), F.col("text").cast("string").alias("text"), *numbers)
    return rows.mapInArrow(_batches(plan), "doc_id long, n long, form string, prefix_units long, "
                                           "middle_units long, output string, restored string")
