"""Suffix arrays with common prefixes by induced sorting over queues (numpy).

A text is classified into suffixes smaller (S) and larger (L) than their successor.  The
leftmost S suffixes (LMS) are sorted through a reduced text of their substrings' names; from
them all L suffixes and then all S suffixes are induced.  Induction runs symbol by symbol: the
suffixes that start with a symbol wait in that symbol's queue in their final order, so the
queues together are a priority queue of (symbol, arrival).  Each entry carries its position and
its common prefix with its predecessor; the common prefix of two induced neighbours is one more
than the least value scanned between their sources.

Waiting queue entries move to a temporary file beyond ``MEMORY`` bytes and the largest arrays are
mapped to files, but scanned entries, kinds and names stay in memory: the caller bounds the text
(:mod:`.suffix_dedup` by its shards).  Common prefixes are settled up to the depth asked for, in
the narrowest integers that hold it.
"""

from __future__ import annotations

import tempfile

import numpy as np

MEMORY = 64 << 20
#: Depth to which common prefixes are settled unless another one is asked for.
DEPTH = 255


def _kind_of(cap: int):
    return np.uint8 if cap < 1 << 8 else np.uint16 if cap < 1 << 16 else np.int64


def _array(n: int, dtype) -> np.ndarray:
    if n * np.dtype(dtype).itemsize <= MEMORY:
        return np.zeros(n, dtype)
    return np.memmap(tempfile.TemporaryFile(), dtype, "w+", shape=(n,))


class Queues:
    """A first-in first-out queue of (position, common prefix) for every symbol."""

    def __init__(self, symbols: int, kind=np.uint8):
        self.held: list[list] = [[] for _ in range(symbols)]
        self.size, self.file, self.kind = 0, None, kind

    def push(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.held[symbol].append((pos, lcp))
        self.size += pos.nbytes + lcp.nbytes
        if self.size > MEMORY:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for queue in self.held:
            for k, entry in enumerate(queue):
                if len(entry) == 2:
                    at = self.file.tell()
                    entry[0].tofile(self.file)
                    entry[1].tofile(self.file)
                    queue[k] = (at, len(entry[0]), None)
        self.size = 0

    def pop(self, symbol: int):
        """Everything that waits for a symbol, in order, or None."""
        queue, self.held[symbol] = self.held[symbol], []
        if not queue:
            return None
        parts = []
        for entry in queue:
            if len(entry) == 3:
                self.file.seek(entry[0])
                entry = (np.fromfile(self.file, np.int64, entry[1]), np.fromfile(self.file, self.kind, entry[1]))
            else:
                self.size -= entry[0].nbytes + entry[1].nbytes
            parts.append(entry)
        if len(parts) == 1:
            return parts[0]
        return np.concatenate([p for p, _ in parts]), np.concatenate([v for _, v in parts])


class _Inducer:
    """Pushes the predecessors of scanned suffixes, with their common prefixes."""

    def __init__(self, text, kind, symbols: int, want: bool, cap: int):
        self.text, self.kind, self.want, self.cap, self.small = text, kind, want, cap, _kind_of(cap)
        self.queues = Queues(symbols, self.small)
        self.least = np.zeros(symbols, self.small)     # least common prefix since a symbol's last push

    def scan(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        """``lcp[k]``: common prefix of scanned suffix k and the one scanned before it."""
        for a in range(0, len(pos), 1 << 18):
            self._scan(pos[a:a + (1 << 18)], lcp[a:a + (1 << 18)])

    def _scan(self, pos, lcp) -> None:
        at = np.flatnonzero(pos > 0)
        before = pos[at] - 1
        good = self.kind[before] == self.want
        at, before = at[good], before[good]
        low = int(lcp.min())
        if not len(at):
            np.minimum(self.least, low, out=self.least)
            return
        symbol = self.text[before]
        order = np.argsort(symbol, kind="stable")
        symbol, at, before = symbol[order], at[order], before[order]
        first = np.concatenate(([True], symbol[1:] != symbol[:-1]))
        start = np.where(first, 0, np.concatenate(([0], at[:-1] + 1)))
        value = _range_min(lcp, start, at)
        groups = np.flatnonzero(first)
        owner = symbol[groups]
        value[groups] = np.minimum(value[groups], self.least[owner])
        value = np.minimum(value, self.cap - 1) + self.small(1)
        ends = np.append(groups[1:], len(at))
        last = at[ends - 1]
        tail = np.full(len(last), self.cap, self.small)
        inner = last + 1 < len(lcp)
        if inner.any():
            tail[inner] = _range_min(lcp, last[inner] + 1, np.full(int(inner.sum()), len(lcp) - 1))
        np.minimum(self.least, low, out=self.least)
        self.least[owner] = tail
        for s, a, b in zip(owner.tolist(), groups.tolist(), ends.tolist()):
            self.queues.push(s, before[a:b], value[a:b])


def _range_min(v: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least of v[a..b] for many ranges, by a table of powers of two."""
    length = b - a + 1
    level = np.frexp(length.astype(np.float64))[1] - 1
    out = np.empty(len(a), v.dtype)
    table, width = v, 1
    for k in range(int(level.max()) + 1):
        pick = np.flatnonzero(level == k)
        out[pick] = np.minimum(table[a[pick]], table[b[pick] - width + 1])
        table = np.minimum(table[:-width], table[width:]) if len(table) > width else table
        width *= 2
    return out


def _kinds(text: np.ndarray, cap: int):
    """S flags, and how many equal symbols follow from each position."""
    n = len(text)
    edge = np.flatnonzero(np.append(text[1:] != text[:-1], True))       # last place of each run
    run_of = np.searchsorted(edge, np.arange(n))
    end = edge[run_of]
    follow = np.append(text, -1)[end + 1]
    kind = _array(n, bool)
    kind[:] = follow > text
    kind[n - 1] = True                                                 # by definition
    run = _array(n, _kind_of(cap))
    run[:] = np.minimum(end - np.arange(n) + 1, cap)
    return kind, run


def _induce(text, kind, run, lms, seed_lcp, symbols: int, cap: int):
    """All suffixes, and their common prefixes, from the LMS suffixes in order."""
    heads = np.searchsorted(text[lms], np.arange(symbols + 1))          # the LMS of each symbol
    larger, left = _Inducer(text, kind, symbols, False, cap), [[] for _ in range(symbols)]
    for c in range(symbols):
        edge = None                                                    # last scanned of this symbol
        while (got := larger.queues.pop(c)) is not None:
            pos, lcp = got
            if edge is None:
                lcp = lcp.copy()
                lcp[0] = 0
            left[c].append((pos, lcp))
            larger.scan(pos, lcp)
            edge = pos[-1]
        a, b = heads[c], heads[c + 1]
        if b > a:
            lcp = seed_lcp[a:b].copy()
            lcp[0] = 0 if edge is None else min(run[edge], run[lms[a]])
            larger.scan(lms[a:b], lcp)
    smaller, right = _Inducer(text, kind, symbols, True, cap), [[] for _ in range(symbols)]
    for c in range(symbols - 1, -1, -1):
        edge = None
        while (got := smaller.queues.pop(c)) is not None:
            pos, lcp = got
            if edge is None:
                lcp = lcp.copy()
                lcp[0] = 0
            right[c].append((pos, lcp))
            smaller.scan(pos, lcp)
            edge = pos[-1]
        if left[c]:
            pos = np.concatenate([p for p, _ in left[c]])
            asc = np.concatenate([v for _, v in left[c]])
            lcp = np.empty_like(asc)
            lcp[1:] = asc[:0:-1]
            lcp[0] = 0 if edge is None else min(run[edge], run[pos[-1]])
            smaller.scan(pos[::-1], lcp)
            left[c] = [(pos, asc)]
    n = len(text)
    sa, out, at = _array(n, np.int64), _array(n, _kind_of(cap)), 0
    for c in range(symbols):
        if c == text[n - 1]:                                           # the last suffix has no successor
            sa[at], out[at] = n - 1, 0
            at += 1
        for pos, lcp in left[c]:
            sa[at:at + len(pos)], out[at:at + len(pos)] = pos, lcp
            at += len(pos)
        if right[c]:
            pos = np.concatenate([p for p, _ in right[c]])[::-1]
            desc = np.concatenate([v for _, v in right[c]])
            lcp = np.empty_like(desc)
            lcp[1:] = desc[:0:-1]
            lcp[0] = min(run[sa[at - 1]], run[pos[0]]) if at and text[sa[at - 1]] == c else 0
            sa[at:at + len(pos)], out[at:at + len(pos)] = pos, lcp
            at += len(pos)
    return sa, out


def _same(text, a, b, limit) -> np.ndarray:
    """Common symbols of the suffixes at a and b, up to a limit for each pair."""
    n, out = len(text), np.zeros(len(a), np.int64)
    live, k = np.arange(len(a)), 0
    while len(live):
        live = live[(k < limit[live]) & (a[live] + k < n) & (b[live] + k < n)]
        live = live[text[a[live] + k] == text[b[live] + k]]
        out[live] += 1
        k += 1
    return out


def _sort_names(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the reduced text's suffixes over at least ``depth`` names."""
    symbols = int(names.max()) + 1
    if symbols == len(names):
        return np.argsort(names, kind="stable")
    if symbols <= 1 << 12 and len(names) > 8 * symbols:
        return suffix_array(names + 1, depth)[0]                       # small alphabet: induce again
    rank, step = names.astype(np.int64), 1
    while step < depth:                                                # large alphabet: double the ranks
        second = np.zeros(len(rank), np.int64)
        second[:-step] = rank[step:] + 1
        _, new = np.unique(rank * (len(rank) + 1) + second, return_inverse=True)
        rank, step = new.reshape(-1), 2 * step
        if int(rank.max()) + 1 == len(rank):
            break
    return np.argsort(rank, kind="stable")


def suffix_array(text: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of an integer text in order, and the common prefix of each with the one before
    it (0 for the first), both settled up to ``depth`` symbols."""
    text = np.asarray(text).astype(np.int32 if len(text) and text.max() > 32000 else np.int16)
    n = len(text)
    if n < 2:
        return np.arange(n), np.zeros(n, _kind_of(depth))
    symbols = int(text.max()) + 1
    kind, run = _kinds(text, depth)
    lms = np.flatnonzero(kind[1:] & ~kind[:-1]) + 1
    if not len(lms):
        lms = np.array([n - 1])
    ends = np.append(lms[1:], n - 1)
    if len(lms) > 1:
        # the LMS substrings are put in order by inducing from their first symbols alone
        by_symbol = lms[np.argsort(text[lms], kind="stable")]
        rough, _ = _induce(text, kind, run, by_symbol, np.zeros(len(lms), _kind_of(depth)), symbols, depth)
        mark = np.zeros(n, np.int64)
        mark[lms] = np.arange(1, len(lms) + 1)
        order = mark[rough]
        order = order[order > 0] - 1                                   # LMS numbers by substring
        length = ends - lms + 1
        a, b = order[:-1], order[1:]
        equal = length[a] == length[b]
        equal[equal] = _same(text, lms[a[equal]], lms[b[equal]], length[a[equal]]) == length[a[equal]]
        names = np.empty(len(lms), np.int64)
        names[order] = np.concatenate(([0], np.cumsum(~equal)))
        lms = lms[_sort_names(names, depth)]
    seed = np.zeros(len(lms), _kind_of(depth))
    seed[1:] = _same(text, lms[:-1], lms[1:], np.full(len(lms) - 1, depth))
    return _induce(text, kind, run, lms, seed, symbols, depth)
