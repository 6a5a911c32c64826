"""Jaccard join and suffix-array dedup against brute force."""

import collections
import hashlib

import numpy as np
import pytest

import llm_fixtures as fx
from capacitron.llm import induced_sort, jaccard_join, shingles, suffix_dedup
from capacitron.llm.components import connected_components


def bag(rows):
    return sorted(map(tuple, rows), key=repr)


def components(docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for d in docs:
        w = (d[1] or "").translate(low).encode().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and docs[i][0] is not None and docs[j][0] is not None and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(docs)):
        groups[find(i)].append(docs[i][0])
    return [(d[0], len(sets[i]), None if d[0] is None else min(groups[find(i)])) for i, d in enumerate(docs)]


@pytest.mark.parametrize("region", [32, 2])
def test_jaccard_join(spark, monkeypatch, region):
    """With a tiny region size nearly every region goes through the rounds of set pivots; one band
    of min-hashes leaves many links to the regions."""
    monkeypatch.setattr(jaccard_join, "REGION", region)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 1 if region == 2 else 8)
    monkeypatch.setattr(jaccard_join, "BANDS", 1 if region == 2 else 4)
    monkeypatch.setattr(jaccard_join, "PORTION", 2)
    docs = fx.rows()[0] + [(None, "one two three four", "", "", 0)]
    got = jaccard_join.near_duplicates(fx.frame(spark, docs, clash=True)).drop("text_hash")
    assert bag(got.collect()) == bag(components(docs))


def test_one_of_each(spark):
    docs = fx.rows()[0]
    got = jaccard_join.one_of_each(fx.frame(spark, docs, clash=True))
    assert got.columns == fx.frame(spark, docs, clash=True).columns
    lowest = {(d, c) for d, n, c in components(docs) if n}
    exp = sorted([d for d, c in lowest if d == c] + [d for d, n, _ in components(docs) if not n])
    assert sorted(r.doc_id for r in got.collect()) == exp


def test_empty(spark):
    empty = spark.createDataFrame([], fx.SCHEMA)
    assert jaccard_join.near_duplicates(empty).count() == 0
    assert suffix_dedup.removal_digests(empty).count() == 0
    assert suffix_dedup.without_repeats(empty).count() == 0


def test_parity_is_a_lower_bound():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64)) for _ in "ab")
        assert shingles.parity_distance(shingles.parity_map(a), shingles.parity_map(b)) <= len(np.setxor1d(a, b))


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, i) for i in range(60, 90)] + [(7, 7), (None, 3), (99, 98)]
    df = spark.createDataFrame(edges, "x long, y long")
    got = dict(connected_components(df, "x", "y").collect())
    assert got == {**{i: 0 for i in range(21)}, 50: 50, **{i: 50 for i in range(60, 90)}, 98: 98, 99: 98}


@pytest.mark.parametrize("memory", [64 << 20, 1500])
def test_suffix_array(monkeypatch, memory):
    """The second size spills the queues and maps the arrays."""
    monkeypatch.setattr(induced_sort, "MEMORY", memory)
    rng = np.random.default_rng(0)
    for k in range(150):
        t = rng.integers(1, rng.integers(1, 6) + 1, rng.integers(1, 90))
        t = np.concatenate([t, t[:len(t) // 2], [0], t]) if k % 3 == 0 else t
        t = np.append(t, 0)
        sa, lcp = induced_sort.suffix_array(t)
        text = t.tolist()
        exp = sorted(range(len(text)), key=lambda i: text[i:])
        assert sa.tolist() == exp
        for a, b, n in zip(exp, exp[1:], lcp[1:]):
            m = next(i for i in range(len(text) + 1) if text[a + i:a + i + 1] != text[b + i:b + i + 1] or a + i >= len(text))
            assert n == m


def removed(docs, length):
    texts = [(d[1] or "").encode() for d in docs]
    seen = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    for d, t in zip(docs, texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        edges = np.diff(np.concatenate(([0], gone.view(np.int8))))
        left = bytes(b for b, g in zip(t, gone) if not g)
        yield d[0], len(t), int(gone.sum()), int((edges == 1).sum()), left


@pytest.mark.parametrize("length,gram,chunk", [(200, 64, 500_000), (24, 8, 40), (256, 64, 500), (300, 64, 1)])
def test_suffix_dedup(spark, monkeypatch, length, gram, chunk):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    docs = fx.rows()[0] + [(None, "one two three four five six seven eight nine ten", "", "", 0)]
    got = suffix_dedup.removal_digests(fx.frame(spark, docs, clash=True), length, gram)
    assert bag(got.collect()) == bag((*x[:4], hashlib.sha256(x[4]).hexdigest()) for x in removed(docs, length))


@pytest.mark.parametrize("shared", [64, 150, 199])
def test_hot_anchor_is_divided(spark, monkeypatch, tmp_path, shared):
    """A passage that most documents share with other surroundings: no sort takes more than two
    shards, and the strings that a few of them share are found on both sides of the passage."""
    limit, sizes, sort = 20_000, str(tmp_path / "sizes"), suffix_dedup.repeated_starts

    def watched(parts, length):
        with open(sizes, "a") as f:
            f.write(f"{sum(map(len, parts))}\n")
        return sort(parts, length)

    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", limit)
    monkeypatch.setattr(suffix_dedup, "repeated_starts", watched)
    rng = np.random.default_rng(5)

    def some(n):
        return "".join(map(chr, rng.integers(97, 123, n)))

    # of many passages the one with the least hash, so that it is the anchor of what holds it
    passage = min((some(shared) for _ in range(400)), key=lambda p: min(suffix_dedup.anchors(p.encode(), len(p), 64)[0].view(np.uint64)))
    before, after = some(150), some(150)
    texts = [some(220) + passage + some(220) for _ in range(400)]
    for k in range(12):                                   # equal strings that reach over the passage
        texts += [some(90) + before[k * 11:] + passage + some(200), some(200) + passage + after[:150 - k * 11] + some(90)]
    texts += [some(70) + before[-70:] + passage + after[:70] + some(70) for _ in range(3)] + texts[:2]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    got = suffix_dedup.removal_digests(fx.frame(spark, docs))
    exp = list(removed(docs, 200))
    assert sum(x[2] > 0 for x in exp) > 10
    assert bag(got.collect()) == bag((*x[:4], hashlib.sha256(x[4]).hexdigest()) for x in exp)
    assert max(map(int, open(sizes))) <= 2 * limit


@pytest.mark.parametrize("length", [255, 256, 300, 1000])
def test_strings_of_any_length(spark, length):
    """Texts that share 500 bytes, and one that repeats a string of its own."""
    rng = np.random.default_rng(11)

    def some(n):
        return "".join(map(chr, rng.integers(97, 123, n)))
    shared, own = some(500), some(1200)
    docs = [(i, some(300) + shared + some(300), "", "", 0) for i in range(4)] + [(9, own + some(50) + own, "", "", 0)]
    got = suffix_dedup.removal_digests(fx.frame(spark, docs), length)
    assert bag(got.collect()) == bag((*x[:4], hashlib.sha256(x[4]).hexdigest()) for x in removed(docs, length))


def test_very_long_text(spark):
    """Megabytes in one text, of which two others hold a part."""
    rng = np.random.default_rng(12)
    long_ = "".join(map(chr, rng.integers(97, 123, 3_000_000)))
    docs = [(1, long_, "", "", 0), (2, long_[1_000_000:1_000_450], "", "", 0), (3, "x" * 100 + long_[-260:], "", "", 0), (4, long_ + "!", "", "", 0)]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.removal_digests(fx.frame(spark, docs)).collect()}
    assert got == {1: (3_000_000, 1), 2: (450, 1), 3: (260, 1), 4: (3_000_000, 1)}


def test_halves_keep_equal_strings_together():
    """Every string start is in one half; equal strings with equal cores get equal new cores."""
    rng = np.random.default_rng(2)
    for _ in range(300):
        length, gram = int(rng.integers(9, 40)), 8
        text = bytes(rng.integers(97, 99, int(rng.integers(length, 2 * length - gram + 1))).astype(np.uint8))
        at = int(rng.integers(len(text) - length, length - gram + 1))    # in every string of the fragment
        todo, rounds, seen = [(0, text, at, at + gram)], 0, []
        while todo:
            low, part, a, b = todo.pop()
            if b - a == length:
                assert len(part) == length
                seen.append(low)
                continue
            for _, shift, piece, x, y in suffix_dedup.halves(part, a, b, length):
                assert piece == part[shift:shift + len(piece)] and 0 <= x < y <= len(piece) and y - x > b - a
                n = len(piece) - length
                assert n >= 0 and x >= n and y <= length                 # the core is in every string
                todo.append((low + shift, piece, x, y))
        assert sorted(seen) == list(range(len(text) - length + 1))


def test_cut_texts(spark):
    docs = fx.rows()[0]
    got = suffix_dedup.without_repeats(fx.frame(spark, docs, clash=True))
    assert got.columns == fx.frame(spark, docs, clash=True).columns
    exp = [(x[0], d[1] if d[1] is None else x[4].decode()) for x, d in zip(removed(docs, 200), docs) if x[4] or not x[1]]
    assert bag(got.select("doc_id", "text").collect()) == bag(exp)
    assert not got.where("n_chars <> char_length(text) AND doc_id <> 5").count()


def test_region_members_meet_in_blocks(spark, monkeypatch):
    """Members of large regions meet inside tasks: no row for a pair that fails the tests, one for
    a pair of many common regions, and the pairs are those of brute force."""
    monkeypatch.setattr(jaccard_join, "PIVOT_BLOCK", 7)
    monkeypatch.setattr(jaccard_join, "MEMBER_BLOCK", 11)
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2 ** 63, 145).astype(np.uint64)
    sets = [np.unique(np.concatenate([np.delete(base, range(k, k + 5 * (1 + i % 2))), rng.integers(0, 2 ** 63, 5 * (1 + i % 2)).astype(np.uint64)]))
            for i, k in enumerate(rng.integers(0, 130, 60))]
    rows, maps = [], []
    for i, s in enumerate(sets):
        s = np.sort(s)
        prefix = s[:len(s) - -(-8 * len(s) // 10) + 1].view(np.int64).tolist()
        rows += [(k, i, len(s), place, i) for place, k in enumerate(prefix)]
        maps.append((i, [k ^ -(1 << 63) for k in prefix][:jaccard_join.EARLY], bytearray(shingles.parity_map(s))))
    named = spark.createDataFrame(rows, "key long, node long, n int, place int, _g long")
    pivots = named.selectExpr("key", "node", "2 AS _r")
    pairs = jaccard_join._pivot_pairs(named, pivots, spark.createDataFrame(maps, "node long, early array<long>, map binary"), None).where("ok").collect()
    bound = {(i, j): shingles.parity_distance(maps[i][2], maps[j][2]) for i in range(60) for j in range(i)}
    exact = {(j, i) for i, j in bound if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert exact <= {(r.a, r.b) for r in pairs}
    assert all(r.bound == bound[r.b, r.a] for r in pairs)
    assert max(collections.Counter((r.a, r.b) for r in pairs).values()) == 2       # each of a pair is a pivot once


def test_few_edges_take_no_rounds(spark, monkeypatch):
    from capacitron.llm import components as cc
    edges = spark.createDataFrame([("b", "c"), ("a", "b"), ("x", "y")], "u string, v string")
    few = dict(connected_components(edges, "u", "v").collect())
    monkeypatch.setattr(cc, "FEW_EDGES", 0)
    assert few == dict(connected_components(edges, "u", "v").collect()) == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_a_task_gives_its_memory_back(spark):
    """A worker that has held 300 MB in small pieces is small again in its next task."""
    from capacitron.llm.shared import freed

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 >> 20

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            held = [np.ones(12_500) for _ in range(3000)]
            last = np.ones(10)                                  # lies above the pieces
            del held
            yield pa.RecordBatch.from_arrays([pa.array([int(last.sum())])], names=["n"])

    def size(batches):
        import os
        import pyarrow as pa
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([resident()])], names=["pid", "mb"])

    one = spark.range(1).coalesce(1)
    assert one.mapInArrow(freed(run), "n long").collect()[0].n == 10
    assert one.mapInArrow(size, "pid long, mb long").collect()[0].mb < 300
