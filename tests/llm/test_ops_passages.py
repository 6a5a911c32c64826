"""Fill-in-the-middle, Lempel-Ziv passages and spelling variants against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import llm_fixtures as fx
from capacitron.llm import fill_middle, lz_passages, spelling


def bag(rows):
    return sorted(map(tuple, rows), key=repr)


def middle_rows(docs, plan):
    for d in docs:
        t = d[1] or ""
        seed = hashlib.sha256(f"{plan.seed}:{'' if d[0] is None else d[0]}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(seed[8 * k:8 * k + 8], 16) for k in range(4))
        units = list(t) if plan.unit == "char" else re.findall(r"[^\n]*\n|[^\n]+", t)
        x, y = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        p, m, s = ("".join(u) for u in (units[:x], units[x:y], units[y:]))
        a, b, c = plan.sentinels
        if not t or any(k in t for k in plan.sentinels) or h3 % 100 >= plan.share:
            yield d[0], len(units), "plain", None, None, t, t
        elif h4 % 100 < plan.spm_share:
            yield d[0], len(units), "spm", x, y - x, b + s + a + p + c + m, t
        else:
            yield d[0], len(units), "psm", x, y - x, a + p + b + s + c + m, t


@pytest.mark.parametrize("unit", ["char", "line"])
def test_fill_in_middle(spark, unit):
    rng = random.Random(4)
    docs = fx.rows()[0] + [(None, "null id", "", "", 0), (None, "other\nnull\n\nid", "", "", 0)]
    docs += [(1000 + i, "".join(rng.choice("ab é日😀\n<P>SM") for _ in range(rng.randint(0, 40))), "", "", 0) for i in range(150)]
    docs += [(2000, "a<P>b", "", "", 0), (2001, "<S", "", "", 0), (2002, "é" * 3_000_000 + "\n" + "x" * 2_000_000, "", "", 0)]
    plan = fill_middle.Plan(unit=unit)
    got = fill_middle.fill_in_middle(fx.frame(spark, docs, clash=True), plan)
    assert bag(got.collect()) == bag(middle_rows(docs, plan))
    assert {r.form for r in got.collect()} == {"plain", "psm", "spm"}


def test_long_texts_are_split_and_joined(monkeypatch):
    """Segments of a few bytes: characters and lines on segment borders stay whole."""
    rng = random.Random(1)
    texts = [None, "", "\n", "é"] + ["".join(rng.choice("aé😀\n") for _ in range(rng.choice([1, 5, 300]))) for _ in range(200)]
    numbers = np.array([[rng.getrandbits(32) for _ in range(4)] for _ in texts])
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()), *map(pa.array, numbers.T)],
        names=["doc_id", "text", "h1", "h2", "h3", "h4"])
    for unit in ("char", "line"):
        plan = fill_middle.Plan(unit=unit, share=100)
        monkeypatch.setattr(fill_middle, "SEGMENT", 1 << 20)
        whole = fill_middle.transform(batch, plan).to_pylist()
        monkeypatch.setattr(fill_middle, "SEGMENT", 7)
        parts = [r for b in fill_middle._batches(plan)(iter([batch])) for r in b.to_pylist()]
        assert whole == parts and all(r["restored"] == (t or "") for r, t in zip(whole, texts))


def covered(docs, window):
    low = {}
    for d in docs:
        w = (d[1] or "").encode().split()
        for i in range(len(w) - window + 1) if d[0] is not None else ():
            k = tuple(w[i:i + window])
            low[k] = min(low.get(k, d[0]), d[0])
    for d in docs:
        w = (d[1] or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1) if d[0] is not None else ():
            if low[tuple(w[i:i + window])] < d[0]:
                gone[i:i + window] = [True] * window
        edges = np.flatnonzero(np.diff([0, *gone, 0])).tolist()
        yield d[0], len(w), sum(gone), list(zip(edges[::2], edges[1::2])), b" ".join(x for x, g in zip(w, gone) if not g).decode()


def passage_docs():
    docs = fx.rows()[0]
    rng = random.Random(8)
    passage = fx.words(rng, 400)
    docs += [(3000 + i, f"{fx.words(rng, 30)} {' '.join(passage.split()[i * 9:i * 9 + 130])} {fx.words(rng, 30)}", "", "", 0) for i in range(25)]
    docs += [(2, passage, "", "", 0), (2, passage + " again " + passage, "", "", 0), (None, passage, "", "", 0), (-7, "word " * 90, "", "", 0)]
    return docs + [(4000, fx.words(rng, 60_000), "", "", 0), (4001, docs[-1][1], "", "", 0)]


@pytest.mark.parametrize("window,gram,block", [(50, 16, 1 << 18), (50, 16, 2000), (7, 4, 300), (6, 1, 1)])
def test_passages(spark, monkeypatch, window, gram, block):
    """Small blocks send large groups of fragments through single windows."""
    monkeypatch.setattr(lz_passages, "BLOCK_WORDS", block)
    docs = passage_docs()
    got = lz_passages.remove_passages(fx.frame(spark, docs, clash=True), window, gram)
    exp = list(covered(docs, window))
    assert sum(0 < x[2] < x[1] for x in exp) > 10
    assert bag((r.doc_id, r.n_words, r.n_removed, [tuple(s) for s in r.removed], r.kept) for r in got.collect()) == bag(exp)


def test_factors_cover_every_repeated_window():
    rng = random.Random(3)
    for _ in range(150):
        window, letters = rng.choice([2, 3, 5, 8]), [b"a", b"b", b"c", b"dd"][:rng.randint(1, 4)]
        base = [rng.choice(letters) for _ in range(60)]
        parts = []
        for _ in range(rng.randint(1, 25)):
            a = rng.randrange(40)
            w = [x if rng.random() > .05 else rng.choice(letters) for x in base[a:a + rng.randint(window, 30)]]
            parts.append(b" ".join(w + letters[:1] * max(0, window - len(w))))
        first = np.array([rng.randrange(-4, 9) for _ in parts])
        low = {}
        split = [p.split(b" ") for p in parts]
        for w, f in zip(split, first):
            for i in range(len(w) - window + 1):
                low[tuple(w[i:i + window])] = min(low.get(tuple(w[i:i + window]), f), f)
        got = lz_passages.factor(parts, first, window)
        assert [{i for s in g for i in range(s["a"], s["b"] + 1)} for g in got] == \
            [{i for i in range(len(w) - window + 1) if low[tuple(w[i:i + window])] < f} for w, f in zip(split, first)]


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def spelled(docs, least_length, least_count, noise, ratio):
    total = collections.Counter()
    for d in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", d[1] or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d[0] is None else d[0]}:{run}".encode())
            total[run[:h % len(run)] + run[h % len(run) + 1:] if noise and h % noise == 0 else run] += 1
    words = {w: n for w, n in total.items() if len(w) >= least_length and n >= least_count}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        yield w, form[w], root, words[w], len(near[w]), None if form[w] is None else words[form[w]]


@pytest.mark.parametrize("length,count,noise,gram_list", [(6, 5, 199, 12), (6, 1, 7, 1), (2, 1, 3, 2), (3, 2, 0, 10_000)])
def test_spelling_variants(spark, monkeypatch, length, count, noise, gram_list):
    monkeypatch.setattr(spelling, "LIST", gram_list)
    monkeypatch.setattr(spelling, "HELD", 50)
    rng = random.Random(6)
    docs = fx.rows()[0] + [(None, "Straße STRASSE straße Étude étude étüde ÿÿÿÿÿÿ", "", "", 0)]
    chain = ["abcdefgh"] * 200 + ["abcdefg"] * 20 + ["abcdefx"] * 2 + ["ABCDEFGH", "éclairs", "éclairé"] * 9
    docs += [(500 + i, " ".join(rng.sample(chain, len(chain))), "", "", 0) for i in range(6)]
    docs += [(900, " ".join("".join(rng.choice("abcd") for _ in range(rng.randint(2, 9))) for _ in range(300)), "", "", 0)]
    got = spelling.spelling_variants(fx.frame(spark, docs, clash=True), length, count, noise)
    exp = list(spelled(docs, length, count, noise, 5))
    assert any(x[1] and x[2] != x[1] for x in exp)
    assert bag(got.select("word", "form", "root", "n", "n_near", "form_n").collect()) == bag(exp)


def test_joins_of_the_spelling_index_are_sorted(spark):
    """Exploded tables look as small as what they are made of: none may go to the driver whole."""
    words = spark.createDataFrame([("abcdefgh", 90), ("abcdefg", 9), ("abcdefx", 1)], "word string, n long")
    stored = words.select("word", F.char_length("word").alias("length"))
    for df in (spelling._index(stored), spelling.near_words(words), spelling.variants(words)):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_empty(spark):
    empty = spark.createDataFrame([], fx.SCHEMA)
    assert fill_middle.fill_in_middle(empty).count() == 0
    assert lz_passages.remove_passages(empty).count() == 0
    assert spelling.spelling_variants(empty).count() == 0
    assert spelling.spelling_variants(empty.union(spark.createDataFrame([(1, None, None, None, None)], fx.SCHEMA))).count() == 0
