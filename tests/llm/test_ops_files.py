"""Archives, URL verdicts, sharding and toxicity."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import llm_fixtures as fx
from capacitron.llm import sharding, toxicity, url_filter, warc
from capacitron.llm.shared import file_system

PAGES = "page_id long, url string, html string"


def bag(rows):
    return sorted(map(tuple, rows), key=repr)


def pages():
    out = [(i, f"https://a.example.com/en/{i}", f"<p>{i % 4}</p>") for i in range(12)]
    out += [(20, None, None), (21, "x", ""), (22, "http://e.net/\r\nWARC-Type: x", "é" * 300_000), (23, "http://e.net", "\r\n\r\nWARC/1.1")]
    return out + [out[3], (None, "http://z.org/", "<p>1</p>")]


@pytest.mark.parametrize("least", [0, 5])
def test_archives(spark, monkeypatch, least):
    monkeypatch.setattr(warc, "FRAME_BYTES", 900)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 3000)
    df = spark.createDataFrame(pages(), PAGES).repartition(2).withColumn("sha", F.lit("other")).withColumn("first", F.lit(1))
    index = warc.write_archives(df, least)
    got = warc.read_archives(index)
    smallest = {}
    for p, _, h in pages():
        if p is not None:
            smallest[h or ""] = min(p, smallest.get(h or "", p))
    exp = []
    for p, _, h in pages():
        raw, first = (h or "").encode(), smallest[h or ""]
        again = first != p and len(raw) >= least
        exp.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                    "revisit" if again else "response", first if again else None))
    assert bag(got.drop("url").collect()) == bag(exp)
    for r in index.collect():                                # every record by its frame alone
        head, block = warc.fetch(r.uri, r.path, r.frame, r.offset)
        assert head["WARC-Record-ID"] == r.record_id and head["WARC-Type"] == r.record_type
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], PAGES))).count() == 0


def test_bundle_is_plain_zstandard(spark):
    import io

    import zstandard
    r = warc.write_archives(spark.createDataFrame(pages()[:3], PAGES).coalesce(1)).first()
    fs, _ = file_system(r.uri)
    with fs.open_input_stream(r.path, compression=None) as f:
        raw = f.read()
    text = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert text.count(b"WARC/1.1\r\n") == 3


URLS = [("http://example.com/en/x", "block"), ("https://WWW.Example.com/en/x?q", "allow"), ("http://b.example.com/en/", "block"),
        ("http://q.net/es/1", "block"), ("http://q.net/de/1", "allow"), ("http://q.org", "allow"), ("nothing", "allow"), (None, "allow"),
        ("http://notexample.com/en/x", "allow"), ("http://example.com", "allow")]


def test_rules(spark):
    df = spark.createDataFrame([(i, u, None) for i, (u, _) in enumerate(URLS)], PAGES).withColumn("host", F.lit(1))
    got = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    assert [got[i].verdict for i in range(len(URLS))] == [v for _, v in URLS]
    assert got[1].host == "www.example.com" and got[1].path == "/en/x" and got[1].rule == "www.example.com/en/"
    assert got[6].host == got[7].path == "" and got[5].rule is None
    assert url_filter.judge_urls(spark.createDataFrame([], PAGES)).count() == 0


def test_aliases(spark):
    rows = [(1, "http://a.org/1", '<link href="http://b.org/2" rel="canonical">'),
            (2, "http://b.org/2", "<META http-equiv='refresh' content='0; url=//bad.net/es/'>"),
            (3, "http://c.org/3", '<link rel=canonical href=/4>'), (4, "http://c.org/4", None),
            (5, "http://d.org/5", '<link rel="canonical" href="http://bad.net/es/"><link rel="canonical" href="http://ok.com/">'),
            (6, "http://bad.net/fr/", '<link rel="canonical" href="http://e.org/6">'), (7, "http://e.org/6", ""), (7, "http://e.org/6", "")]
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(rows[:4] + rows[5:], PAGES)).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 6: "block", 7: "block"}
    both = {r.page_id: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(rows, PAGES)).collect()}
    assert both[5] == both[1] == "allow" and both[6] == "block"   # an allowed alias, but the own rule stands


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000])
def test_permutation(n):
    p = sharding.permute(np.arange(n), n, 5)
    assert sorted(p.tolist()) == list(range(n))
    assert sharding.unpermute(p, n, 5).tolist() == list(range(n))


def test_sharding(spark):
    docs = fx.rows()[0] + [(None, "x", "", "", 0)]
    got = sharding.shard_documents(fx.frame(spark, docs, clash=True))
    raw = lambda t: (t or "").encode()
    assert bag(got.select("doc_id", "size", "text_crc32").collect()) == bag((d[0], len(raw(d[1])) + 1, zlib.crc32(raw(d[1]))) for d in docs)
    slots = {}
    for r in got.collect():
        slots.setdefault(r.shard, []).append(r.slot)
        assert sharding.row_at(r.shard, r.slot, len(docs), 8, 20240229) == r.row_number
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots.get(s, [])) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    again = sharding.shard_documents(fx.frame(spark, docs[::-1]).repartition(7))
    assert bag(got.collect()) == bag(again.collect())
    assert sharding.shard_documents(spark.createDataFrame([], fx.SCHEMA)).count() == 0


def test_toxicity(spark):
    rng = random.Random(4)
    bad = ["vermin", "filthbag", "dreckle"]
    docs, labels = [], []
    for i in range(700):
        toxic = i % 3 == 0
        w = fx.words(rng, 60).split()
        for _ in range(4 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        docs.append((i, " ".join(w), "", "", 0))
        labels.append((i, 0, int(toxic)))
    docs += [(700, None, "", "", 0), (701, "", "", "", 0), (None, "vermin", "", "", 0), (702, "z" * 90_000, "", "", 0)]
    marks = spark.createDataFrame(labels + [(3, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    df = fx.frame(spark, docs, clash=True)
    got = toxicity.score_documents(df, toxicity.fit(toxicity.training_rows(df, marks))).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(r.predicted, int(r.doc_id % 3 == 0)) for r in got if r.held_out and r.doc_id < 700]
    assert len(held) > 100 and sum(a == b for a, b in held) / len(held) > 0.95
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_toxicity_without_labels(spark):
    model = toxicity.fit([])
    assert {r.predicted for r in toxicity.score_documents(fx.frame(spark), model).collect()} == {0}
    assert toxicity.score_documents(spark.createDataFrame([], fx.SCHEMA), model).count() == 0
