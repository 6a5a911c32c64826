"""Quality rules, pieces, token files and decontamination against plain Python."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest

import llm_fixtures as fx
from capacitron.llm import decontaminate, piece_codec, quality, token_files

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bag(rows):
    return sorted(map(tuple, rows), key=repr)


def measured(t):
    t = t or ""
    w, at = WORD.findall(t), {}
    for k in range(len(w) - 2):
        at.setdefault(tuple(w[k:k + 3]), []).append(k)
    twice = {j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + 3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(twice),
            len(w) < 50 or 100 * len(twice) > 50 * len(w))


@pytest.mark.parametrize("clash", [False, True])
def test_quality(spark, clash):
    docs = fx.rows()[0]
    got = quality.quality(fx.frame(spark, clash=clash)).cache()
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert bag(got.select(cols).collect()) == bag((d[0], *measured(d[1])) for d in docs)
    assert not [r for r in got.collect() if r.base_failed and r.kept]
    kept = quality.kept_documents(fx.frame(spark, clash=clash))
    assert kept.columns == fx.frame(spark, clash=clash).columns
    assert bag(kept.select("doc_id", "text").collect()) == bag(
        (d.doc_id, t) for d in got.where("kept").select("doc_id").distinct().collect()
        for t in [x[1] for x in docs if x[0] == d.doc_id])


def test_quality_verdicts(spark):
    good = "the man and the dog " + " ".join(f"walk{i} of" for i in range(60))
    docs = [(1, good, "", "", 0), (2, "### " * 3 + " ".join(f"w{i}%%%" for i in range(80)), "", "", 0)]
    assert bag(quality.quality(fx.frame(spark, docs)).select("doc_id", "kept").collect()) == [(1, True), (2, False)]


def test_quality_is_native(spark):
    plan = quality.quality(fx.frame(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange hash", plan)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], fx.SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert quality.quality(empty).count() == 0
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(fx.frame(spark), bench).where("contaminated").count() == 0
    assert piece_codec.piece_digests(empty, P.path("piece_bpe_32k.model")).count() == 0
    files = token_files.write_token_files(empty, P.path("byte_bpe_50k.json"), P.PATTERN)
    assert token_files.read_token_files(files).count() == 0


def leaks(docs, items):
    cut = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    win = {}
    for item, t in items:
        w = cut.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - 9)) if w else ():
            win.setdefault(tuple(w[k:k + 10]), set()).add(item)
    for d in docs:
        w, hit, found = cut.findall((d[1] or "").translate(LOWER)), set(), set()
        for n in {len(k) for k in win}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in win:
                    found |= win[tuple(w[k:k + n])]
                    hit |= set(range(k, k + n))
        ids = ",".join(sorted(map(str, found)))
        yield d[0], len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [32 << 20, 200])
def test_decontamination(spark, block):
    docs, items = fx.rows()
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs + [(999, "a Short, item HERE now", "", "", 0)]
    rows = decontaminate.matches(fx.frame(spark, docs, clash=True), bench, block_bytes=block)
    assert rows.count() == len(docs)
    if block > 1000:
        got = decontaminate.contaminated(fx.frame(spark, docs, clash=True), bench)
        assert bag(got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()) \
            == bag(leaks(docs, items))
        clean = decontaminate.clean_documents(fx.frame(spark, docs), bench)
        assert bag(clean.select("doc_id").collect()) == bag((x[0],) for x in leaks(docs, items) if not x[-1])
    else:
        assert bag((r.doc_id, len(r.hit), len(r["items"])) for r in rows.collect()) \
            == bag((x[0], x[2], x[3]) for x in leaks(docs, items))


def test_longest_match():
    t = decontaminate.TestSet([(7, b"a b c d e f g h i j k l")], 10)
    words = [t.vocab.get(w, -1) for w in b"x a b c d e f g h i j k y".split()]
    _, _, which, best, where = decontaminate.match_shard(np.array(words + [-1], np.int32), t)
    assert best[0] == 11 and where[0] == 1 and sorted(which.tolist()) == [0, 1]


def test_pieces_equal_the_library(spark):
    import sentencepiece
    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = fx.rows()[0] + [(2001, "  a  b\tc\n d ﬁ Ａ\u0001<s>", "", "", 0), (2002, " " * 70 + "x" * 400, "", "", 0)]
    got = piece_codec.encode_documents(fx.frame(spark, docs, clash=True), path)
    assert bag((r.doc_id, tuple(r["ids"])) for r in got.collect()) \
        == bag((d[0], tuple(library.encode(d[1] or ""))) for d in docs)
    back = piece_codec.decode_documents(got, path)
    assert bag(back.collect()) == bag((d[0], d[1] or "") for d in docs)


def test_shared_prefixes_are_visited_once():
    encoder = piece_codec.WordEncoder(piece_codec.load_pieces(P.path("piece_bpe_32k.model")))
    encoder.encode(["▁walk", "▁walked", "▁walking", "▁walks"])
    assert encoder.visited == len("▁walk") + len("ed") + len("ing") + len("s")


def test_token_files(spark, monkeypatch):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    docs = fx.rows()[0] + [(None, "no id", "", "", 0), (3001, "it's  <|endoftext|>՘ don't\n\n 12 ok ", "", "", 0)]
    monkeypatch.setattr(token_files, "FILE_TOKENS", 3000)
    files = token_files.write_token_files(fx.frame(spark, docs, clash=True), P.path("byte_bpe_50k.json"), P.PATTERN)
    got = token_files.read_token_files(files).collect()
    exp = []
    for d in docs:
        ids = np.array(library.encode(d[1] or "", add_special_tokens=False).ids + [0], "<u4")
        exp.append((d[0], len(ids), zlib.crc32(ids.tobytes())))
    assert bag((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == bag(exp)
    got = sorted(got, key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert [r.doc_id or -1 for r in got] == sorted(r.doc_id or -1 for r in got)


def test_settled_pieces_equal_the_pretokenizer():
    encoder = token_files.Encoder(P.path("byte_bpe_50k.json"), P.PATTERN)
    for low, high in token_files.SETTLED:
        for c in map(chr, range(ord(low), ord(high) + 1, 1 if ord(high) < 0x3000 else 97)):
            text = f"a{c}b 1{c}{c} x{c} {c}'s{c}"
            cut, at = [], 0
            for piece in encoder.cut(text):
                cut.append((at, at + len(piece)))
                at += len(piece)
            assert cut == [o for _, o in encoder.library.pre_tokenizer.pre_tokenize_str(text)]


@pytest.mark.parametrize("top", [3, 300, 70_000, 20_000_000])
def test_file_round_trip(top):
    rng = np.random.default_rng(top)
    ids = rng.integers(0, top, 5003).astype(np.uint32)
    names, counts, back = token_files.unpack(token_files.pack([1, None, -4], np.array([5000, 0, 3]), ids))
    assert names == [1, None, -4] and counts.tolist() == [5000, 0, 3] and (back == ids).all()
