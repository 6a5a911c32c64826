"""The corpus pipeline against a chain of brute-force stages over a whole small table."""

import os
import sys

import duckdb
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

import corpus_pipeline  # noqa: E402
import llm_fixtures as fx  # noqa: E402
from capacitron.llm import oracles  # noqa: E402
from test_ops_dedup import components, removed  # noqa: E402
from test_ops_text import leaks  # noqa: E402

SF = "/root/testdata/sf0.001"


def chain(docs, items):
    """``(doc_id, ids)`` of the documents that every stage keeps, and their number after each."""
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": [d[0] for d in docs], "text": [d[1] for d in docs]}))
    good = {d for d, kept in con.execute(f"SELECT doc_id, kept FROM ({oracles.quality_sql()})").fetchall() if kept}
    docs = [d for d in docs if d[0] in good]
    sizes = [len(docs)]
    docs = list({(d[0], d[1]): d for d in docs}.values())
    docs = [d for d, (i, n, low) in zip(docs, components(docs)) if not n or low == i]
    sizes.append(len(docs))
    docs = [(d[0], x[4].decode("utf-8", "ignore"), d[2], d[3]) for d, x in zip(docs, removed(docs, 200)) if x[4] or not x[1]]
    sizes.append(len(docs))
    docs = [d for d, leak in zip(docs, leaks(docs, items)) if not leak[-1]]
    sizes.append(len(docs))
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return [(d[0], d[3], len(ids := model.encode(d[1])), tuple(ids), True) for d in docs], sizes


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The documents of the smallest scale, with copies, near copies and leaks between them."""
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    good = [d for d in docs if d[1] and len(d[1].split()) > 150][:12]
    new = max(d[0] for d in docs) + 1
    for k, d in enumerate(good):
        words = d[1].split(" ")
        words[5:6] = ["changed"]
        docs += [(new + 4 * k, " ".join(words), *d[2:]), (new + 4 * k + 1, d[1], *d[2:]),
                 (new + 4 * k + 2, d[1][::-1].replace("<", " ") + " " + d[1][:260], *d[2:]),
                 (new + 4 * k + 3, d[1][::-1] + "\n" + items[k][1] + "\n", *d[2:])]
    docs += [(new + 900, None, "en", "s", None), (new + 901, "", "en", "s", 0), docs[0], docs[0]]
    spark.createDataFrame(docs, fx.SCHEMA).repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string" if isinstance(items[0][0], str) else "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, items


def test_pipeline_equals_the_chain(spark, tables):
    folder, docs, items = tables
    exp, sizes = chain(docs, items)
    assert len(docs) > sizes[0] > sizes[1] >= sizes[2] > sizes[3] > 20
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "source", "n_pieces", "ids", "restored"]
    assert sorted((r.doc_id, r.source, r.n_pieces, tuple(r.ids), r.restored) for r in got.collect()) == sorted(exp)


def test_stages_keep_the_columns(spark, tables):
    folder, docs, items = tables
    frame = fx.frame(spark, docs, clash=True)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, folder).columns == frame.columns, name


def test_empty_documents(spark, tables, tmp_path):
    spark.createDataFrame([], fx.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables[0]}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
