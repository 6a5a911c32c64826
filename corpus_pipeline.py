"""The corpus pipeline: quality rules, near duplicates, repeated passages, leaks, token pieces.

``STAGES`` are applied in order by :func:`run`; every stage's rows are written as Parquet in the
shared folder and read again as the next stage's documents.  Every stage works on all rows its
predecessor kept; all but the last return the columns of the documents they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capacitron.llm import decontaminate as _decontaminate
from capacitron.llm import jaccard_join as _jaccard_join
from capacitron.llm import piece_codec as _piece_codec
from capacitron.llm import quality as _quality
from capacitron.llm import suffix_dedup as _suffix_dedup
from capacitron.llm.shared import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; null and empty texts do not."""
    return _quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the smallest id; null ids all stay."""
    return _jaccard_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 200-byte strings that occur again; those with nothing
    left are dropped."""
    return _suffix_dedup.without_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of the benchmark."""
    return _decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def token_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_pieces, ids, restored`` of every document: its pieces, and whether the
    text decoded from them is the document's; a null text has no pieces."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "source", "text", F.xxhash64(text).alias("_hash"))
    pieces = _piece_codec.encode_documents(rows, model, ["doc_id", "source", "_hash"])
    both = _piece_codec.decode_documents(pieces, model, ["doc_id", "source", "_hash", "ids"])
    return both.select("doc_id", "source", F.size("ids").cast("long").alias("n_pieces"), "ids",
                       (F.xxhash64("text") == F.col("_hash")).alias("restored"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("token_pieces", token_pieces),
]

#: Shingle graphs, suffix arrays and piece encodings have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
