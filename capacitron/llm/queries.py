"""The thin ``opN_<name>`` queries over the operators, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from . import quality as Q
from . import decontaminate, fill_middle, jaccard_join, lz_passages, oracles, piece_codec, sharding, spelling, suffix_dedup
from . import token_files, toxicity, url_filter, warc
from .shared import table

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@register("op1_quality_rules", oracles.quality_sql())
def op1(spark, sf):
    """Quality rules over every whole text of ``documents``."""
    return Q.quality(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


@register("op9_url_filters", oracles.url_sql())
def op9(spark, sf):
    """Verdict of every ``pages`` URL: its rule's, else its aliases'."""
    return url_filter.judge_urls(table(spark, sf, "pages")).select(
        "page_id", "host", "path", "rule", "verdict")


@register("op10_sharding")
def op10(spark, sf):
    """Shard and slot of every document."""
    return sharding.shard_documents(table(spark, sf, "documents")).drop("row_number")


@register("op2_warc")
def op2(spark, sf):
    """Write every page to seekable WARC bundles and read them all back."""
    return warc.read_archives(warc.write_archives(table(spark, sf, "pages"))).drop("url")


@register("op5_decontamination")
def op5(spark, sf):
    """Ten-word windows of the benchmark inside every whole document."""
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@register("op6_token_files")
def op6(spark, sf):
    """Encode all documents to token files and read them back."""
    import public_tokenizers
    manifest = token_files.write_token_files(
        table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return token_files.read_token_files(manifest)


@register("op8_toxicity")
def op8(spark, sf):
    """Toxicity score of every whole document, learnt from the rows that are not held out."""
    docs = table(spark, sf, "documents")
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf, "labels")))
    return toxicity.score_documents(docs, model)


@register("op4_sentencepiece")
def op4(spark, sf):
    """Piece ids of every whole document and the text decoded from them, as checksums."""
    import public_tokenizers
    return piece_codec.piece_digests(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@register("op3_jaccard_join")
def op3(spark, sf):
    """Components of documents whose five-word shingle sets have a similarity of 0.8 or more."""
    return jaccard_join.near_duplicates(table(spark, sf, "documents")).drop("text_hash")


@register("op7_suffix_dedup")
def op7(spark, sf):
    """Repeated 200-byte strings of all documents, removed."""
    return suffix_dedup.removal_digests(table(spark, sf, "documents"))


@register("op11_fill_middle", oracles.fill_middle_sql())
def op11(spark, sf):
    """Fill-in-the-middle form of every whole document, and the text rebuilt from it."""
    return fill_middle.fill_in_middle(table(spark, sf, "documents")).select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


@register("op12_lz_passages")
def op12(spark, sf):
    """Passages of 50 words that documents of smaller ids have too, removed."""
    return lz_passages.remove_passages(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register("op13_spelling")
def op13(spark, sf):
    """Frequent words, the frequent form each is a variant of, and its root."""
    return spelling.spelling_variants(table(spark, sf, "documents"))
