"""Spelling variants by a variable-length gram index.

Two words are near when they differ by one inserted, deleted or replaced code point.

* Gram dictionary.  For the words of one length, every piece that begins at a place is counted
  with its length (2 code points to ``GRAM``, half a word at most).  A piece met in more than ``LIST`` words is
  frequent and pruned: it is extended by the next code point.  So the grams of a place are the
  shortest infrequent pieces, or the longest allowed, and no gram begins another.
* Decomposition.  A word's gram at a place is found by walking the counts of its own pieces.  It
  depends on the code points it covers and on nothing else, so one edit changes no gram that
  does not cover it.
* Affected-gram bound.  The most grams of a word that cover one place is the most that one edit
  can affect.  A near word has all others, at the same place or one further, so among any
  (bound + 1) grams of a word at least one is in every near word.  The shortest lists are taken:
  a word is indexed under its (bound + 1) rarest grams only.  Because no gram is longer than half
  a word, the first and a last gram never cover one place, so every word has that many grams.
* List merging and verification.  Words look up the lists of their own length, and those of one
  code point less in both alignments; a pair found in any list is verified once.

Lists are told by 64-bit hashes of length, place and gram; a clash costs a verification only.

All joins are sorted on both sides (``_met``): Spark takes an exploded table to be as small as the
one it is made of, and a compressed file as small in memory, and would send either one whole to
the driver and to every executor.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

RUN = "[a-zÀ-ÿ]+"
#: A gram in more words of a length and place is extended.
LIST = 12
#: Code points of the longest gram (half a word in words that are shorter than two of these).
GRAM = 8
#: Distinct words a task counts before it hands the counts on.
HELD = 400_000


# --- words --------------------------------------------------------------------------------------

def _counts(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    """Counted words of a task.  A run whose number with its document divides by ``every`` loses
    one code point (0: none does)."""
    runs, total = re.compile(RUN).findall, Counter()

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                          names=["word", "n"])

    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            if not text.is_valid:
                continue
            found = Counter(runs(text.as_buffer().to_pybytes().lower().decode("utf-8", "replace")))
            if every:
                start = zlib.crc32(b"%d:" % doc if doc is not None else b":")
                hit = [(w, h, found.pop(w)) for w in list(found) if not (h := zlib.crc32(w.encode(), start)) % every]
                for word, h, n in hit:
                    found[word[:h % len(word)] + word[h % len(word) + 1:]] += n
            total.update(found)
            if len(total) > HELD:
                yield flush()
                total.clear()
    yield flush()


def vocabulary(docs: DataFrame, least_length: int = 6, least_count: int = 5, noise: int = 199) -> DataFrame:
    """``word, n``: runs of letters (A-Z lower-cased), with their number over all texts.

    With ``noise`` each run loses a code point where that number divides the CRC-32 of
    ``<doc_id>:<run>``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(lambda b: _counts(b, noise), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") >= least_count) & (F.char_length("word") >= least_length))


# --- grams --------------------------------------------------------------------------------------

def _met(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join of tables that grow with the vocabulary: sorted, whatever Spark takes their sizes to be."""
    return left.join(right.hint("merge"), on, how)


def _longest(length):
    """Code points of the longest gram in words of a length."""
    return F.least(F.lit(GRAM), F.greatest(F.lit(1), (length / 2).cast("int")))


def _pieces(words: DataFrame, length, place, start) -> DataFrame:
    """A row per piece from ``start`` on, under the list of that length and place (both from 0)."""
    least = F.least(F.lit(2), _longest(length))
    sizes = words.withColumn("size", F.explode(F.sequence(least, _longest(length))))
    sizes = sizes.where(place + F.col("size") <= length)
    return sizes.withColumn("piece", F.xxhash64(length, place, F.substring("word", start + 1, F.col("size"))))


def _index(words: DataFrame) -> DataFrame:
    """``piece, word, length``: each word under its (bound + 1) rarest grams."""
    long_ = F.col("length")
    least = F.least(F.lit(2), _longest(long_))
    each = words.withColumn("place", F.explode(F.sequence(F.lit(0), long_ - least)))
    pieces = _pieces(each, long_, F.col("place"), F.col("place")).select("word", "length", "place", "size", "piece")
    counts = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("times"))
    known = _met(pieces, counts, "piece")
    # the shortest infrequent piece of a place, or the longest: every piece before it is frequent
    gram = F.coalesce(F.min(F.when(F.col("times") <= LIST, F.struct("size", "times", "piece"))),
                      F.max(F.struct("size", "times", "piece")))
    grams = known.groupBy("word", "length", "place").agg(gram.alias("g"))
    of_word = grams.groupBy("word", "length").agg(F.sort_array(F.collect_list(F.struct(
        "place", F.col("g.size").alias("size"), F.col("g.times").alias("times"), F.col("g.piece").alias("piece")))).alias("g"))
    # every place has one gram, so those over a code point are among the last few that begin before it
    over = F.transform(F.sequence(F.lit(0), F.size("g") - 1), lambda p: F.size(F.filter(
        F.sequence(F.lit(0), F.least(p, F.lit(GRAM - 1))), lambda k: F.col("g.size")[p - k] > k)))
    rare = F.sort_array(F.transform("g", lambda g: F.struct(g.times.alias("times"), g.place.alias("place"), g.piece.alias("piece"))))
    return of_word.select("word", "length", F.explode(F.slice(rare, F.lit(1), F.array_max(over) + 1)).alias("g")) \
        .select(F.col("g.piece").alias("piece"), F.col("word").alias("other"), F.col("length").alias("other_length"))


def near_words(words: DataFrame) -> DataFrame:
    """``word, other``: all pairs of words, in both directions, that differ by one inserted,
    deleted or replaced code point.  ``words`` has distinct values in ``word``; nulls and words of
    fewer than two code points are not compared."""
    words = words.select("word", F.char_length("word").alias("length")).where("length > 1")
    index = written(_index(words), "gram-index")
    at, length = F.col("at"), F.col("length")
    places = words.withColumn("at", F.explode(F.sequence(F.lit(0), length - 1)))
    equal = _pieces(places, length, at, at)                    # a replaced code point
    shorter = places.withColumn("short", length - 1).where("short > 1")
    before = _pieces(shorter, F.col("short"), at, at)          # in front of an inserted one
    behind = _pieces(shorter.where("at > 0"), F.col("short"), at - 1, at)
    probes = equal.select("piece", "word").union(before.select("piece", "word")).union(behind.select("piece", "word"))
    pairs = _met(probes, index, "piece").where("word <> other").select("word", "other").distinct()
    near = pairs.where(F.levenshtein("word", "other", 1) == 1)
    return near.union(near.select("other", "word")).distinct()


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of a table of distinct ``word`` with number ``n``.

    A word's form is its near word of largest n (the smallest of equals), if that n is ``ratio``
    times its own or more.  Its root is where following forms ends, the word itself without any.
    Numbers grow along forms, so there are no circles and few steps; each step is a join."""
    words = written(words.select("word", "n"), "words")
    near = _met(near_words(words), words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("b"))
    found = _met(words, best, "word", "left").withColumn("_ok", -F.col("b.m") >= ratio * F.col("n"))
    found = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                 F.when(F.col("_ok"), F.col("b.other")).alias("form"),
                                 F.when(F.col("_ok"), -F.col("b.m")).alias("form_n")), "forms")
    step = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:                                                # each round doubles the steps followed
        on = step.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = written(_met(step, on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"),
                                                             F.col("_next").isNotNull().alias("moved")), "roots")
        step = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    return _met(found, step, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, noise: int = 199, ratio: int = 5) -> DataFrame:
    """:func:`variants` of the :func:`vocabulary` of ``docs``.

    Null and empty texts have no words; a null id counts as an empty string in the number that
    decides on a deletion.  Repeated rows are counted as often as they stand.  Texts of any length
    count as a whole, and words of any length are indexed.  An empty table, or one without a word
    frequent enough, gives an empty result; other columns are ignored."""
    return variants(vocabulary(docs, least_length, least_count, noise), ratio)
