"""Quality rules: a threshold table compiled into one projection, without user functions.

All measures are built-in expressions over a document's own words and lines, so the operator
is a single map stage: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE_CLASS, text_or_empty

#: Frequent function words of English, German, French and Spanish (fixed values).
STOP_WORDS = ("the be to of and that with in is it for was on as are by at this "
              "der die das und ist mit den von zu ein eine nicht auf "
              "le la les de des et un une que est pour dans en qui pas par sur "
              "el los las y no del se por su para con al").split()


@dataclass(frozen=True)
class Rule:
    """A document fails when ``measure`` lies outside [low, high]; None leaves a side open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The base of the contract; a document that fails one of these is never kept.
BASE = (
    Rule("too_few_words", "n_words", low=50),
    Rule("repeated_words", "repeat_word_pct", high=50),
)

#: The verdict's own table.
TABLE = (
    Rule("mean_word_length", "mean_word_length", low=2, high=15),
    Rule("symbols_per_word", "symbol_word_ratio", high=0.25),
    Rule("stop_words", "stop_word_ratio", low=0.01),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
)


def _ratio(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))


#: Derived measures the tables may name, besides the counted columns themselves.
MEASURES = {
    "mean_word_length": lambda: _ratio("word_chars", "n_words"),
    "symbol_word_ratio": lambda: _ratio("n_symbols", "n_words"),
    "stop_word_ratio": lambda: _ratio("n_stop_words", "n_words"),
    "dup_line_ratio": lambda: _ratio("n_dup_lines", "n_lines"),
    "repeat_word_pct": lambda: _ratio("n_repeat_words", "n_words") * 100,
}


def _fails(rule: Rule) -> Column:
    m = MEASURES[rule.measure]() if rule.measure in MEASURES else F.col(rule.measure)
    bad = F.lit(False)
    if rule.low is not None:
        bad = bad | (m < rule.low)
    if rule.high is not None:
        bad = bad | (m > rule.high)
    return bad


def _repeated_words(words: str) -> Column:
    """Words inside three-word windows that occur at least twice in the text.

    Window numbers and 33 bits of each window's hash share one long, so a primitive sort
    brings windows of equal hash together; the few that have an equal neighbour are then
    compared by their words, which makes the count exact.
    """
    return F.expr(f"""
      CASE WHEN size({words}) < 4 THEN 0L ELSE
        aggregate(array(transform(sequence(0, size({words}) - 3), i ->
            (xxhash64({words}[i], {words}[i + 1], {words}[i + 2]) & -2147483648) | CAST(i AS BIGINT))),
          0L, (a0, keys) -> aggregate(array(sort_array(keys)), 0L, (a1, k) ->
            aggregate(array(
              transform(filter(sequence(0, size(k) - 1), j ->
                  (j > 0 AND (k[j] & -2147483648) = (k[greatest(j - 1, 0)] & -2147483648))
                  OR (j < size(k) - 1 AND (k[j] & -2147483648) = (k[least(j + 1, size(k) - 1)] & -2147483648))),
                j -> CAST(k[j] & 2147483647 AS INT))), 0L, (a2, near) ->
              CASE WHEN size(near) = 0 THEN 0L ELSE
                aggregate(array(array_sort(transform(near, i -> struct(
                    concat({words}[i], ' ', {words}[i + 1], ' ', {words}[i + 2]) AS w, i AS i)))),
                  0L, (a3, s) -> CAST(size(array_distinct(flatten(transform(
                    filter(sequence(0, size(s) - 1), j ->
                        (j > 0 AND s[j].w = s[greatest(j - 1, 0)].w)
                        OR (j < size(s) - 1 AND s[j].w = s[least(j + 1, size(s) - 1)].w)),
                    j -> array(s[j].i, s[j].i + 1, s[j].i + 2))))) AS BIGINT))
              END)))
      END""")


def _measured(rows: DataFrame, *keep: str) -> DataFrame:
    """The counted columns of column ``_t``, beside the columns to keep."""
    w = rows.withColumn("_w", F.filter(F.split("_t", SPACE_CLASS + "+"), lambda x: x != ""))
    w = w.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: F.rlike(x, F.lit("[^ \\t-\\r]"))))
    stops = list(dict.fromkeys(STOP_WORDS + [s.capitalize() for s in STOP_WORDS]))
    return w.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("_t", SPACE_CLASS + "+", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeated_words("_w").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.filter("_w", lambda x: x.isin(stops))).cast("long").alias("n_stop_words"))


def _any(columns) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


def quality(docs: DataFrame, table=TABLE, base=BASE) -> DataFrame:
    """Measures, ``base_failed``, ``kept`` and the names of the failed rules.

    Null and empty texts have no words and fail the base.  Long texts are measured whole;
    repeated rows are each judged; an empty table gives an empty result; other columns of
    ``docs`` are ignored.
    """
    m = _measured(docs.select("doc_id", text_or_empty().alias("_t")), "doc_id")
    failed = F.filter(F.array(*[F.when(_fails(r), F.lit(r.name)) for r in (*base, *table)]),
                      lambda x: x.isNotNull())
    return m.select("*", _any(_fails(r) for r in base).alias("base_failed"),
                    (~_any(_fails(r) for r in (*base, *table))).alias("kept"),
                    failed.alias("failed_rules"))


def kept_documents(docs: DataFrame, table=TABLE, base=BASE) -> DataFrame:
    """The rows of ``docs`` that pass every rule, with their own columns, in one map stage.

    The verdict feeds an ``explode`` of zero or one rows: a plain filter would be pushed below
    the projection and make Spark compute the measures twice.
    """
    m = _measured(docs.select(F.struct(*docs.columns).alias("_row"), text_or_empty().alias("_t")), "_row")
    passed = ~_any(_fails(r) for r in (*base, *table))
    return m.select(F.explode(F.when(passed, F.array("_row"))).alias("_row")).select("_row.*")
