"""Small hostile tables: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names the operators use inside; a table may carry them as its own columns.
CLASHES = ["key", "node", "n", "a", "b", "_t", "_row", "_w", "_h", "path", "part", "counts", "ids",
           "spans", "text_hash", "score", "hit", "place", "row_number", "size", "payload", "sha", "uri"]


def words(rng, n):
    syllables = ["an", "the", "ra", "to", "mi", "el", "und", "que", "so", "lur"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


def rows(seed=1):
    rng = random.Random(seed)
    passage, benchmark = words(rng, 60), words(rng, 25)
    base = words(rng, 300)
    out = [None, "", "   \n\t ", "one", "one two three four", "ONE two Three four", "é ñ ü 日本語 😀 \x00 z"]
    out += [words(rng, rng.randint(1, 120)) for _ in range(12)]
    out += [f"{words(rng, 40)} {passage} {words(rng, 30)}" for _ in range(6)]
    out += [base, base, base.upper(), base + " tail", base.replace("the", "THE"), "x " + base]
    for k in range(8):                                    # a chain of near copies
        w = base.split()
        for i in range(k):
            w[i * 7] = f"edit{i}"
        out.append(" ".join(w))
    out += [f"{words(rng, 20)}\n{benchmark.upper()}\n{words(rng, 9)}", words(rng, 9000), "ab" * 700, "word " * 200]
    out += ["line one here\n" * 6 + words(rng, 60), "*** ### $$$ %% " * 30, "a|b|c\n\n\nx y z x y z x y z"]
    docs = [(10 * i, t, "en", f"src{i % 3}", len(t) if t is not None else None) for i, t in enumerate(out)]
    docs += [docs[20], docs[20], (5, docs[21][1], None, None, 3)]      # repeated rows, one text under two ids
    return docs, [(1, benchmark), (2, "short item here"), (3, ""), (4, None), (5, benchmark), (6, words(rng, 40))]


def frame(spark, docs=None, clash=False, schema=SCHEMA):
    df = spark.createDataFrame(rows()[0] if docs is None else docs, schema).repartition(3)
    if clash:
        df = df.select("*", *[F.lit("other").alias(c) for c in CLASHES])
    return df
