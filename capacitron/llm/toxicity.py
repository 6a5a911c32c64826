"""Toxicity by compression distance.

Two zstandard dictionaries are built from labelled text: one trained on ordinary documents, and
one that holds the same content followed by the words that toxic documents over-use.  A text is
cut into windows (words, or pieces of very long words); each window is compressed with both
dictionaries inside a fixed frame that both know, so the difference of the two lengths is what
the toxic dictionary saves on that window.  Counts of windows whose saving reaches calibrated
thresholds are turned into a probability by a logistic model.

Fitting uses a bounded sample of labelled rows (``fit_rows`` per class, chosen by a hash of the
id, and ``fit_bytes`` of text per class); scoring covers every window of every text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_ROWS, FIT_BYTES = 3000, 16 << 20
WINDOW = 64
DICT_BYTES = 24 << 10
THRESHOLDS = (1, 2, 3, 4, 6)
#: Over-use (standard errors) a word needs to enter the toxic dictionary; the calibration
#: documents choose among these.
OVER_USE = (4.0, 5.0, 6.5, 8.0, 10.0, 13.0)
MEMO = 400_000


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: list[float]
    mean: list[float]
    scale: list[float]

    def score(self, features: np.ndarray) -> np.ndarray:
        x = (features - np.array(self.mean)) / np.array(self.scale)
        z = self.weights[0] + x @ np.array(self.weights[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def windows(text: str) -> list[bytes]:
    words = text.encode("utf-8", "replace").lower().split()
    if all(len(w) <= WINDOW for w in words):
        return words
    return [w[i:i + WINDOW] for w in words for i in range(0, len(w), WINDOW)]


class Saver:
    """Bytes the toxic dictionary saves on a window."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard as z
        how = z.ZstdCompressionParameters(window_log=17, hash_log=17, chain_log=17, search_log=4, min_match=4,
                                          strategy=z.STRATEGY_GREEDY, write_checksum=False,
                                          write_content_size=False, write_dict_id=False)

        def packer(content):
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            return z.ZstdCompressor(dict_data=d, compression_params=how).compress

        self.head, self.tail = ordinary[-96:-64] + b" ", b" " + ordinary[-160:-128]
        self.a, self.b = packer(ordinary), packer(toxic)
        self.memo: dict[bytes, int] = {}

    def __call__(self, window: bytes) -> int:
        g = self.memo.get(window)
        if g is None:
            framed = self.head + window + self.tail
            g = self.memo[window] = len(self.a(framed)) - len(self.b(framed))
        return g

    def features(self, text: str) -> np.ndarray:
        if len(self.memo) > MEMO:
            self.memo = {}
        gains = np.array([self(w) for w in windows(text)] or [0])
        n = len(gains)
        over = np.array([(gains >= t).sum() for t in THRESHOLDS], float)
        return np.concatenate((np.log1p(over), np.sqrt(over / n), [max(0, gains.max())]))


def _units(text: str) -> set[bytes]:
    """Words and beginnings of words: what the toxic dictionary may hold."""
    words = set(windows(text))
    return words.union(*({w[:k] for w in words if len(w) > k} for k in (4, 5, 6, 7)))


def _train_content(samples: list[bytes]) -> bytes:
    """Content of a trained dictionary; too few samples are used as they are."""
    import zstandard as z
    try:
        content = z.train_dictionary(DICT_BYTES, samples).as_bytes()
    except z.ZstdError:
        content = b" ".join(samples)[-DICT_BYTES:]
    return content.rjust(256, b" ")


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x1 = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x1.shape[1]), np.r_[1e-3, np.full(x.shape[1], ridge)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(penalty), x1.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: list[tuple[str, int]]) -> Model:
    """Dictionaries from two thirds of the rows, thresholds and weights from the rest.

    Rows are taken in the given order; equal texts count once.  Without both classes the
    score is the share of toxic rows (0 without rows)."""
    rows = list(dict.fromkeys((t, y) for t, y in rows))
    share = sum(y for _, y in rows) / len(rows) if rows else 0.0
    n = 2 * len(THRESHOLDS) + 1
    flat = Model(b" " * 256, b" " * 256, [math.log((share + 1e-9) / (1 - share + 1e-9))] + [0.0] * n, [0.0] * n, [1.0] * n)
    sides = {y: [t for t, v in rows if v == y] for y in (0, 1)}
    learn = {y: s[:max(1, 2 * len(s) // 3)] for y, s in sides.items()}
    check = [(t, y) for y, s in sides.items() for t in s[max(1, 2 * len(s) // 3):]]
    if not (sides[0] and sides[1]) or len({y for _, y in check}) < 2:
        return flat
    n1, n0 = len(learn[1]), len(learn[0])
    in_toxic = Counter(w for t in learn[1] for w in _units(t))
    in_toxic = {w: c for w, c in in_toxic.items() if c > 2 and len(w) > 3}
    in_plain = Counter(w for t in learn[0] for w in _units(t) if w in in_toxic)

    def over_use(w):
        p = (in_toxic[w] + in_plain[w]) / (n1 + n0)
        return (in_toxic[w] - n1 * p) / math.sqrt(n1 * p * (1 - p) * n0 / (n1 + n0) + 1e-9)

    # a beginning that one longer unit nearly always completes adds only chance matches
    longer = {w[:k] for w, c in in_toxic.items() for k in range(4, len(w)) if c >= 0.7 * in_toxic.get(w[:k], c + 1)}
    ranked = sorted((over_use(w), w) for w in in_toxic if w not in longer)
    plain = [t.encode("utf-8", "replace").lower() for t in learn[0]]
    ordinary = _train_content([t[i:i + 2 * WINDOW] for t in plain for i in range(0, len(t), 2 * WINDOW)])
    y = np.array([v for _, v in check], float)
    best, tried = None, set()
    for least in OVER_USE:
        extra = b" ".join(w for z, w in ranked if z >= least)[-DICT_BYTES:]
        if extra in tried or not extra:
            continue
        tried.add(extra)
        # the trained content stays last in both, so that equal matches cost equal offsets
        saver = Saver(ordinary, b" " + extra + b" " + ordinary)
        x = np.array([saver.features(t) for t, _ in check])
        mean, scale = x.mean(0), x.std(0) + 1e-6
        half = np.arange(len(y)) % 2 == 0
        loss = 0.0                                              # two-fold log loss
        for a, b in ((half, ~half), (~half, half)):
            if len(set(y[a])) == 2:
                w = _logistic((x[a] - mean) / scale, y[a])
                p = 1 / (1 + np.exp(-np.clip(w[0] + (x[b] - mean) / scale @ w[1:], -30, 30)))
                loss -= (np.log(p + 1e-9) * y[b] + np.log(1 - p + 1e-9) * (1 - y[b])).sum()
            else:
                loss += len(y)
        if best is None or loss < best[0]:
            w = _logistic((x - mean) / scale, y)
            best = loss, Model(ordinary, b" " + extra + b" " + ordinary, w.tolist(), mean.tolist(), scale.tolist())
    return best[1] if best else flat


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES):
    """At most about ``fit_rows`` rows and ``fit_bytes`` of text per class, in hash order.

    Rows whose ``crc32(doc_id as text) % 5`` is 0 are held out; null labels, ids and texts are
    left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")) \
        .where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")) \
        .withColumn("_h", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)))
    counts = dict(known.groupBy("toxic").count().toLocalIterator())
    out = []
    for y in (0, 1):
        upto = math.ceil(1_000_003 * min(1.0, fit_rows / max(1, counts.get(y, 0))))
        chosen = known.where((F.col("toxic") == y) & (F.col("_h") < upto))
        size = 0
        got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
            .where("text IS NOT NULL").join(chosen, "doc_id").orderBy("_h", "doc_id", "text").select("text")
        for r in got.toLocalIterator():
            if size + len(r[0]) <= fit_bytes:                  # a row beyond the bound is skipped, later ones may fit
                size += len(r[0])
                out.append((r[0], y))
    return out


def _scorer(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*held.value)
        saver = None
        for batch in batches:
            saver = saver or Saver(model.ordinary, model.toxic)
            texts = batch.column("text").to_pylist()
            x = np.array([saver.features(t or "") for t in texts]).reshape(len(texts), 2 * len(THRESHOLDS) + 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x), pa.float64())],
                                             names=["doc_id", "score"])
    return run


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row.

    Only the text enters the score.  Null and empty texts have one window without saving;
    repeated rows get equal scores; an empty table gives an empty result; other columns are
    ignored.  Long texts are scored whole, window by window."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(astuple(model))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_scorer(held), "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
