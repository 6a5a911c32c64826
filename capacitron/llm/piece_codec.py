"""SentencePiece encoding by a shared-prefix forward pass over a trie of words, and decoding.

Texts are cut into marked words (the space mark and what follows).  The distinct words of a
batch are sorted, which lays their trie out depth-first: consecutive words share their longest
common prefix, and the forward states of that prefix are kept on a stack and reused, so each
trie node is computed once however many words pass through it.

The forward state of a prefix is its last piece and where that piece starts, with the summed
piece score.  For a BPE model the predecessor is not the one of the best sum: a segmentation is
the model's own exactly when every piece and every pair of neighbours would be left as it is by
the merges.  Exactly one predecessor of a prefix fulfils this, so the pass needs no search
beyond the pieces that end at the prefix.  Pair checks are remembered.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "▁"
_NONE = (-1, -np.inf)
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Pieces(NamedTuple):
    """The content of a model: matchable pieces with id and score, byte pieces, unknown id."""

    pieces: dict[str, tuple[int, float]]
    bytes_: list[int]
    unknown: int
    table: list[bytes]


def load_pieces(path: str) -> Pieces:
    """Read a BPE ``.model`` file with an identity normaliser and a dummy prefix."""
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    if m.normalize("  ﬁ A") != f"{MARK}{MARK}{MARK}ﬁ{MARK}A":
        raise ValueError("only models that keep texts as they are can be encoded")
    pieces, bytes_, table = {}, [-1] * 256, []
    for i in range(m.get_piece_size()):
        p = m.id_to_piece(i)
        if m.is_byte(i):
            bytes_[int(p[3:5], 16)] = i
            table.append(bytes([int(p[3:5], 16)]))
        elif m.is_control(i) or m.is_unknown(i):
            table.append(b"" if m.is_control(i) else " ⁇ ".encode())
        else:
            if MARK in p.lstrip(MARK):
                raise ValueError("pieces that span words cannot be encoded word by word")
            pieces[p] = (i, m.get_score(i))
            table.append(p.replace(MARK, " ").encode())
    return Pieces(pieces, bytes_, m.unk_id(), table)


class WordEncoder:
    """Piece ids of words, one sorted batch of distinct words at a time."""

    def __init__(self, model: Pieces):
        self.model = model
        self.longest = max(map(len, model.pieces), default=1)
        self.whole: dict[str, bool] = {}
        self.pair: dict[tuple[str, str], bool] = {}
        self.visited = 0

    def merged(self, text: str) -> list[str]:
        """The model's merges on a short string: best score first, then leftmost."""
        parts, score = list(text), self.model.pieces
        gain = [score.get(a + b, _NONE)[1] for a, b in zip(parts, parts[1:])]
        while gain:
            best = max(gain)
            if best == -np.inf:
                break
            k = gain.index(best)                                   # leftmost of equal scores
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            del gain[k]
            if k < len(gain):
                gain[k] = score.get(parts[k] + parts[k + 1], _NONE)[1]
            if k:
                gain[k - 1] = score.get(parts[k - 1] + parts[k], _NONE)[1]
        return parts

    def _stays(self, left: str, piece: str) -> bool:
        """Whether the merges leave ``piece``, and ``left`` before it, as they are."""
        ok = self.whole.get(piece)
        if ok is None:
            ok = self.whole[piece] = self.merged(piece) == [piece]
        if len(self.pair) > 1_000_000:
            self.pair.clear()
        ok = self.pair[left, piece] = ok and (not left or self.merged(left + piece) == [left, piece])
        return ok

    def encode(self, words: list[str]) -> dict[str, np.ndarray]:
        """Ids of every distinct word; ``words`` may come in any order."""
        out, pieces, longest, pair, stays = {}, self.model.pieces, self.longest, self.pair, self._stays
        start, last, score, prev = [0], [""], [0.0], ""
        for w in sorted(set(words)):
            k, top = 0, min(len(w), len(prev))
            while k < top and w[k] == prev[k]:
                k += 1
            del start[k + 1:], last[k + 1:], score[k + 1:]         # back to the shared prefix
            for i in range(k + 1, len(w) + 1):
                for j in range(i - longest if i > longest else 0, i):
                    p = w[j:i]
                    if p in pieces:
                        ok = pair.get((last[j], p))
                        if stays(last[j], p) if ok is None else ok:
                            start.append(j)
                            last.append(p)
                            score.append(score[j] + pieces[p][1])
                            break
                else:                                              # a character without a piece
                    start.append(i - 1)
                    last.append(w[i - 1])
                    score.append(score[i - 1])
            self.visited += len(w) - k
            out[w] = self._back(start, last, len(w))
            prev = w
        return out

    def _back(self, start, last, i) -> np.ndarray:
        ids = []
        while i:
            found = self.model.pieces.get(last[i])
            if found is not None:
                ids.append(found[0])
            elif self.model.bytes_[0] >= 0:
                ids.extend(self.model.bytes_[b] for b in reversed(last[i].encode("utf-8", "replace")))
            else:
                ids.append(self.model.unknown)
            i = start[i]
        return np.array(ids[::-1], np.int32)


def marked_words(text: str) -> list[str]:
    """The words of a text with the dummy prefix; an empty text has none."""
    return _WORDS.findall(MARK + text.replace(" ", MARK)) if text else []


def encode_texts(encoder: WordEncoder, texts: list[str]) -> list[np.ndarray]:
    """Ids of whole texts; a word occurring in many texts is encoded once."""
    number: dict[str, int] = {}
    docs = [np.fromiter((number.setdefault(w, len(number)) for w in marked_words(t)), np.int32) for t in texts]
    ids = encoder.encode(list(number))
    raw = [ids[w].tobytes() for w in number]
    return [np.frombuffer(b"".join([raw[k] for k in d.tolist()]), np.int32) for d in docs]


def decode_ids(table: list[bytes], ids) -> str:
    """The text of a sequence of ids: pieces and bytes joined, the dummy prefix removed."""
    text = b"".join([table[k] for k in ids]).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def _slices(texts, limit: int = 24 << 20):
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _encoder(held, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a worker keeps a broadcast value between its tasks, and with it what it remembers
        encoder = held.value.setdefault("encoder", None) or WordEncoder(Pieces(*held.value["pieces"]))
        held.value["encoder"] = encoder
        for batch in batches:
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            for a, b in _slices(texts):
                ids = encode_texts(encoder, texts[a:b])
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))],
                    names=[*keep, "ids"])
    return run


def _hold(spark: SparkSession, model: str):
    return spark.sparkContext.broadcast({"pieces": tuple(load_pieces(model))})  # bounded by the vocabulary


def encode_documents(docs: DataFrame, model: str, keep=("doc_id",)) -> DataFrame:
    """The kept columns and ``ids`` (array<int>) of every whole text.

    Null and empty texts have no ids.  Repeated rows are each answered; an empty table gives an
    empty result; the other columns are ignored.  No shuffle: a batch's distinct words are
    encoded where the batch is read."""
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.mapInArrow(_encoder(_hold(docs.sparkSession, model), list(keep)), f"{schema}, ids array<int>")


def decode_documents(encoded: DataFrame, model: str, keep=("doc_id",)) -> DataFrame:
    """The kept columns (``ids`` may be one) and the ``text`` of every ``ids`` array (null ids: null
    text)."""
    held = _hold(encoded.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Pieces(*held.value["pieces"]).table
        for batch in batches:
            text = [None if x.as_py() is None else decode_ids(table, x.as_py()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(text, pa.string())],
                                             names=[*keep, "text"])

    rows = encoded.select(*dict.fromkeys([*keep, "ids"]))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{schema}, text string")


def _digest(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Pieces(*held.value["pieces"]).table
        for batch in batches:
            n, crc, back = [], [], []
            column = batch.column("ids")
            flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            offsets = offsets - offsets[0]
            for a, b in zip(offsets[:-1], offsets[1:]):
                ids = flat[a:b].astype("<u4")
                n.append(len(ids))
                crc.append(zlib.crc32(ids.tobytes()))
                back.append(zlib.crc32(decode_ids(table, ids.tolist()).encode()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(back, pa.int64())],
                names=["doc_id", "n_pieces", "ids_crc32", "decoded_crc32"])
    return run


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """Per document: pieces, checksum of the ids, and checksum of the text decoded from them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return encode_documents(rows, model).mapInArrow(
        _digest(_hold(docs.sparkSession, model)),
        "doc_id long, n_pieces long, ids_crc32 long, decoded_crc32 long")
