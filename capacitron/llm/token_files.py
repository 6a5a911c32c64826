"""Token files: frequency-ranked ids in byte-aligned variable-length coding.

A file holds the ids of a run of documents.  Its ids are replaced by their rank in the file's
own frequency order, each rank takes one to four bytes, and the two-bit lengths stand apart
from the data in control bytes (four values each).  A reader looks every control byte up in
tables of lengths and offsets, so numpy decodes a whole file without a loop over its values.

Layout (little-endian)::

    8s   magic            Q tokens      Q documents    Q symbols    Q data bytes
    u32  id of each rank (symbols)
    u8   1 for a document with an id, i64 document id, u64 tokens   (documents each)
    u64  data offset of every BLOCK-th control byte
    u8   control bytes, u8 data bytes

Texts are split once by document id range; a task writes its range as files of about
``FILE_TOKENS`` ids and reports them.  The reported rows are the manifest: files of failed or
repeated attempts are never listed.  Files and documents are in ascending order of id.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import file_system, shared_folder, written

MAGIC = b"TIDRANK1"
HEAD = "<8sQQQQ"
BLOCK = 4096
FILE_TOKENS = 2_000_000
#: Distinct pieces a task remembers the ids of; beyond that it starts afresh.
CACHE_PIECES = 600_000

#: Ranges of characters whose classes do not depend on the Unicode version in use.
SETTLED = (("\x00", "\u0530"), ("\u2010", "\u2027"), ("\u3041", "\u3096"), ("\u4e00", "\u9fa5"))

MANIFEST = "part int, seq int, path string, n_tokens long, n_docs long, n_bytes long"


# --- encoding -------------------------------------------------------------------------------

def _ranges(test) -> str:
    """The settled characters that pass a test, as the inside of a character class."""
    out, first, last = [], None, None
    for low, high in SETTLED:
        for c in range(ord(low), ord(high) + 2):
            if c <= ord(high) and test(chr(c)):
                first, last = (c if first is None else first), c
            elif first is not None:
                out.append(f"\\u{first:04x}-\\u{last:04x}")
                first = None
    return "".join(out)


def settled_pattern(pattern: str) -> str:
    r"""``pattern`` for Python's ``re``: ``\p{L}``, ``\p{N}`` and ``\s`` spelt out as ranges."""
    kind = unicodedata.category
    space = "\\t-\\r \\x85\\xa0"
    letter, number = _ranges(lambda c: kind(c)[0] == "L"), _ranges(lambda c: kind(c)[0] == "N")
    return (pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]")
            .replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]")
            .replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]"))


class Encoder:
    """Ids of texts by a byte-level BPE file of the ``tokenizers`` library.

    The library's pre-tokenizer cuts a text into pieces and encodes each by itself.  Here the
    same pattern cuts the text, distinct pieces go through the library once, and their ids are
    remembered.  Texts with characters outside the settled ranges go to the library whole.
    """

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # the task's core is all it may use
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.cut = re.compile(settled_pattern(pattern)).findall
        self.unsettled = re.compile("[^" + "".join(f"{a}-{b}" for a, b in SETTLED) + "]").search
        vocab = self.library.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)  # ids whose bytes begin with a space
        self.opens[[k for t, k in vocab.items() if t[0] == "\u0120"]] = True
        self.known: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> None:
        """Remember the ids of new pieces.  Pieces of a space and letters are encoded many in one
        text: the library cuts it at the spaces again, and an id that opens with a space begins
        the next piece."""
        words = [p for p in pieces if p[0] == " " and p[1:].isalpha()]
        for k in range(0, len(words), 8192):
            some = words[k:k + 8192]
            raw = self._ids(["".join(some)])[0]
            at = (4 * np.flatnonzero(self.opens[np.frombuffer(raw, "<u4")])).tolist()
            if len(at) == len(some):                           # else it cuts in another way: one by one below
                self.known.update(zip(some, [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)])]))
        rest = [p for p in pieces if p not in self.known]
        self.known.update(zip(rest, self._ids(rest)))

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes()
                for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > CACHE_PIECES:
            self.known = {}
        cuts = [None if self.unsettled(t) else self.cut(t) for t in texts]
        fresh = list(set().union(*filter(None, cuts)).difference(self.known))
        self._learn(fresh)
        whole = iter(self._ids([t for t, c in zip(texts, cuts) if c is None]))
        get = self.known.__getitem__
        return [np.frombuffer(next(whole) if c is None else b"".join(map(get, c)), "<u4") for c in cuts]


# --- the format -----------------------------------------------------------------------------

def pack(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One file of the ids of documents that follow one another."""
    freq = np.bincount(ids)                                  # as long as the vocabulary at most
    symbols = np.flatnonzero(freq)
    symbols = symbols[np.argsort(-freq[symbols], kind="stable")]
    rank_of = np.zeros(len(freq), np.uint32)
    rank_of[symbols] = np.arange(len(symbols), dtype=np.uint32)
    rank = rank_of[ids]
    size = (1 + (rank > 0xFF) + (rank > 0xFFFF) + (rank > 0xFFFFFF)).astype(np.uint8)
    two = np.zeros(-(-len(rank) // 4) * 4, np.uint8)
    two[:len(rank)] = size - 1
    two = two.reshape(-1, 4)
    control = two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6
    data = rank.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    lengths = np.zeros(len(control) * 4, np.int64)
    lengths[:len(size)] = size
    starts = np.concatenate(([0], np.cumsum(lengths.reshape(-1, 4).sum(1))))[:-1][::BLOCK]
    here = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return b"".join([
        struct.pack(HEAD, MAGIC, len(ids), len(doc_ids), len(symbols), len(data)),
        symbols.astype("<u4").tobytes(), here.tobytes(), numbers.tobytes(),
        np.asarray(counts, "<u8").tobytes(), starts.astype("<u8").tobytes(),
        control.tobytes(), data.tobytes()])


#: Bytes of the four values of every control byte, their offsets, and the masks of 1..4 bytes.
_SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
_OFFSETS = np.cumsum(_SIZES, axis=1) - _SIZES
_TOTALS = _SIZES.sum(1)
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def unpack(blob: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, token counts and ids of a file made by :func:`pack`."""
    magic, n, docs, symbols, size = struct.unpack_from(HEAD, blob)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = struct.calcsize(HEAD)

    def take(kind, k):
        nonlocal at
        out = np.frombuffer(blob, kind, k, at)
        at += out.nbytes
        return out

    table, here, numbers, counts = take("<u4", symbols), take("u1", docs), take("<i8", docs), take("<u8", docs)
    groups = -(-n // 4)
    take("<u8", -(-groups // BLOCK))
    control, data = take("u1", groups), take("u1", size)
    data = np.concatenate((data, np.zeros(4, np.uint8)))
    total = _TOTALS[control]
    # the last control byte counts absent values as one byte each; starts are unaffected
    start = np.cumsum(total) - total
    ids = np.empty(groups * 4, np.uint32)
    for a in range(0, groups, 1 << 18):                      # bounded scratch space
        c = control[a:a + (1 << 18)]
        pos = np.minimum((start[a:a + (1 << 18), None] + _OFFSETS[c]).reshape(-1), size)
        word = data[pos].astype(np.uint32)
        for k in (1, 2, 3):
            word |= data[np.minimum(pos + k, size)].astype(np.uint32) << np.uint32(8 * k)
        ids[4 * a:4 * a + len(word)] = word & _MASKS[_SIZES[c].reshape(-1)]
    ids = table[ids[:n]] if n else np.zeros(0, np.uint32)
    return [int(x) if h else None for x, h in zip(numbers, here)], counts.astype(np.int64), ids


# --- Spark ----------------------------------------------------------------------------------

def _writer(folder: str, held, path: str, pattern: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, names, chunks, size = TaskContext.get().partitionId(), 0, [], [], 0
        fs, root = file_system(folder)
        end = np.array([end_id], np.uint32)

        def flush():
            nonlocal seq, names, chunks, size
            counts = np.array([len(c) for c in chunks], np.int64)
            blob = pack(names, counts, np.concatenate(chunks))
            name = f"{root}/{part:06d}-{seq:04d}-{uuid.uuid4().hex}.tid"
            with fs.open_output_stream(name, compression=None) as f:
                f.write(blob)
            row = pa.RecordBatch.from_pylist([dict(part=part, seq=seq, path=name, n_tokens=size,
                                                   n_docs=len(names), n_bytes=len(blob))], schema=_manifest())
            seq, names, chunks, size = seq + 1, [], [], 0
            return row

        for batch in batches:
            # a worker keeps a broadcast value between its tasks, and with it the known pieces
            encoder = held.value.get("encoder") or Encoder(path, pattern)
            held.value["encoder"] = encoder
            for a in range(0, batch.num_rows, 256):
                rows = batch.slice(a, 256)
                for doc, ids in zip(rows.column("doc_id").to_pylist(),
                                    encoder.encode(rows.column("text").to_pylist())):
                    names.append(doc)
                    chunks.append(np.concatenate((ids, end)))
                    size += len(ids) + 1
                    if size >= FILE_TOKENS:
                        yield flush()
        if names:
            yield flush()
    return run


def _manifest() -> pa.Schema:
    return pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()),
                      ("n_tokens", pa.int64()), ("n_docs", pa.int64()), ("n_bytes", pa.int64())])


def write_token_files(docs: DataFrame, tokenizer: str, pattern: str, end_id: int = 0,
                      folder: str | None = None) -> DataFrame:
    """Encode every text, append ``end_id``, write the files; returns the manifest.

    ``tokenizer`` is the path of a ``tokenizers`` file present on every executor and
    ``pattern`` its pre-tokenizer's pattern.  Null texts count as empty (one id, the end).
    Documents are ordered by (doc_id, text hash), null ids first; repeated rows follow each
    other; an empty table writes no file.  Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # whole ids stay in one range, so the order of repeated ids is settled inside a task
    ranged = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return written(ranged.mapInArrow(_writer(folder, spark.sparkContext.broadcast({}), tokenizer, pattern, end_id), MANIFEST), "manifest") \
        .withColumn("uri", F.lit(folder))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            fs, _ = file_system(row["uri"])
            with fs.open_input_stream(row["path"], compression=None) as f:
                names, counts, ids = unpack(f.read())
            ends = np.cumsum(counts)
            raw = ids.astype("<u4")
            yield pa.RecordBatch.from_arrays([
                pa.array(names, pa.int64()), pa.array(ends - counts + row["start"], pa.int64()),
                pa.array(counts, pa.int64()),
                pa.array([zlib.crc32(raw[e - c:e].tobytes()) for c, e in zip(counts, ends)], pa.int64()),
            ], names=["doc_id", "start", "n_tokens", "ids_crc32"])


#: Bytes of files that one task decodes, or fewer where the cluster has cores to spare.
TASK_BYTES = 32 << 20


def _tasks(manifest: DataFrame) -> int:
    """Tasks to decode the files: the rows that are shuffled are paths only, so their number
    follows the bytes behind them (AQE leaves a given number alone)."""
    files, size = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    return max(1, min(files, max(-(-size // TASK_BYTES), 4 * manifest.sparkSession.sparkContext.defaultParallelism)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files.

    ``start`` counts the ids of all documents before it.  The running sum is over one row per
    file; each file is decoded by one task and holds a bounded number of ids.
    """
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    spread = files.select("path", "uri", "start").repartition(_tasks(manifest), "path")
    return spread.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")
