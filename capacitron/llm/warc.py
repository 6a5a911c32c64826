"""WARC archives as seekable Zstandard bundles.

A bundle is a sequence of independent Zstandard frames, each holding whole WARC records, and a
footer seek table (a skippable frame in the public seekable format).  Writing reports an index
row per record: its id, bundle, frame and the offset inside the uncompressed frame.  One record
is read by its frame alone; whole bundles are read frame by frame.

Records of equal payloads of at least ``min_bytes`` are stored once: the smallest page id keeps
the response, the others become revisit records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import file_system, shared_folder, written

#: Magic numbers of the public skippable-frame and seek-table formats (fixed values).
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 32 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = ("page_id long, record_id string, record_type string, part int, path string, "
         "frame long, offset long, length long")
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


# --- records --------------------------------------------------------------------------------

def _record_id(page, digest: str) -> str:
    return f"<urn:page:{'' if page is None else page}:{digest}>"


def _page_of(record_id: str):
    page = record_id.split(":")[2]
    return int(page) if page else None


def record(page, url, payload: bytes, digest: str, first) -> bytes:
    """One WARC record; ``first`` is the page id of the equal payload stored earlier, or None."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + (payload if first is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}",
             f"WARC-Record-ID: {_record_id(page, digest)}", f"WARC-Date: {DATE}",
             *([f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}"] if url is not None else []),
             f"WARC-Payload-Digest: sha1:{digest}",
             *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(first, digest)}"] if first is not None else []),
             "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record that starts at ``at``."""
    cut = data.index(b"\r\n\r\n", at)
    first, *rest = data[at:cut].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in rest)
    end = cut + 4 + int(headers["Content-Length"])
    return headers, data[cut + 4:end], end + 4


# --- bundles --------------------------------------------------------------------------------

class BundleWriter:
    """Appends records to a stream as frames; :meth:`close` adds the seek table."""

    def __init__(self, out, level: int = 3):
        import zstandard
        self.out, self.zip = out, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.size = self.total = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame number and offset inside the frame of the record."""
        if self.size and self.size + len(data) > FRAME_BYTES:
            self._flush()
        place = len(self.frames), self.size
        self.open.append(data)
        self.size += len(data)
        self.total += len(data)
        return place

    def _flush(self):
        packed = self.zip.compress(b"".join(self.open))
        self.out.write(packed)
        self.frames.append((len(packed), self.size))
        self.open, self.size = [], 0

    def close(self):
        if self.size:
            self._flush()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        foot = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(foot)) + entries + foot)
        self.out.close()


def seek_table(f) -> list[tuple[int, int, int]]:
    """(offset, packed bytes, raw bytes) of every frame of an open, seekable file."""
    size = f.size()
    frames, _, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    raw = f.read_at(8 * frames, size - 9 - 8 * frames)
    table, at = [], 0
    for k in range(frames):
        packed, plain = struct.unpack_from("<II", raw, 8 * k)
        table.append((at, packed, plain))
        at += packed
    return table


def read_frame(f, entry) -> bytes:
    import zstandard
    at, packed, plain = entry
    return zstandard.ZstdDecompressor().decompress(f.read_at(packed, at), max_output_size=max(plain, 1))


def fetch(uri: str, path: str, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry: the footer and a single frame are read."""
    fs, _ = file_system(uri)
    with fs.open_input_file(path) as f:
        data = read_frame(f, seek_table(f)[frame])
    headers, block, _ = parse(data, offset)
    return headers, block


# --- Spark ----------------------------------------------------------------------------------

def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        part, out, path, index = TaskContext.get().partitionId(), None, "", []
        for batch in batches:
            for r in batch.to_pylist():
                if out is None or out.total >= BUNDLE_BYTES:
                    if out is not None:
                        out.close()
                    path = f"{root}/{part:06d}-{uuid.uuid4().hex}.warc.zst"
                    out = BundleWriter(fs.open_output_stream(path, compression=None))
                digest = base64.b32encode(bytes.fromhex(r["sha"])).decode()
                first = r["first"] if r["first"] is not None and r["first"] != r["page_id"] else None
                data = record(r["page_id"], r["url"], r["payload"], digest, first)
                frame, offset = out.add(data)
                index.append(dict(page_id=r["page_id"], record_id=_record_id(r["page_id"], digest),
                                  record_type="response" if first is None else "revisit", part=part,
                                  path=path, frame=frame, offset=offset, length=len(data)))
            yield pa.RecordBatch.from_pylist(index, schema=_index())
            index = []
        if out is not None:
            out.close()
    return run


def _index() -> pa.Schema:
    return pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()),
                      ("part", pa.int32()), ("path", pa.string()), ("frame", pa.int64()),
                      ("offset", pa.int64()), ("length", pa.int64())])


def write_archives(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write a record per row of ``pages`` and return the index (with the folder as ``uri``).

    Null html is an empty payload and a null URL leaves its header out.  Rows that repeat the
    smallest page id of a payload are all responses; a null page id never is the smallest.
    The stored index is the commit record: bundles of failed attempts are not in it.  An empty
    table writes nothing; other columns are ignored.  Payload groups are pre-aggregated to one
    row per digest, and the join back to the pages is a plain equi-join that AQE may split.
    """
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload"), F.sha1(payload).alias("sha"))
    groups = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha") \
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return written(rows.join(groups, "sha", "left").mapInArrow(_writer(folder), INDEX), "warc-index") \
        .withColumn("uri", F.lit(folder))


#: Bytes of records that one task reads back, or fewer where the cluster has cores to spare.
TASK_BYTES = 64 << 20


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in batch.to_pylist():
            fs, _ = file_system(b["uri"])
            with fs.open_input_file(b["path"]) as f:
                for entry in seek_table(f):
                    data, at, rows = read_frame(f, entry), 0, []
                    while at < len(data):
                        head, block, at = parse(data, at)
                        http, _, body = block.partition(b"\r\n\r\n")
                        size = int(http.decode().rsplit("Content-Length: ", 1)[1].split("\r\n")[0])
                        revisit = head["WARC-Type"] == "revisit"
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if not revisit and (len(body) != size or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
                            raise ValueError(f"damaged record {head['WARC-Record-ID']}")
                        rows.append(dict(page_id=_page_of(head["WARC-Record-ID"]), payload_bytes=size, payload_digest=digest,
                                         record_type=head["WARC-Type"],
                                         refers_to=_page_of(head["WARC-Refers-To"]) if revisit else None,
                                         url=head.get("WARC-Target-URI")))
                    yield pa.RecordBatch.from_pylist(rows, schema=_read())


def _read() -> pa.Schema:
    return pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                      ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def read_archives(index: DataFrame) -> DataFrame:
    """Every record of the bundles an index names, one task per bundle, a frame at a time.

    Responses are checked against their length and digest; a damaged one fails the job."""
    sizes = index.groupBy("uri", "path").agg(F.sum("length").alias("_bytes"))
    files, size = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("_bytes"), F.lit(0))).first()
    # only paths are shuffled, so the number of tasks follows the bytes behind them
    spread = max(1, min(files, max(-(-size // TASK_BYTES), 4 * index.sparkSession.sparkContext.defaultParallelism)))
    bundles = sizes.select("uri", "path").repartition(spread, "path")
    return bundles.mapInArrow(_reader, READ)
