"""Distributed text-file writer and file listing helpers.

``write_text_files`` turns rows ``(path, seq, line)`` into files: rows are hash
partitioned by path and sorted within partitions, and a ``mapInPandas`` task streams
each path's lines into one file (pyarrow filesystem, so local, HDFS or object-store
roots work).  No group is ever materialised; a retried task rewrites its files.

``write_packed_files`` takes the same rows and writes the same files into one Parquet table under
the root (``path, name, block, size, last, modification_time, content``), for trees of so many small
files that a file system takes longer to create, list and open them than Spark to read them.
``list_files`` and ``packed_files`` read such a root like a folder.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fs(root: str):
    import pyarrow.fs as pafs
    if "://" in root:
        fs, base = pafs.FileSystem.from_uri(root)
        return fs, base
    return pafs.LocalFileSystem(), root


def fingerprint(spark, path: str) -> str:
    """A hash of the names, sizes and times of the files under a path: what is stored or remembered
    under it is used again only while the files are the same."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return "none"
    found, files = [], fs.listFiles(p, True)
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(found)).encode()).hexdigest()[:16]


_MEMO: dict = {}


def memo(spark, key: tuple, build):
    """What ``build()`` gave for a key in this application (plans and small models, never data)."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _MEMO:
        _MEMO[key] = build()
    return _MEMO[key]


def exists(root: str, rel: str) -> bool:
    import pyarrow.fs as pafs
    fs, base = _fs(root)
    return fs.get_file_info(f"{base}/{rel}").type != pafs.FileType.NotFound


def touch(root: str, rel: str) -> None:
    fs, base = _fs(root)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/{rel}") as f:
        f.write(b"")


def write_text_files(rows: DataFrame, root: str) -> int:
    """Write every distinct ``path`` of ``rows(path, seq, line)`` under ``root``."""
    def writer(it):
        fs, base = _fs(root)
        made = set()
        cur, out, n = None, None, 0
        for pdf in it:
            for path, line in zip(pdf["path"], pdf["line"]):
                if path != cur:
                    if out is not None:
                        out.close()
                        n += 1
                    full = f"{base}/{path}"
                    d = full.rsplit("/", 1)[0]
                    if d not in made:
                        fs.create_dir(d, recursive=True)
                        made.add(d)
                    out, cur = fs.open_output_stream(full), path
                out.write((("" if line is None else line) + "\n").encode("utf-8"))
        if out is not None:
            out.close()
            n += 1
        yield pd.DataFrame({"files": [n]})

    res = (rows.repartition("path").sortWithinPartitions("path", "seq")
           .mapInPandas(writer, "files long"))
    return int(res.agg(F.sum("files")).first()[0] or 0)


#: Folder of a packed root; Spark's readers of folders pass over names that begin with ``_``.
PACKED = "_packed"
#: Files of a packed root that one Parquet file holds at most, so that readers share them out.
PACK_FILES = 50_000
#: Characters of a stored piece of a packed file; pieces end at line ends.
PACK_CHARS = 1 << 20
_PIECE = "path string, block long, size long, last boolean, content string"


def write_packed_files(rows: DataFrame, root: str, chars: int = PACK_CHARS, whole: DataFrame | None = None) -> None:
    """The files of ``rows(path, seq, line)`` as a table under ``root``, long ones in pieces that
    begin at byte ``block``; a task holds a few pieces, never a whole file.

    ``whole(path, content)`` are further, short files whose lines need not be brought together:
    they are stored as they come, a row per file."""
    def writer(it):
        cur, block, held, n, done, full = None, 0, [], 0, [], 0

        def piece(last):
            text = "".join(held)
            size = len(text.encode("utf-8"))
            done.append((cur, block, size, last, text))
            return size
        for pdf in it:
            for path, line in zip(pdf["path"], pdf["line"]):
                if path != cur:
                    if cur is not None:
                        piece(True)
                    cur, block, held, n = path, 0, [], 0
                elif n >= chars:
                    block, held, n = block + piece(False), [], 0
                held.append(("" if line is None else line) + "\n")
                n, full = n + len(held[-1]), full + len(held[-1])
                if full >= 8 * chars:
                    yield pd.DataFrame(done, columns=["path", "block", "size", "last", "content"])
                    done, full = [], 0
        if cur is not None:
            piece(True)
        yield pd.DataFrame(done, columns=["path", "block", "size", "last", "content"])

    pieces = rows.repartition("path").sortWithinPartitions("path", "seq").mapInPandas(writer, _PIECE)
    if whole is not None:
        pieces = pieces.unionByName(whole.select("path", F.lit(0).cast("long").alias("block"), F.octet_length("content").cast("long").alias("size"),
                                                 F.lit(True).alias("last"), "content"))
    # names as a column of their own: readers of one kind of files pass over the row groups of others
    (pieces.withColumn("name", F.substring_index("path", "/", -1)).withColumn("modification_time", F.current_timestamp())
     .write.mode("overwrite").option("maxRecordsPerFile", PACK_FILES).parquet(f"{root}/{PACKED}"))


def _glob_pattern(glob: str) -> str:
    """A file name glob (``*``, ``?``, ``{a,b}``) as a regular expression."""
    parts = {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|"}
    return "(^|/)" + "".join(parts.get(c, _re_escape(c)) for c in glob) + "$"


def _named_like(glob: str) -> "F.Column":
    """Whether ``name`` fits a glob.  Beginnings and ends are compared as they are, which Parquet's
    statistics can use too; other globs become a regular expression."""
    open_, close = glob.find("{"), glob.find("}")
    each = [glob] if open_ < 0 else [glob[:open_] + x + glob[close + 1:] for x in glob[open_ + 1:close].split(",")]
    out = F.lit(False)
    for one in each:
        head, star, tail = one.partition("*")
        if any(c in one for c in "?{}[]\\") or not star or "*" in tail:
            return F.col("name").rlike(_glob_pattern(glob))
        out = out | (F.col("name").startswith(head) & F.col("name").endswith(tail) & (F.char_length("name") >= len(head) + len(tail)))
    return out


def packed_files(spark, root: str, glob: str | None = None) -> DataFrame | None:
    """The pieces of a packed root's files (null if the root is a plain folder), their paths below
    the root as ``rel``; names that Spark does not list in folders are left out."""
    if not exists(root, f"{PACKED}/_SUCCESS"):
        return None
    df = spark.read.parquet(f"{root}/{PACKED}").withColumnRenamed("path", "rel")
    rel = F.col("rel")
    if glob:
        df = df.where(_named_like(glob))
    df = df.where(~(rel.startswith("_") | rel.startswith(".") | rel.contains("/_") | rel.contains("/.")))
    base = decoded_path(F.lit(root.rstrip("/")))
    return df.withColumn("path", F.concat(base, F.lit("/"), "rel"))


def decoded_path(c) -> "F.Column":
    """File URIs from ``binaryFile`` / ``_metadata.file_path`` -> plain paths ('+' kept)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.url_decode(F.regexp_replace(c, r"\+", "%2B")), "^file:(//)?", "")


def relative_path(c, root: str) -> "F.Column":
    """Decoded paths -> paths below ``root``."""
    import re
    c = F.col(c) if isinstance(c, str) else c
    base = re.sub("^file:/*", "/", root.rstrip("/"))
    return F.when(c.startswith(base + "/"), F.substring(c, len(base) + 2, 1 << 30)).otherwise(
        F.regexp_replace(c, "^.*?" + _re_escape(base) + "/", ""))


def list_files(spark, root: str, glob: str | None = None) -> DataFrame:
    """(path, rel, parts, name, modification_time, length) of every file under root.

    Only path metadata is selected, so the binary content is pruned from the scan."""
    if (packed := packed_files(spark, root, glob)) is not None:
        parts = F.split("rel", "/")
        return packed.where("last").select("path", "rel", parts.alias("parts"), "name", "modification_time", (F.col("block") + F.col("size")).alias("length"))
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(root).select("path", "modificationTime", "length")
    df = df.withColumn("path", decoded_path("path"))
    rel = relative_path("path", root)
    return df.select("path", rel.alias("rel"), F.split(rel, "/").alias("parts"),
                     F.element_at(F.split(rel, "/"), -1).alias("name"),
                     F.col("modificationTime").alias("modification_time"), "length")


def _re_escape(s: str) -> str:
    import re
    return re.escape(s)
