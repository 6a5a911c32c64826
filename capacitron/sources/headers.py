"""Delimited files whose columns are found by name, file by file.

Spark's CSV source assigns columns by position once a schema is given, so a file with another
column order yields wrong values without an error.  Here the lines of all files are read as
text; each file's header is its first line that is not blank (the line at offset 0, found by the
block start the source reports), and its names are resolved to positions once per file.  Rows
then meet their file's positions in an equi-join on the path and take each field by position, so
files may order, add or leave out columns as they like.  Fields may be quoted, a quoted line
break is not supported.  Everything is built-in expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import decoded_path, packed_files

#: Time formats tried in order after the ISO forms that a cast reads (offsets included).
TIME_FORMATS = ["dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy HH:mm", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm",
                "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "yyyyMMdd HHmmss", "dd.MM.yyyy"]


def lines(spark, root: str, glob: str | None = None) -> DataFrame:
    """``path, block, line, value``: the lines that are not blank; ``block, line`` ascend in a file."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.text(root).select(
        decoded_path("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), F.regexp_replace("value", "^﻿", "").alias("value"))
    return raw.where(F.trim("value") != "")


def split_fields(line: str, sep: str = ",") -> Column:
    """Fields of a line; quoted ones without their quotes, doubled quotes made single."""
    plain = F.split(F.col(line), "\\" + sep if sep in "|.^$*+?" else sep, -1)
    quoted = F.regexp_extract_all(F.concat(F.lit(sep), F.col(line)), F.lit(f'\\{sep}("(?:[^"]|"")*"|[^{sep}]*)'), 1)
    open_ = F.transform(quoted, lambda f: F.when(
        f.startswith('"') & f.endswith('"') & (F.char_length(f) > 1),
        F.regexp_replace(F.substring(f, F.lit(2), F.char_length(f) - 2), '""', '"')).otherwise(f))
    return F.when(F.col(line).contains('"'), open_).otherwise(plain)


def named(*wanted: str) -> Callable[[Column], Column]:
    """Position (from 0) of the first wanted name that a header has, null if it has none."""
    def find(names: Column) -> Column:
        return F.coalesce(*[F.nullif(F.array_position(names, F.lit(w)), F.lit(0)) for w in wanted]) - 1
    return find


def first_where(test: Callable[[Column], Column], *but: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Position of the first name that passes a test and is at none of the given positions."""
    def find(names: Column) -> Column:
        def among(taken):
            def ok(name, at):
                good = test(name)
                if taken is not None:
                    good = good & ~F.exists(taken, lambda t: t.eqNullSafe(at))
                return F.coalesce(good, F.lit(False))
            return F.nullif(F.array_position(F.transform(names, ok), F.lit(True)), F.lit(0)) - 1
        if not but:
            return among(None)
        # bound once per header: within the lambda over names they would be found again for every name
        taken = F.array(*[f(names).cast("int") for f in but])
        return F.get(F.transform(F.array(taken), among), F.lit(0))
    return find


def _names(head: str, sep: str) -> Column:
    return F.transform(split_fields(head, sep), lambda n: F.lower(F.trim(n)))


def headers(text: DataFrame, columns: dict[str, Callable[[Column], Column]], sep: str = ",") -> DataFrame:
    """``path, header_line, names`` of every file that has a line, and the position of every
    column (null where the header lacks it)."""
    head = text.where("block = 0").groupBy("path").agg(F.min(F.struct("line", "value")).alias("h")) \
        .select("path", F.col("h.line").alias("header_line"), F.col("h.value").alias("_head"))
    head = head.select("path", "header_line", _names("_head", sep).alias("names"))
    return _places(head, columns)


def _places(head: DataFrame, columns, rest: str | None = None) -> DataFrame:
    """The position of every column, and where ``rest`` is asked for the positions no column takes
    (``_free``; the first of those that share a name), found once per file."""
    at = head.select("*", *[f(F.col("names")).cast("int").alias(c) for c, f in columns.items()])
    return at.withColumn("_free", _free(columns)) if rest else at


def _free(columns) -> Column:
    used = F.array(*[F.col(c) for c in columns])
    return F.filter(F.sequence(F.lit(0), F.size("names") - 1), lambda k: ~F.exists(used, lambda u: u.eqNullSafe(k)) & (
        F.array_position("names", F.get("names", k)) == k + 1))


def by_header(text: DataFrame, head: DataFrame, columns, sep: str = ",", rest: str | None = None) -> DataFrame:
    """``path, block, line`` and the text of every column, for all lines below the headers.

    ``rest`` names a column for the fields no column takes, as a JSON object (null if none)."""
    head = head.withColumn("_free", _free(columns)) if rest else head
    at = head.select("path", "header_line", "names", *(["_free"] if rest else []), *[F.col(c).alias(f"_at_{c}") for c in columns])
    return _by_place(text.join(at, "path"), list(columns), sep, rest)


def _by_place(lines_: DataFrame, columns: list[str], sep: str, rest: str | None) -> DataFrame:
    rows = lines_.where("block > 0 OR line <> header_line").withColumn("_f", split_fields("value", sep))
    out = [F.get("_f", F.col(f"_at_{c}")).alias(c) for c in columns]
    if rest:
        pairs = F.map_from_arrays(F.transform("_free", lambda k: F.get("names", k)), F.transform("_free", lambda k: F.get("_f", k)))
        out.append(F.when(F.size("_free") > 0, F.to_json(pairs)).alias(rest))
    return rows.select("path", "block", "line", *out)


def sheets(spark, root: str, glob: str, columns, keep: str = "true", sep: str = ",", rest: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(headers, rows)`` of the files of a root: :func:`headers`, and :func:`by_header` of those
    whose header passes ``keep``.

    In a packed root a file's first piece holds its header, so its lines take their positions from
    their own piece; only further pieces of long files meet the headers in a join."""
    pieces = packed_files(spark, root, glob)
    if pieces is None:
        text = lines(spark, root, glob)
        head = headers(text, columns, sep)
        return head, by_header(text, head.where(keep), columns, sep, rest)
    ends = F.when(F.col("content").contains("\r"), F.split("content", "\r\n|\r|\n")).otherwise(F.split("content", "\n"))
    pieces = pieces.select("path", "block", "last", ends.alias("_lines"))

    def clean(line):
        line = F.col(line) if isinstance(line, str) else line
        return F.when(line.startswith("\ufeff"), F.substring(line, 2, 1 << 30)).otherwise(line)

    def at_first(lines_):
        known = F.transform(lines_, lambda v: F.trim(clean(v)) != "")
        return F.when(F.trim(clean(F.get(lines_, F.lit(0)))) != "", F.lit(0)).otherwise(F.array_position(known, F.lit(True)).cast("int") - 1)
    first = pieces.where("block = 0").withColumn("header_line", at_first(F.col("_lines"))).where("header_line >= 0")
    first = first.withColumn("_head", clean(F.get("_lines", F.col("header_line")))).withColumn("names", _names("_head", sep))
    first = _places(first, columns, rest)
    head = first.select("path", "header_line", "names", *columns)
    at = ["header_line", "names", *(["_free"] if rest else []), *[F.col(c).alias(f"_at_{c}") for c in columns]]
    own = first.where(keep).select("path", "block", "_lines", *at)
    more = pieces.where("block > 0").join(first.where("NOT last").where(keep).select("path", *at), "path").select(own.columns)
    text = own.unionByName(more).select(*[c for c in own.columns if c != "_lines"], F.posexplode("_lines").alias("line", "value"))
    text = text.withColumn("value", clean("value")).where(F.trim("value") != "")
    return head, _by_place(text, list(columns), sep, rest)


def read_time(c) -> Column:
    """Text -> UTC timestamp: ISO forms (with ``T``, fractions, offsets), then ``TIME_FORMATS``;
    null where none fits."""
    t = F.trim(F.col(c) if isinstance(c, str) else c)
    dated = F.when(t.rlike(r"^\d{4}-"), F.try_to_timestamp(t))
    return F.coalesce(dated, *[F.try_to_timestamp(t, F.lit(f)) for f in TIME_FORMATS])
