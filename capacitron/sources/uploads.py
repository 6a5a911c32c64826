"""Uploaded inputs of the scoring path: load files, the grid-operator register and
preprocessed profiles (SURVEY §2.1 src_load_file, src_register_csv, src_latest_file,
§2.3 flt_required_columns).  ``materialize_uploads`` writes them, derived from the
driver tables, under the shared scratch folder once per scale-factor directory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import scratch_path
from . import headers as H
from . import tables as T
from .files import exists, list_files, touch, write_text_files

# Accepted load-file headers, in order of preference.
LOAD_COLUMN_VARIANTS = [("timestamp", "value kwh"), ("timestamp_utc", "value")]
# Columns of preprocessed profiles, and the two names of the consumption.
PREPROCESSED_COLUMNS = ("timestamp_utc", "grid_load_kwh", "pv_load_kwh")
CONSUMPTION_NAMES = ("consumption_kwh", "consumption_load_kwh")
REGISTER_COLUMNS = ["plz", "netzbetreiber", "ort", "bdew_code"]


def uploads_root(spark, sf_dir: str) -> str:
    return scratch_path(spark, "uploads-" + T.tag(spark, sf_dir))


def materialize_uploads(spark, sf_dir: str, root: str | None = None) -> str:
    root = root or uploads_root(spark, sf_dir)
    if exists(root, "_SUCCESS"):
        return root
    from ..operators import profile as P
    load = T.load_profile(spark, sf_dir)
    site = F.col("site_id")
    variant = site % 3
    path = F.concat(F.lit("load/site_"), site.cast("string"), F.lit(".csv"))
    header = load.select("site_id").distinct().select(
        path.alias("path"), F.lit(-1).cast("long").alias("seq"),
        F.when(variant == 0, F.lit("timestamp,value kwh")).when(variant == 1, F.lit("timestamp_utc,value"))
        .otherwise(F.lit("time,kwh")).alias("line"))
    v = F.col("grid_load_kwh")
    txt = (F.when(F.minute("timestamp_utc") == 45, F.lit("n/a"))
           .when(F.hour("timestamp_utc") == 3, (-v).cast("string")).otherwise(v.cast("string")))
    body = load.select(path.alias("path"), F.unix_micros(F.col("timestamp_utc").cast("timestamp")).alias("seq"),
                       F.concat_ws(",", F.date_format("timestamp_utc", "yyyy-MM-dd HH:mm:ss"), txt).alias("line"))
    merged = P.merge_load_pv(load, P.weekday_scale(load, T.pv_profile(spark, sf_dir), 0.33))
    ppath = F.concat(F.lit("preprocessed/site_"), site.cast("string"), F.lit("_preprocessed.csv"))
    ph = merged.select("site_id").distinct().select(ppath.alias("path"), F.lit(-1).cast("long").alias("seq"),
                                                   F.lit("timestamp_utc,grid_load_kwh,consumption_kwh,pv_load_kwh").alias("line"))
    pb = merged.select(ppath.alias("path"), F.unix_micros(F.col("timestamp_utc").cast("timestamp")).alias("seq"),
                       F.concat_ws(",", F.date_format("timestamp_utc", "yyyy-MM-dd HH:mm:ss"),
                                   *[F.col(c).cast("string") for c in ("grid_load_kwh", "consumption_kwh", "pv_load_kwh")]
                                   ).alias("line"))
    part = T.read(spark, sf_dir, "part")
    # the register: as many part files as Spark writes, each with the header
    part.select(F.regexp_replace("p_brand", "Brand#", "").alias(" PLZ "), F.col("p_name").alias(" Netzbetreiber "),
                F.col("p_type").alias("Ort"), F.col("p_partkey").alias(" BDEW_Code ")).write.mode("overwrite") \
        .option("header", "true").option("sep", ";").option("ignoreLeadingWhiteSpace", "false") \
        .option("ignoreTrailingWhiteSpace", "false").csv(f"{root}/register/netzbetreiber")
    write_text_files(header.unionByName(body).unionByName(ph).unionByName(pb), root)
    touch(root, "_SUCCESS")
    return root


def _pair(names, k: int):
    """Position of one column of the first accepted pair that a header has whole."""
    return F.coalesce(*[F.when(H.named(t)(names).isNotNull() & H.named(v)(names).isNotNull(), H.named((t, v)[k])(names))
                        for t, v in LOAD_COLUMN_VARIANTS])


LOAD_COLUMNS = {"time": lambda names: _pair(names, 0), "value": lambda names: _pair(names, 1)}


def load_files(spark, folder: str) -> DataFrame:
    """src_load_file for a folder of uploads: (file, timestamp_utc, grid_load_kwh).

    A file needs one of the accepted pairs of columns, in any order and among others; files
    without one are reported by :func:`invalid_files` and left out.  Times are read in any of
    the known forms (null if none fits).  Values: numeric text -> double, other text -> NULL,
    negatives clipped to 0 (NULL kept)."""
    text = H.lines(spark, folder)
    head = H.headers(text, LOAD_COLUMNS).where("time IS NOT NULL")
    rows = H.by_header(text, head, LOAD_COLUMNS)
    return rows.select(F.col("path").alias("file"), H.read_time("time").alias("timestamp_utc"),
                       S.nonneg(S.numeric_or_null("value")).alias("grid_load_kwh"))


def invalid_files(spark, folder: str, kind: str) -> DataFrame:
    """flt_required_columns: ``file, kind, missing, found`` of the files that lack a column.

    ``load`` files need one of the accepted pairs (the pair with fewest columns missing is
    named, the first among equals); ``preprocessed`` files need their base columns and the
    consumption under either name.  An empty file lacks all."""
    text = H.lines(spark, folder)
    head = H.headers(text, {}).select("path", "names")
    files = list_files(spark, folder).select("path").join(head, "path", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))

    def lacks(wanted):
        return F.filter(F.array(*[F.lit(w) for w in wanted]), lambda w: ~F.array_contains("names", w))
    if kind == "load":
        options = [lacks(pair) for pair in LOAD_COLUMN_VARIANTS]
    else:
        options = [lacks((*PREPROCESSED_COLUMNS, c)) for c in CONSUMPTION_NAMES]
    fewest = F.least(*[F.size(o) for o in options])
    missing = F.coalesce(*[F.when(F.size(o) == fewest, o) for o in options])
    return files.where(fewest > 0).select(F.col("path").alias("file"), F.lit(kind).alias("kind"),
                                          F.array_join(missing, ", ").alias("missing"), F.array_join("names", ", ").alias("found"))


def preprocessed_files(spark, folder: str) -> DataFrame:
    """Preprocessed profiles of a folder with every required column, by name; the consumption
    under either of its names."""
    columns = {c: H.named(c) for c in PREPROCESSED_COLUMNS} | {"consumption_kwh": H.named(*CONSUMPTION_NAMES)}
    text = H.lines(spark, folder)
    head = H.headers(text, columns).where(" AND ".join(f"{c} IS NOT NULL" for c in columns))
    rows = H.by_header(text, head, columns)
    return rows.select(F.col("path").alias("file"), H.read_time("timestamp_utc").alias("timestamp_utc"),
                       *[S.numeric_or_null(c).alias(c) for c in columns if c != "timestamp_utc"])


def register(spark, path: str) -> DataFrame:
    """src_register_csv: ';'-separated register, headers trimmed and lower-cased."""
    df = spark.read.option("header", "true").option("sep", ";").csv(path)
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    return df.select(*[F.trim(F.col(c)).alias(c) for c in df.columns])


def latest_file(spark, folder: str, glob: str = "*_preprocessed.csv") -> DataFrame:
    """src_latest_file: the newest matching file by modification time (max_by)."""
    f = list_files(spark, folder, glob)
    return f.agg(F.max_by("path", F.struct("modification_time", "path")).alias("path"),
                 F.max("modification_time").alias("modification_time"))
