"""Helpers all operators of this package use: tables, shared folders, files from tasks."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: The white space that separates words in every word contract of this package.
SPACE_CLASS = r"[ \t-\r]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder, seen by driver and executors, under ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a shared folder and read it back: lineage ends at files that survive
    the loss of any executor, and a non-deterministic plan is evaluated once."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def finished(spark: SparkSession) -> None:
    """After a large step whose rows are written: Spark deletes shuffle files when the driver
    collects its garbage, which few jobs on large tables seldom make it do."""
    spark.sparkContext._jvm.System.gc()


def freed(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``: a worker is kept for later tasks, so what its task has freed goes
    back to the machine at the end, instead of staying beside the next task's memory."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):        # the C library of Linux has it
                trim(0)
    return whole


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder, for use inside tasks (file, hdfs, s3, ...)."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def lower_ascii(col):
    """A-Z lower-cased, every other character as it is."""
    return F.translate(col, UPPER, LOWER)


def text_or_empty(col="text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def keyed(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Only the key and the text, whatever other columns the table carries."""
    return docs.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text"))
