"""Keyed tables on a shared file system that are merged into, version by version (bn_save,
set_upsert_kpi).

A merge writes only the rows that are new or differ, as the next version; a reader takes for each
key its row of the highest version (``max_by``, a partial aggregate).  A merge that changes
nothing writes nothing.  Version numbers are claimed by creating a file that must not exist yet,
and a version counts once its ``_SUCCESS`` marker stands, so readers see whole merges only and a
failed one leaves no trace but an unused number.  :meth:`SnapshotTable.compact` writes all rows
as one version, which readers start from.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SnapshotTable:
    """Rows by ``keys`` under ``root``; every merge has the same columns."""

    def __init__(self, spark, root: str, keys):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), list(keys)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self) -> list[str]:
        fs, p = self._fs(self.root)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self) -> list[tuple[int, bool]]:
        """``(version, whole)`` of the complete versions, from the last whole one on."""
        out = []
        for name in self._names():
            kind, _, number = name.partition("-")
            if kind in ("merge", "whole") and number.isdigit():
                fs, p = self._fs(f"{self.root}/{name}/_SUCCESS")
                if fs.exists(p):
                    out.append((int(number), kind == "whole"))
        out.sort()
        starts = [k for k, (_, whole) in enumerate(out) if whole]
        return out[starts[-1]:] if starts else out

    def version(self) -> int:
        """The last complete version, 0 if there is none."""
        got = self.versions()
        return got[-1][0] if got else 0

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows as of a version that has not been compacted away (the last one by default)."""
        parts = [(v, whole) for v, whole in self.versions() if version is None or v <= version]
        if not parts:
            return None
        rows = None
        for v, whole in parts:
            df = self.spark.read.parquet(f"{self.root}/{'whole' if whole else 'merge'}-{v}").withColumn("_v", F.lit(v))
            rows = df if rows is None else rows.unionByName(df, allowMissingColumns=True)
        if len(parts) == 1:
            return rows.drop("_v")
        others = [c for c in rows.columns if c not in (*self.keys, "_v")]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others), F.col("_v")).alias("_r"))
        return last.select(*self.keys, *[F.col(f"_r.{c}").alias(c) for c in others])

    def _next(self) -> int:
        numbers = [int(n.split("-")[1]) for n in self._names() if n.split("-")[0] in ("merge", "whole", "claim") and n.split("-")[1].isdigit()]
        v = max(numbers, default=0) + 1
        while True:
            fs, p = self._fs(f"{self.root}/claim-{v}")
            if fs.createNewFile(p):
                return v
            v += 1

    def _write(self, df: DataFrame, kind: str) -> int:
        v = self._next()
        df.repartitionByRange(*self.keys).sortWithinPartitions(*self.keys).write.parquet(f"{self.root}/{kind}-{v}")
        return v

    def merge(self, new: DataFrame) -> int | None:
        """Replace or add rows by key (unique in ``new``); the version, or None if nothing changes."""
        old = self.read()
        if old is not None:
            others = [c for c in new.columns if c not in self.keys]
            known = old.select(*self.keys, F.struct(*[F.col(c) if c in old.columns else F.lit(None).alias(c) for c in others]).alias("_old"))
            joined = new.withColumn("_new", F.struct(*others)).join(known, self.keys, "left")
            changed = joined.where(~F.col("_new").eqNullSafe(F.col("_old"))).select(*new.columns)
            # written as found, so that the rows are joined once and not for every look at them
            path = f"{self.root}/found-{uuid.uuid4().hex}"
            changed.write.option("compression", "zstd").parquet(path)
            new = self.spark.read.schema(changed.schema).parquet(path)
            if new.isEmpty():
                return None
        return self._write(new, "merge")

    def compact(self) -> int | None:
        """All rows as one version that readers start from."""
        rows = self.read()
        return None if rows is None else self._write(rows, "whole")
