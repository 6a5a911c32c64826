"""A versioned model registry on a shared file system.

Every registration is a new, immutable version: its number is claimed by creating a file that
must not exist yet (so two writers never share one), the model is written, and the information
row is written last.  A version is published once that row's ``_SUCCESS`` marker stands, so no
reader sees half of one, and older versions can still be loaded.  With ``expected`` a writer
publishes only if the current version is still the one it started from.  Clearing a model
publishes a version without one: nothing a running job reads is deleted.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INFO = ("name string, version long, model_type string, metrics map<string,double>, feature_importance map<string,double>, "
        "hyperparameters string, n_samples long, n_features long, features array<string>, model string, trained_at timestamp, cleared boolean")


class StaleVersion(RuntimeError):
    """The current version is not the expected one."""


class ModelRegistry:
    """Models under ``root``, one folder per name and version."""

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _children(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _published(self, name: str) -> list[int]:
        """Published version numbers, those of cleared ones included."""
        out = []
        for child in self._children(f"{self.root}/{name}"):
            if child.startswith("v") and child[1:].isdigit():
                fs, p = self._fs(f"{self.root}/{name}/{child}/info/_SUCCESS")
                if fs.exists(p):
                    out.append(int(child[1:]))
        return sorted(out)

    def _row(self, name: str, version: int):
        return self.spark.read.schema(INFO).parquet(f"{self.root}/{name}/v{version}/info").first()

    def versions(self, name: str) -> list[int]:
        """Versions since the model was last cleared."""
        out = []
        for v in reversed(self._published(_clean(name))):
            if self._row(_clean(name), v)["cleared"]:
                break
            out.append(v)
        return out[::-1]

    def _claim(self, name: str, expected: int | None) -> int:
        got = self._published(name)
        current = got[-1] if got else 0
        if expected is not None and expected != current:
            raise StaleVersion(f"{name} is at version {current}, not {expected}")
        taken = [int(c[1:-6]) for c in self._children(f"{self.root}/{name}") if c.endswith(".claim")]
        v = max([current, *(taken if expected is None else [])]) + 1
        while True:
            fs, p = self._fs(f"{self.root}/{name}/v{v}.claim")
            if fs.createNewFile(p):
                return v
            if expected is not None:
                raise StaleVersion(f"version {v} of {name} is being written by another job")
            v += 1

    def register(self, name: str, model, metrics: dict, importance: dict, features, params: dict | None = None,
                 n_samples: int = 0, expected: int | None = None) -> int:
        """Publish a model (a fitted pipeline, or a dict that JSON can hold); returns its version."""
        name = _clean(name)
        version = self._claim(name, expected)
        base = f"{self.root}/{name}/v{version}"
        if isinstance(model, dict):
            kind, text = "moments", json.dumps(model)
        else:
            kind, text = type(model.stages[-1]).__name__, f"{base}/pipeline"
            model.write().save(text)
        numbers = {k: float(v) for k, v in metrics.items() if v is not None}
        self._publish(base, (name, version, kind, numbers, {k: float(v) for k, v in importance.items()}, json.dumps(params or {}),
                             int(n_samples), len(list(features)), list(features), text, dt.datetime.now(), False))
        return version

    def _publish(self, base: str, row: tuple) -> None:
        self.spark.createDataFrame([row], INFO).coalesce(1).write.parquet(f"{base}/info")

    def info(self, name: str, version: int | None = None):
        """The information row of a version (the current one by default)."""
        name = _clean(name)
        have = self.versions(name)
        if not have or (version is not None and version not in have):
            raise ValueError(f"Model not found: {name}. Available: {self.names()}")
        return self._row(name, have[-1] if version is None else version)

    def load(self, name: str, version: int | None = None):
        """The model of a version, and its information row."""
        row = self.info(name, version)
        if row["model_type"] == "moments":
            return json.loads(row["model"]), row
        from pyspark.ml import PipelineModel
        return PipelineModel.load(row["model"]), row

    def names(self) -> list[str]:
        return [n for n in self._children(self.root) if self.versions(n)]

    def table(self, history: bool = False) -> DataFrame:
        """A row per model (per version with ``history``)."""
        paths = [f"{self.root}/{n}/v{v}/info" for n in self.names() for v in (self.versions(n) if history else self.versions(n)[-1:])]
        if not paths:
            return self.spark.createDataFrame([], INFO)
        return self.spark.read.schema(INFO).parquet(*paths).where(~F.col("cleared"))

    def is_trained(self, name: str) -> bool:
        return bool(self.versions(_clean(name)))

    def all_trained(self, names) -> bool:
        return all(self.is_trained(n) for n in names)

    def clear(self, name: str | None = None) -> None:
        """Take a model (or all) out of the registry; its files stay for jobs that read them."""
        for n in [_clean(name)] if name else self.names():
            v = self._claim(n, None)
            self._publish(f"{self.root}/{n}/v{v}", (n, v, "none", {}, {}, "{}", 0, 0, [], "", dt.datetime.now(), True))


def _clean(name: str) -> str:
    return name.removeprefix("target_")
