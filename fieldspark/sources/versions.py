"""Snapshots of a table that writers replace while readers read."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from . import files


class Versions:
    """A table kept as numbered Parquet folders and a pointer file to the current one.

    A writer publishes a new folder by replacing the pointer; readers keep the
    version they opened.  ``rotate`` drops all but the newest ``keep``.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _state(self) -> list[int]:
        p = f"{self.path}/current.json"
        return json.loads(files.read_bytes(p)) if files.exists(p) else []

    def publish(self, df: DataFrame) -> int:
        have = self._state()
        v = (have[-1] if have else 0) + 1
        df.write.parquet(f"{self.path}/v{v}")
        files.write_bytes(f"{self.path}/current.json", json.dumps([*have, v]).encode())
        return v

    def read(self, version: int | None = None) -> DataFrame:
        have = self._state()
        if not have or version is not None and version not in have:
            raise LookupError("no such version")
        return self.spark.read.parquet(f"{self.path}/v{version or have[-1]}")

    def rotate(self, keep: int = 2) -> None:
        have = self._state()
        files.write_bytes(f"{self.path}/current.json", json.dumps(have[-keep:]).encode())
        for v in have[:-keep]:
            f, p = files.filesystem(f"{self.path}/v{v}")
            f.delete_dir(p)
