"""Stages that are skipped when their result is there: marks with a fingerprint of inputs and parameters.

A mark is a file ``<stage>.done`` that holds the fingerprint, so another parameter makes the stage run again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

STAGES = ("fetch", "extract", "ocr", "dedup-with-ocr-context", "align", "manifest")


def stage_name(value: str) -> str:
    if value not in STAGES:
        raise ValueError(f"unknown stage {value!r}: one of {', '.join(STAGES)}")
    return value


def fingerprint(**parameters: object) -> str:
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:16]


@dataclass
class Marks:
    """Marks in a folder of any file system that Spark reaches."""

    spark: SparkSession
    folder: str

    def _at(self, stage: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{stage}.done")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def done(self, stage: str, key: str | None = None) -> bool:
        """Whether the stage is done; with a key, whether it was with that one."""
        fs, path = self._at(stage_name(stage))
        if not fs.exists(path):
            return False
        if key is None:
            return True
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode() == key
        finally:
            stream.close()

    def mark(self, stage: str, key: str = "") -> None:
        fs, path = self._at(stage_name(stage))
        out = fs.create(path, True)
        try:
            out.write(bytearray(key.encode()))
        finally:
            out.close()

    def clear(self, first: str = STAGES[0]) -> None:
        """Takes the marks of a stage and of all after it."""
        for stage in STAGES[STAGES.index(stage_name(first)) :]:
            fs, path = self._at(stage)
            fs.delete(path, False)

    def run(self, stage: str, key: str, at: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table: made, written and marked, or read if the mark has the key."""
        if not self.done(stage, key):
            self.clear(stage)
            make().write.mode("overwrite").parquet(at)
            self.mark(stage, key)
        return self.spark.read.parquet(at)
