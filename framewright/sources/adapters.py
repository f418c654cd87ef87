"""Outside tools behind adapters: the engine calls these and never a program of its own.

Downloading, decoding, text recognition and speech-to-text are no data operations.  An adapter turns a table of requests
into a table of results; :class:`Tables` is one that has the results already, for tests and for batches that other systems
land, ``programs.Programs`` one that calls programs.
"""

from __future__ import annotations

import importlib.util
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Media(Protocol):
    def info(self) -> DataFrame:
        """Info rows of the videos asked for (``VIDEO_INFO``)."""

    def captions(self) -> DataFrame:
        """``video_id, value``: caption texts."""

    def scores(self) -> DataFrame:
        """``video_id, t, score``: how much each decoded frame differs from the one before."""

    def frames(self, points: DataFrame) -> DataFrame:
        """``points`` with ``path`` of the picture taken at each."""

    def recognised(self, frames: DataFrame) -> DataFrame:
        """``video_id, frame_number, items``: what text recognition found on each frame."""

    def transcribed(self, videos: DataFrame) -> DataFrame:
        """``video_id, start, end, text``: speech of videos that have no captions."""


@dataclass
class Tables:
    """Results that are there already, as DataFrames."""

    info_rows: DataFrame
    caption_texts: DataFrame
    score_rows: DataFrame | None = None
    ocr_items: DataFrame | None = None
    speech: DataFrame | None = None

    def info(self) -> DataFrame:
        return self.info_rows

    def captions(self) -> DataFrame:
        return self.caption_texts

    def scores(self) -> DataFrame | None:
        return self.score_rows

    def frames(self, points: DataFrame) -> DataFrame:
        from ..functions.scalars import frame_name

        return points.withColumn("path", F.concat_ws("/", F.col("video_id").cast("string"), frame_name(F.col("timestamp"))))

    def recognised(self, frames: DataFrame) -> DataFrame | None:
        return self.ocr_items

    def transcribed(self, videos: DataFrame) -> DataFrame | None:
        return None if self.speech is None else self.speech.join(videos.select("video_id"), "video_id", "left_semi")


def speech_available(module: str = "faster_whisper") -> bool:
    """Whether a speech model's package is installed."""
    return importlib.util.find_spec(module) is not None


def scenes_from_scores(scores: DataFrame, detector: str = "content", sensitivity: float = 30.0, least: float = 0.6, around: int = 2, ratio: float = 3.0) -> DataFrame:
    """``video_id, scene_id, start, end`` from the frames' scores.

    ``content``: a scene is cut where the score reaches the sensitivity; ``adaptive``: where it reaches ``ratio`` times the
    mean of its neighbours, whatever the sensitivity.  A scene lasts ``least`` seconds at least.  A video without a cut has
    no scenes, which makes planning fall back to even steps.
    """
    by = Window.partitionBy("video_id").orderBy("t")
    if detector == "adaptive":
        near = by.rowsBetween(-around, around)
        others = (F.sum("score").over(near) - F.col("score")) / F.greatest(F.count("*").over(near) - 1, F.lit(1))
        hit = (F.col("score") >= ratio * others) & (F.col("score") >= 15.0)
    else:
        hit = F.col("score") >= sensitivity
    rows = scores.withColumn("_hit", hit).groupBy("video_id").agg(F.array_sort(F.collect_list(F.when(F.col("_hit"), F.col("t")))).alias("hits"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    zero = F.struct(F.col("lo").alias("last"), F.array().cast("array<double>").alias("cuts"))
    cuts = F.aggregate("hits", zero, lambda acc, t: F.when(t - acc["last"] >= least, F.struct(t.alias("last"), F.concat(acc["cuts"], F.array(t)).alias("cuts"))).otherwise(acc), lambda acc: acc["cuts"])
    edges = F.concat(F.array("lo"), cuts, F.array("hi"))
    found = rows.withColumn("_cuts", cuts).filter(F.size("_cuts") > 0).withColumn("_e", edges)
    spans = F.zip_with(F.slice("_e", 1, F.size("_e") - 1), F.slice("_e", 2, F.size("_e") - 1), lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    return found.select("video_id", F.posexplode(spans).alias("scene_id", "s")).select("video_id", "scene_id", "s.start", "s.end")
