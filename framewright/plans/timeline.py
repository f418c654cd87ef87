"""The two plans over many videos at once: light (transcript and chapters) and thorough (scenes)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.images import is_black, is_blurry, is_slide_like
from ..operators.align import align_captions
from ..operators.chapters import synthetic_chapters, with_density
from ..operators.cues import cue_timestamps
from ..operators.dedup import deduplicate_frames
from ..operators.sampling import fill, light_points, numbered, scene_points


def chapters_or_synthetic(videos: DataFrame, chapters: DataFrame, length: float = 600.0) -> DataFrame:
    """The videos' own chapters, and equal parts for those that have none."""
    bare = videos.join(chapters.select("video_id").distinct(), "video_id", "left_anti")
    return chapters.unionByName(synthetic_chapters(bare, length))


def light_plan(segments: DataFrame, chapters: DataFrame, tiers: Sequence[int] = (1, 2, 3), window: float = 15.0, budget: int = 200, per_chapter: int = 3) -> DataFrame:
    """``video_id, chapter_number, density, frame_number, timestamp, origin``: the frames to take, without decoding a video."""
    times = fill(chapters, cue_timestamps(segments, tiers, window), budget, per_chapter)
    points = numbered(light_points(times, chapters))
    return points.select("video_id", "chapter_number", "density", "frame_number", "timestamp", "origin")


def thorough_plan(scenes: DataFrame, chapters: DataFrame, profiles: DataFrame, fallback: float = 30.0) -> DataFrame:
    """``video_id, chapter_number, density, frame_number, timestamp, scene_id``: samples inside scenes."""
    return numbered(scene_points(scenes, chapters, profiles, fallback))


def keep_frames(frames: DataFrame, profiles: DataFrame) -> DataFrame:
    """Measured frames with ``good, is_slide, is_kept``: quality first, near duplicates among the good ones, in order."""
    good = ~is_black(F.col("mean_luma")) & ~is_blurry(F.col("lap_var"))
    judged = frames.withColumn("good", good).withColumn("is_slide", is_slide_like(F.col("ocr_text"), F.col("edge_density")))
    kept = deduplicate_frames(judged.filter("good"), profiles)
    return kept.unionByName(judged.filter(~F.col("good")).withColumn("is_kept", F.lit(False)))


def aligned(points: DataFrame, captions: DataFrame, window: float = 3.0) -> DataFrame:
    """``points`` with the captions around each."""
    return points.join(align_captions(points, captions, window), ["video_id", "frame_number"])


def prepared_chapters(videos: DataFrame, chapters: DataFrame, default: str = "normal", dense: Sequence[int] = (), until: float | None = None) -> DataFrame:
    return with_density(chapters_or_synthetic(videos, chapters), default, dense, until)
