"""Chapters: made up where there are none, densities, and which one a time falls in."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def synthetic_chapters(videos: DataFrame, length: float = 600.0) -> DataFrame:
    """``video_id, chapter_number, title, start_time, end_time, is_synthetic`` for ``videos(video_id, duration)``.

    Equal parts, as many as fit whole lengths into the duration, one at least; so ``length`` is the least a part has.  A
    video without a duration is one part of length 0.
    """
    n = F.greatest(F.floor(F.col("duration") / length), F.lit(1)).cast("int")
    parts = videos.withColumn("_n", F.when(F.col("duration") > 0, n).otherwise(F.lit(0)))
    rows = parts.withColumn("chapter_number", F.explode(F.sequence(F.lit(0), F.greatest(F.col("_n") - 1, F.lit(0)))))
    width = F.col("duration") / F.col("_n")
    end = F.when(F.col("chapter_number") == F.col("_n") - 1, F.col("duration")).otherwise((F.col("chapter_number") + 1) * width)
    return rows.select(
        "video_id",
        "chapter_number",
        F.when(F.col("_n") == 0, "Full Video").otherwise(F.concat(F.lit("Part "), (F.col("chapter_number") + 1).cast("string"))).alias("title"),
        F.when(F.col("_n") == 0, 0.0).otherwise(F.col("chapter_number") * width).alias("start_time"),
        F.when(F.col("_n") == 0, 0.0).otherwise(end).alias("end_time"),
        F.lit(True).alias("is_synthetic"),
    )


def with_density(chapters: DataFrame, default: str = "normal", dense: Iterable[int] = (), until: Column | float | None = None) -> DataFrame:
    """``density``: high for the chapters named, and for those that begin before ``until``; else the default."""
    high = F.col("chapter_number").isin([int(c) for c in dense]) if dense else F.lit(False)
    if until is not None:
        high = high | F.coalesce(F.col("start_time") < until, F.lit(False))
    return chapters.withColumn("density", F.when(high, "high").otherwise(F.lit(default)))


def chapter_lists(chapters: DataFrame, *columns: str) -> DataFrame:
    """``video_id, chapters``: a video's chapters in order, each a struct.  A video has few, whatever the corpus' size."""
    fields = ["chapter_number", "start_time", "end_time", *columns]
    return chapters.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("chapters"))


def chapter_at(chapters: Column, t: Column) -> Column:
    """The first chapter with start <= t < end; the last one if there is none, before the first start too; null if none at all."""
    inside = F.filter(chapters, lambda c: (c["start_time"] <= t) & (t < c["end_time"]))
    return F.coalesce(F.try_element_at(inside, F.lit(1)), F.try_element_at(chapters, F.lit(-1)))


def assign_chapter(points: DataFrame, chapters: DataFrame, time: str = "timestamp") -> DataFrame:
    """``points`` with ``chapter_number`` and ``density``; points of videos without chapters go.

    The chapters of a video travel as one array, so the join is on the video alone and no row is multiplied.
    """
    lists = chapter_lists(chapters, "density")
    found = points.join(lists, "video_id").withColumn("_c", chapter_at(F.col("chapters"), F.col(time)))
    return found.filter(F.col("_c").isNotNull()).withColumns({"chapter_number": F.col("_c.chapter_number"), "density": F.col("_c.density")}).drop("chapters", "_c")


def coverage(chapters: DataFrame, points: DataFrame, time: str = "timestamp") -> DataFrame:
    """``chapters`` with ``have``, the number of points with start <= t < end; 0 where there is none.

    Counted by fields of arrays, not by a range join: each point names the chapters that it is in.
    """
    lists = chapter_lists(chapters)
    inside = F.filter("chapters", lambda c: (c["start_time"] <= F.col(time)) & (F.col(time) < c["end_time"]))
    hits = points.join(lists, "video_id").select("video_id", F.explode(inside).alias("c")).groupBy("video_id", F.col("c.chapter_number").alias("chapter_number")).agg(F.count("*").alias("have"))
    return chapters.join(hits, ["video_id", "chapter_number"], "left").withColumn("have", F.coalesce("have", F.lit(0)))
