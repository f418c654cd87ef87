"""Captions beside frames: an interval-overlap join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = "_none_"


def overlaps(frames: DataFrame, captions: DataFrame, window: float = 3.0) -> DataFrame:
    """``frames`` columns with ``caption_idx, text`` of each caption within ``window`` seconds of the frame; both ends count.

    Time is cut in bins as wide as the window's two sides, a caption is in each bin that it reaches, a frame in its own: an
    equi-join on video and bin in place of a range join, so a long video spreads over tasks.  A pair meets in one bin only.
    A caption has no bins before its video's first frame or behind the last, however wrong its end is.
    """
    width = max(2.0 * window, 1.0)
    span = frames.groupBy("video_id").agg(F.min("timestamp").alias("_lo"), F.max("timestamp").alias("_hi"))
    first, last = F.greatest(F.col("start") - window, F.col("_lo")), F.least(F.col("end") + window, F.col("_hi"))
    reach = F.sequence(F.floor(first / width), F.floor(last / width))
    c = captions.select("video_id", "caption_idx", "start", "end", "text").join(span, "video_id").filter(first <= last).select("video_id", "caption_idx", "start", "end", "text", F.explode(reach).alias("_bin"))
    f = frames.withColumn("_bin", F.floor(F.col("timestamp") / width))
    near = (F.col("start") <= F.col("timestamp") + window) & (F.col("end") >= F.col("timestamp") - window)
    return f.join(c, ["video_id", "_bin"]).filter(near).drop("_bin", "start", "end")


def align_captions(frames: DataFrame, captions: DataFrame, window: float = 3.0) -> DataFrame:
    """``video_id, frame_number, captions, caption_text``: the texts in caption order, and joined; ``_none_`` if there are none."""
    keys = ["video_id", "frame_number"]
    hits = overlaps(frames.select(*keys, "timestamp"), captions, window)
    texts = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("caption_idx", "text"))).alias("_c")).select(*keys, F.col("_c.text").alias("captions"))
    out = frames.select(*keys).join(texts, keys, "left").withColumn("captions", F.coalesce("captions", F.array().cast("array<string>")))
    return out.withColumn("caption_text", F.when(F.size("captions") > 0, F.array_join("captions", " ")).otherwise(NONE))
