"""Keeping and removing frames: quality, then near duplicates in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.images import is_black, is_blurry
from ..functions.scalars import hamming
from ..profiles import known


def quality(frames: DataFrame) -> DataFrame:
    """Frames that are neither black nor blurry; needs ``mean_luma`` and ``lap_var``."""
    return frames.filter(~is_black(F.col("mean_luma")) & ~is_blurry(F.col("lap_var")))


def deduplicate_frames(frames: DataFrame, profiles: DataFrame) -> DataFrame:
    """``frames(video_id, chapter_number, timestamp, frame_number, phash, is_slide, density)`` with ``is_kept``.

    Within a chapter, in order of time, a frame goes if a frame kept before it differs in fewer bits than the threshold of
    the chapter's density, the one for slides if either is slide-like.  The order matters and likeness is not transitive,
    so this is a fold over the kept ones.  A density without a profile raises.  A chapter's hashes are folded in one row; the rest of a frame stays outside it.
    """
    keys = ["video_id", "chapter_number"]
    limits = profiles.select(F.col("name").alias("density"), F.col("dedup_hamming_threshold").alias("_plain"), F.col("slide_dedup_hamming_threshold").alias("_slide"))
    limited = frames.join(F.broadcast(limits), "density", "left").withColumns({c: known(F.col(c), F.col("density")) for c in ("_plain", "_slide")})
    item = F.struct("timestamp", "frame_number", "phash", "is_slide")
    lists = limited.groupBy(*keys, "_plain", "_slide").agg(F.array_sort(F.collect_list(item)).alias("_f"))
    kind = dict(lists.dtypes)["_f"]

    def step(kept: Column, x: Column) -> Column:
        like = lambda k: hamming(k["phash"], x["phash"]) < F.when(k["is_slide"] | x["is_slide"], F.col("_slide")).otherwise(F.col("_plain"))
        return F.when(F.exists(kept, like), kept).otherwise(F.concat(kept, F.array(x)))

    kept = lists.select(*keys, F.explode(F.aggregate("_f", F.array().cast(kind), step)).alias("_k")).select(*keys, "_k.frame_number", F.lit(True).alias("_kept"))
    return frames.join(kept, [*keys, "frame_number"], "left").withColumn("is_kept", F.coalesce("_kept", F.lit(False))).drop("_kept")


def slide_threshold(hamming_threshold: int, slide: int | None = None) -> int:
    """The threshold for slides where none is given."""
    return slide if slide is not None else max(1, hamming_threshold - 2)


def removal_counts(frames: DataFrame) -> DataFrame:
    """``kept, low_quality, duplicates`` of frames with ``good`` (passed the quality check) and ``is_kept``."""
    return frames.agg(F.count_if("is_kept").alias("kept"), F.count_if(~F.col("good")).alias("low_quality"), F.count_if(F.col("good") & ~F.col("is_kept")).alias("duplicates"))
