"""Video metadata: the JSON that a download leaves beside the video."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import VIDEO_INFO

_REQUIRED = ("id", "title", "duration", "webpage_url")


def read_info(spark: SparkSession, path: str) -> DataFrame:
    """The info files under a path (one object a file), with ``path``.  Only the fields of the model are parsed."""
    return spark.read.schema(VIDEO_INFO).option("multiLine", True).json(path).withColumn("path", F.input_file_name())


def parse_info(raw: DataFrame, column: str = "json") -> DataFrame:
    """The same from a column of JSON texts."""
    return raw.withColumn("_v", F.from_json(column, VIDEO_INFO)).select(*[c for c in raw.columns if c != column], "_v.*")


def videos(info: DataFrame) -> DataFrame:
    """``video_id, title, duration, url, description``; a missing required field raises, a missing description is empty."""
    need = [F.when(F.col(c).isNull(), F.raise_error(F.lit(f"video info lacks {c}")).cast("double" if c == "duration" else "string")).otherwise(F.col(c)).alias(c) for c in _REQUIRED]
    checked = info.select(*need, F.coalesce("description", F.lit("")).alias("description"))
    return checked.select(F.col("id").alias("video_id"), "title", "duration", F.col("webpage_url").alias("url"), "description")


def chapters(info: DataFrame) -> DataFrame:
    """``video_id, chapter_number, title, start_time, end_time, is_synthetic``; none where the list is missing or empty."""
    rows = info.select(F.col("id").alias("video_id"), F.posexplode("chapters").alias("chapter_number", "c"))
    return rows.select("video_id", "chapter_number", "c.title", "c.start_time", "c.end_time", F.lit(False).alias("is_synthetic"))


def chosen_file(files: DataFrame, pattern: str) -> DataFrame:
    """``video_id, path``: of each video's files that match, the first by name."""
    return files.filter(F.col("path").rlike(pattern)).groupBy("video_id").agg(F.min("path").alias("path"))


def caption_file(files: DataFrame) -> DataFrame:
    """``video_id, path``: a transcribed caption file goes before a downloaded one, whichever order they are found in."""
    vtt = files.filter(F.col("path").rlike(r"\.vtt$"))
    rank = F.struct((~F.element_at(F.split("path", "/"), -1).contains("whisper")).alias("r"), F.col("path").alias("p"))
    return vtt.groupBy("video_id").agg(F.min(rank).alias("x")).select("video_id", F.col("x.p").alias("path"))
