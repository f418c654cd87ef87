"""The frame store as tables: reads, and changes as new tables instead of updates in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def videos(store: DataFrame, video_id: object) -> DataFrame:
    """The row of one video, if there is one."""
    return store.filter(F.col("video_id") == video_id)


def frames_of(frames: DataFrame, kept: bool | None = None) -> DataFrame:
    """Frames in order of time; with ``kept``, only those kept (True) or removed (False)."""
    some = frames if kept is None else frames.filter(F.col("is_kept") == kept)
    return some.orderBy("video_id", "timestamp", "frame_number")


def chapters_of(chapters: DataFrame) -> DataFrame:
    return chapters.orderBy("video_id", "chapter_number")


def frame_records(chapters: DataFrame, frames: DataFrame, kept: bool | None = None) -> DataFrame:
    """Each chapter with its frames, in one join; chapters without frames have one row of nulls, frames without chapter none.

    ``density`` defaults to normal, missing recognised text to empty.
    """
    some = frames if kept is None else frames.filter(F.col("is_kept") == kept)
    cols = ["video_id", "chapter_number", "frame_number", "timestamp", "path", "ocr_text", "is_kept"]
    joined = chapters.select("video_id", "chapter_number", "title", F.coalesce("density", F.lit("normal")).alias("density")).join(some.select(*cols), ["video_id", "chapter_number"], "left")
    return joined.withColumn("ocr_text", F.when(F.col("frame_number").isNotNull(), F.coalesce("ocr_text", F.lit(""))))


def grouped_frames(chapters: DataFrame, frames: DataFrame) -> DataFrame:
    """``video_id, chapter_number, frames``: an array in order of time, empty for chapters without frames."""
    item = F.struct("timestamp", "frame_number", "path")
    lists = frames.groupBy("video_id", "chapter_number").agg(F.array_sort(F.collect_list(item)).alias("frames"))
    kind = lists.schema["frames"].dataType
    return chapters.select("video_id", "chapter_number").join(lists, ["video_id", "chapter_number"], "left").withColumn("frames", F.coalesce("frames", F.array().cast(kind)))


def inserted(store: DataFrame, new: DataFrame, block: int = 100_000) -> DataFrame:
    """``store`` with the rows of ``new`` behind it, frames or chapters, under ids from the largest one on by their ``seq``.

    Columns that ``new`` lacks are null.  No row of ``new`` is numbered in one task: rows are counted by blocks of ``seq``,
    and a row's id is what the blocks before have and its number in its own.
    """
    rest = [c for c in store.columns if c != "id"]
    rows = new.withColumns({"seq": F.col("seq").cast("bigint"), "_b": F.floor(F.col("seq") / block)})
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    last = store.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("_last"))
    nth = F.row_number().over(Window.partitionBy("_b").orderBy("seq", *[c for c in rest if c in new.columns]))
    # one row on the right side
    numbered = rows.join(sizes, "_b").withColumn("_nth", nth).crossJoin(F.broadcast(last)).withColumn("id", F.col("_last") + F.col("_before") + F.col("_nth"))
    kinds = dict(store.dtypes)
    made = [(F.col(c) if c in numbered.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in store.columns]
    return store.unionByName(numbered.select(*made))


def insert_frames(store: DataFrame, new: DataFrame, block: int = 100_000) -> DataFrame:
    """``store`` with new frames: no recognised text and kept, unless they say otherwise."""
    return inserted(store, _defaults(new, ocr_text="", is_kept=True), block)


def insert_chapters(store: DataFrame, new: DataFrame) -> DataFrame:
    """``store`` with new chapters: a video's own ones, unless they say otherwise."""
    return inserted(store, _defaults(new, is_synthetic=False))


def _defaults(rows: DataFrame, **values: object) -> DataFrame:
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v) for c, v in values.items()})


def copies(frames: DataFrame, to: str) -> DataFrame:
    """``path, copy``: where the pictures go when those of many videos lie in one vault, the video's id before each name."""
    video, name = F.col("video_id").cast("string"), F.element_at(F.split("path", r"[/\\\\]"), -1)
    return frames.select("path", F.concat(F.lit(to.rstrip("/") + "/"), video, F.lit("/"), video, F.lit("_"), name).alias("copy"))


def upsert_videos(store: DataFrame, new: DataFrame) -> DataFrame:
    """New videos are added; of a known one only the title changes.  ``new`` has ``seq``, the order of arrival."""
    every = store.withColumn("seq", F.lit(-1).cast("bigint")).unionByName(new.withColumn("seq", F.col("seq").cast("bigint")))
    first = lambda c: F.min_by(c, "seq").alias(c)
    rest = [c for c in store.columns if c not in ("video_id", "title")]
    return every.groupBy("video_id").agg(F.max_by("title", "seq").alias("title"), *map(first, rest)).select(*store.columns)


def set_ocr(frames: DataFrame, texts: DataFrame) -> DataFrame:
    """``frames`` with the texts of ``texts(video_id, frame_number, ocr_text)`` where there is one."""
    new = texts.select("video_id", "frame_number", F.col("ocr_text").alias("_new"))
    return frames.join(new, ["video_id", "frame_number"], "left").withColumn("ocr_text", F.coalesce("_new", "ocr_text", F.lit(""))).select(*frames.columns)


def set_kept(frames: DataFrame, ids: DataFrame, flag: bool) -> DataFrame:
    """``frames`` with the flag set for those in ``ids(video_id, frame_number)``; an empty list changes nothing."""
    mark = ids.select("video_id", "frame_number", F.lit(True).alias("_hit")).distinct()
    return frames.join(mark, ["video_id", "frame_number"], "left").withColumn("is_kept", F.when(F.col("_hit"), F.lit(flag)).otherwise(F.col("is_kept"))).select(*frames.columns)


def reset_kept(frames: DataFrame, video_id: object, flag: bool) -> DataFrame:
    return frames.withColumn("is_kept", F.when(F.col("video_id") == video_id, F.lit(flag)).otherwise(F.col("is_kept")))


def without_videos(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` (frames or chapters) without those of the videos in ``gone(video_id)``."""
    return rows.join(gone.select("video_id"), "video_id", "left_anti")


def with_column(rows: DataFrame, name: str, default: object) -> DataFrame:
    """``rows`` with a column that older tables lack."""
    return rows if name in rows.columns else rows.withColumn(name, F.lit(default))


def best_first(cues: DataFrame, *by: str) -> DataFrame:
    """The cue of the lowest tier, then the earliest, of each group."""
    return cues.groupBy(*by).agg(F.min(F.struct("tier", "timestamp", "seg_idx")).alias("b")).select(*by, "b.tier", "b.timestamp", "b.seg_idx")


def earliest(rows: DataFrame, n: int) -> DataFrame:
    """The n earliest rows of each video."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("video_id").orderBy("timestamp", "origin"))).filter(F.col("_r") <= n).drop("_r")


def embedded(notes: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """``name``: what notes embed, by a pattern whose group 1 is the name."""
    return notes.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("name")).distinct()


def unused(files: DataFrame, used: DataFrame) -> DataFrame:
    """Files that nothing embeds."""
    return files.join(used, "name", "left_anti")
