"""Choosing times: filling a budget evenly, and sampling inside scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import slot
from ..profiles import known
from .chapters import assign_chapter, chapter_at, chapter_lists, coverage


def fill(chapters: DataFrame, existing: DataFrame, budget: int = 200, per_chapter: int = 3) -> DataFrame:
    """``video_id, timestamp, origin``: the existing times (``cue``) and even samples (``fill``) up to the budget.

    Chapters with fewer than ``per_chapter`` times share what the budget leaves, one each at least.  A sample goes to an
    even place inside its chapter; it is dropped if its tenth of a second is taken, by an existing time or an earlier
    sample.  Existing times all stay, even beyond the budget.

    As sets: candidates, anti join with the taken slots, first of each slot, first of the budget.
    """
    cues = existing.select("video_id", "timestamp")
    used = cues.groupBy("video_id").agg(F.count("*").alias("_used"))
    known = chapters.join(used, "video_id", "left").withColumn("_left", budget - F.coalesce("_used", F.lit(0))).drop("_used")
    short = coverage(known, cues).filter((F.col("have") < per_chapter) & (F.col("_left") > 0))
    share = F.greatest(F.lit(1), F.floor(F.col("_left") / F.count("*").over(Window.partitionBy("video_id"))))
    want = short.withColumn("_n", F.least(per_chapter - F.col("have"), share)).filter((F.col("end_time") > F.col("start_time")) & (F.col("_n") > 0))
    each = want.withColumn("_j", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n").cast("bigint"))))
    t = F.round(F.col("start_time") + F.col("_j") * ((F.col("end_time") - F.col("start_time")) / (F.col("_n") + 1)), 3)
    samples = each.withColumn("timestamp", t).filter(F.col("timestamp") < F.col("end_time")).withColumn("_slot", slot(F.col("timestamp")))
    taken = cues.select("video_id", slot(F.col("timestamp")).alias("_slot")).distinct()
    free = samples.join(taken, ["video_id", "_slot"], "left_anti")
    order = ["chapter_number", "_j"]
    first = free.withColumn("_r", F.row_number().over(Window.partitionBy("video_id", "_slot").orderBy(*order))).filter("_r = 1")
    within = first.withColumn("_r", F.row_number().over(Window.partitionBy("video_id").orderBy(*order))).filter(F.col("_r") <= F.col("_left"))
    return cues.withColumn("origin", F.lit("cue")).unionByName(within.select("video_id", "timestamp", F.lit("fill").alias("origin")))


def light_points(times: DataFrame, chapters: DataFrame) -> DataFrame:
    """``video_id, timestamp, chapter_number, density, scene_id, ...``: one point for each time, to the millisecond.

    The smallest time of a millisecond stays, as it is.
    """
    w = Window.partitionBy("video_id", F.round("timestamp", 3)).orderBy("timestamp", *[c for c in times.columns if c not in ("video_id", "timestamp")])
    once = times.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return assign_chapter(once, chapters).withColumn("scene_id", F.lit(0))


def scene_points(scenes: DataFrame, chapters: DataFrame, profiles: DataFrame, fallback: float = 30.0) -> DataFrame:
    """``video_id, timestamp, chapter_number, density, scene_id``: samples within scenes, as dense as the chapters there ask.

    Each scene yields its start and then steps by the interval of the chapter in which it stands, so the step may change on
    the way; an interval of 0 ends the scene.  A density without a profile raises.  A video without scenes is sampled every ``fallback`` seconds from 0 to the
    end of its last chapter.  Of equal milliseconds the first in order of scene and step stays.

    The steps are a recurrence.  Between two places where the interval changes it is an arithmetic sequence, so the fold
    goes over a video's chapters, not over its samples: each adds as many steps as begin inside it.
    """
    named = profiles.select(F.col("name").alias("density"), F.col("scene_sample_interval").cast("double").alias("every"))
    lists = chapter_lists(chapters.join(F.broadcast(named), "density", "left").withColumn("every", known(F.col("every"), F.col("density"))), "density", "every")
    with_scenes = scenes.select("video_id", "scene_id", "start", "end").join(lists, "video_id")
    # places where the chapter at hand changes: starts and ends; between them it is the same
    edges = F.array_sort(F.array_distinct(F.flatten(F.transform("chapters", lambda c: F.array(c["start_time"], c["end_time"])))))
    inner = F.filter(edges, lambda e: (e > F.col("start")) & (e < F.col("end")))
    pieces = F.concat(inner, F.array(F.col("end")))
    zero = F.struct(F.col("start").alias("at"), F.col("start").alias("from"), F.lit(False).alias("over"), F.array(F.col("start")).alias("out"))

    def step(acc: Column, edge: Column) -> Column:
        # the chapter of the whole piece, as of its beginning
        every = chapter_at(F.col("chapters"), acc["from"])["every"]
        moving = ~acc["over"] & (acc["at"] < edge)
        live = moving & (every > 0)
        # steps that start inside the piece: the last of them may land beyond it
        n = F.when(live, F.ceil((edge - acc["at"]) / every)).otherwise(F.lit(0)).cast("int")
        new = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: acc["at"] + i * every)).otherwise(F.array().cast("array<double>"))
        return F.struct(
            F.when(n > 0, acc["at"] + n * every).otherwise(acc["at"]).alias("at"),
            edge.alias("from"),
            (acc["over"] | (moving & (every <= 0))).alias("over"),
            F.concat(acc["out"], F.filter(new, lambda t: t < F.col("end"))).alias("out"),
        )

    times = F.aggregate(pieces, zero, step, lambda acc: acc["out"])
    sampled = with_scenes.select("video_id", "scene_id", F.posexplode(times).alias("_i", "timestamp"))
    last = lists.join(scenes.select("video_id").distinct(), "video_id", "left_anti").withColumn("_end", F.element_at("chapters", -1)["end_time"]).filter("_end > 0")
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_end") / fallback).cast("int") - 1, F.lit(0)))
    plain = last.select("video_id", F.explode(steps).alias("scene_id")).select("video_id", "scene_id", F.lit(0).alias("_i"), (F.col("scene_id") * F.lit(float(fallback))).alias("timestamp"))
    w = Window.partitionBy("video_id", F.round("timestamp", 3)).orderBy("scene_id", "_i")
    once = sampled.unionByName(plain).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_i")
    return assign_chapter(once, chapters).select("video_id", "timestamp", "chapter_number", "density", "scene_id")


def numbered(points: DataFrame) -> DataFrame:
    """``points`` with ``frame_number``: the planned position in the video, from 0."""
    return points.withColumn("frame_number", F.row_number().over(Window.partitionBy("video_id").orderBy("timestamp", "scene_id")) - 1)
